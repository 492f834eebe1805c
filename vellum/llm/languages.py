"""Languages of documents and of the segments of mixed documents, with a confidence."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm import codes
from vellum.llm.sentences import units
from vellum.tables import written

LANGS = ("vi", "lzh", "zh", "en", "fr")
# Codes of the languages in the standards' spellings (the primary subtag).
CODES = {"vi": "vi", "vie": "vi", "lzh": "lzh", "zh": "zh", "zho": "zh", "chi": "zh", "cmn": "zh", "en": "en", "eng": "en", "fr": "fr", "fra": "fr", "fre": "fr"}
#: Tokens that make up this share of all counted are broadcast, at most 1 / TOKEN_SHARE of them; the rarer ones go to a file that executors map.
TOKEN_SHARE = 1e-6
#: Times a token must have been seen to speak for a language: one seen once speaks only for its own document's label.
SEEN = 2
#: Most that one token says for or against a language, log cost of a change of language after a sentence and within one, and how much
#: of the token evidence counts (tokens of a text are not independent).
CAP, CHANGE, CHANGE_WITHIN, TEMPER = 4.0, 6.0, 9.0, 0.5
#: How often a label is taken to be right.
RIGHT = 0.85
#: Rows of priors that are joined by broadcast; more are joined by a shuffle.
BROADCAST_PRIORS = 100_000
#: Words or Han characters below which a piece in another script within a sentence (a name, a word) is no sentence of its own.
LEAST_WORDS, LEAST_HAN = 3, 5

_HAN = "㐀-鿿豈-﫿⺀-⿟\U00020000-\U0003ffff"
_TOKEN = re.compile(rf"[{_HAN}]|[^\W\d_{_HAN}]+(?:[’'](?=[^\W\d_]))?")
_RUN = re.compile(rf"[{_HAN}]+|[^\W\d_{_HAN}]+(?:[^{_HAN}]*[^\W\d_{_HAN}]+)?")
_NOTE = re.compile(r"\([^()]*\)|（[^（）]*）|\[[^\[\]]*\]|【[^【】]*】|〔[^〔〕]*〕")
_BRACKET = re.compile("[(（[【〔]")
_IS_HAN = re.compile(f"[{_HAN}]")


def declared(lang: Column) -> Column:
    """The language a label names, by its primary subtag, or null where it names none of LANGS."""
    code = F.lower(F.regexp_extract(F.trim(F.coalesce(lang, F.lit(""))), r"^([A-Za-z]{2,3})(?:$|[-_])", 1))
    known = F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))
    return F.try_element_at(known, code)


def blanked(text: str) -> str:
    """The text with notes in brackets as blanks, as long as before."""
    return _NOTE.sub(lambda m: " " * len(m[0]), text) if _BRACKET.search(text) else text


def counts(documents: DataFrame) -> DataFrame:
    """(token, vi, lzh, zh, en, fr): how often each token stands in texts labelled with each language, over all documents.

    Tokens are numbers (``codes.tokens``). Rows are summed in each task before the shuffle, a row for each distinct token.
    """

    def run(batches):
        for b in batches:
            texts, labels = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            found, sums = [], []
            for i, j in codes.steps(texts):
                number, text, _ = codes.tokens(texts[i:j])
                f, distinct = pd.factorize(number)
                found.append(distinct)
                sums.append(np.bincount(f * len(LANGS) + labels[i:j][text], minlength=len(LANGS) * len(distinct)).reshape(-1, len(LANGS)))
            if found:
                token, n = codes.distinct(np.concatenate(found), np.concatenate(sums))
                yield pa.RecordBatch.from_arrays([pa.array(token), *(pa.array(n[:, k]) for k in range(len(LANGS)))], ["token", *LANGS])

    label = F.array_position(F.array(*map(F.lit, LANGS)), declared(F.col("lang"))) - 1
    x = documents.where("text <> ''").select("text", label.cast("int").alias("label")).where("label >= 0")
    return x.mapInArrow(run, "token long, " + ", ".join(f"{c} long" for c in LANGS)).groupBy("token").agg(*(F.sum(c).alias(c) for c in LANGS))


def priors(documents: DataFrame) -> DataFrame:
    """(source, doc_type, p_vi, …): the share of each language among labelled documents of a source and type, smoothed towards
    the source's share, that towards all. Grouped sums only: each level adds up the one below it, and one pass over the documents
    makes the lowest, which is written."""
    lang = declared(F.col("lang"))
    x = documents.select(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("doc_type", F.lit("")).alias("doc_type"), lang.alias("lang")).where("lang is not null")
    cells = written(x.groupBy("source", "doc_type").agg(*(F.count_if(F.col("lang") == c).alias(c) for c in LANGS)), "label-counts")
    hosts = cells.groupBy("source").agg(*(F.sum(c).alias(f"h_{c}") for c in LANGS))
    whole = hosts.agg(*(F.sum(f"h_{c}").alias(f"w_{c}") for c in LANGS))
    j = cells.join(hosts, "source").crossJoin(F.broadcast(whole))  # whole is one row
    total = lambda p: sum((F.col(f"{p}{c}") for c in LANGS), F.lit(0))
    k = 20.0
    out = []
    for c in LANGS:
        g = (F.col(f"w_{c}") + 1) / (total("w_") + len(LANGS))
        h = (F.col(f"h_{c}") + k * g) / (total("h_") + k)
        out.append(((F.col(c) + k * h) / (total("") + k)).alias(f"p_{c}"))
    return j.select("source", "doc_type", *out)


class Text:
    """Scores and segments of texts from the token counts of each language."""

    def __init__(self, token: np.ndarray, n: np.ndarray, totals: np.ndarray, labels: dict[tuple[str, str], float], rare: str | None = None):
        """``token``: numbers in order; ``n``: a row of counts for each; ``rare``: the file of the tokens that are not among them, if any."""
        self.known, self.totals = token, np.asarray(totals, float)
        self.rare = codes.mapped(rare, 1 + len(LANGS)) if rare else None
        # an unknown token speaks for the scripts it can stand in
        weak = [[-CAP if (lang in ("lzh", "zh")) != han else 0.0 for lang in LANGS] for han in (False, True)]
        self.table = np.vstack([self._logs(n), weak]).T * TEMPER
        self.labels = np.array([[labels.get((label or "", lang), 0.0) for lang in LANGS] for label in (*LANGS, None)])

    def _logs(self, n: np.ndarray) -> np.ndarray:
        """Log likelihoods of tokens, relative to the best language, not below -CAP."""
        p = np.log((n.reshape(-1, len(LANGS)) + 0.5) / (self.totals + 1.0))
        return np.maximum(p - p.max(axis=1, keepdims=True), -CAP) if len(p) else p

    def weights(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each token, weights of the places by language)."""
        place, distinct = pd.factorize(number)
        at = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        hit = self.known[at] == distinct if len(self.known) else np.zeros(len(distinct), bool)
        w = self.table[:, np.where(hit, at, len(self.known) + codes.is_han(distinct))]
        if self.rare is not None and not hit.all():
            keys = self.rare[0]
            miss = np.flatnonzero(~hit)
            at = np.minimum(np.searchsorted(keys, distinct[miss]), len(keys) - 1)
            miss, at = miss[keys[at] == distinct[miss]], at[keys[at] == distinct[miss]]
            if len(miss):
                w[:, miss] = self._logs(np.stack([c[at] for c in self.rare[1:]], axis=1)).T * TEMPER
        return place, w

    def said(self, label: list[str | None], prior: list[list[float] | None]) -> np.ndarray:
        """What a document's label and the prior of its source say for each language: a row for each document."""
        flat = [[1.0] * len(LANGS) if not p or p[0] is None else p for p in prior]
        number = [LANGS.index(x) if x else len(LANGS) for x in label]
        return 0.5 * np.log(np.maximum(np.array(flat, float).reshape(-1, len(LANGS)), 1e-6)) + self.labels[number]

    def whole(self, texts: list[str], say: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language or -1 for a text without words, confidence, whether the text could change its language) of texts as a whole.

        A path of languages over a text's sentences pays CHANGE at least for each change. ``most`` is the most that any stretch of
        tokens, wherever it is cut, says for another language than the text's; where twice that and what label and prior
        say do not make up for one change, no path with changes can be the best one, however the text is cut into sentences.
        """
        number, text, _ = codes.tokens(list(map(blanked, texts)))
        without = np.setdiff1d(np.arange(len(texts)), text)
        if len(without):  # words in notes only
            some = codes.tokens([texts[i] for i in without])
            if len(some[0]):
                number, text = np.concatenate([number, some[0]]), np.concatenate([text, without[some[1]]])
                order = np.argsort(text, kind="stable")
                number, text = number[order], text[order]
        lang, confidence, opens = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), bool)
        if not len(number):
            return lang, confidence, opens
        place, w = self.weights(number)
        new = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        has = text[new]
        sizes = np.diff(np.append(new, len(text)))
        post = np.stack([np.add.reduceat(x[place], new) for x in w], axis=1) + say[has]
        best = post.argmax(axis=1)
        top = post[np.arange(len(has)), best]
        lang[has], confidence[has] = best, 1 / np.exp(post - top[:, None]).sum(axis=1)
        doc = np.repeat(np.arange(len(has)), sizes)
        own = w.T.ravel()[place * len(LANGS) + best[doc]]
        most = np.zeros(len(has))
        fall = doc * (2.0 * CAP * (sizes.max() + 1))  # sums of a text lie below those of the text before it
        for x in w:
            gain = np.cumsum(x[place] - own)
            gain -= np.repeat(gain[new] - (x[place[new]] - own[new]), sizes)
            least = np.minimum(np.minimum.accumulate(gain - fall) + fall, 0)
            most = np.maximum(most, np.maximum.reduceat(gain - least, new))
        extra = say[has].max(axis=1) - say[has][np.arange(len(has)), best]
        opens[has] = 2 * most + extra >= CHANGE
        return lang, confidence, opens

    def pieces(self, text: str, ends: list[tuple[int, int]]) -> list[tuple[int, int, bool]]:
        """(start, end, whether a sentence starts here): sentences cut at line ends and where the script changes for a
        whole phrase. A shorter stretch in another script stays with the piece before it."""
        out = []
        for start, last in ends:
            unit = _NOTE.sub(lambda m: "\x01" * len(m[0]), text[start : last + 1])
            cuts = [0]
            for line in re.finditer(r"[^\n]+", unit):
                if line.start() and cuts[-1] != line.start():
                    cuts.append(line.start())
                runs = []
                for r in _RUN.finditer(line[0]):
                    han = bool(_IS_HAN.match(r[0]))
                    if runs and runs[-1][0] == han:
                        runs[-1][2] += r[0]
                    else:
                        runs.append([han, line.start() + r.start(), r[0]])
                big = [(h, at) for h, at, s in runs if (len(s) >= LEAST_HAN if h else len(_TOKEN.findall(s)) >= LEAST_WORDS)]
                for (h0, _), (h1, at) in zip(big, big[1:]):
                    if h0 != h1 and cuts[-1] < at:
                        cuts.append(at)
                if big and big[0][0]:  # Han text changes at its blanks
                    for m in re.finditer(rf"(?<=[{_HAN}。，、○！？」』])[ 　]+(?=[{_HAN}]{{{LEAST_HAN}}})", line[0]):
                        at = line.start() + m.end()
                        if at not in cuts and text[start + at - 2 : start + at - 1] != "奉":
                            cuts.append(at)
            cuts = sorted(set(cuts))
            for i, at in enumerate(cuts):
                end = cuts[i + 1] if i + 1 < len(cuts) else len(unit)
                out.append((start + at, start + end, i == 0))
        return out

    def segments(self, text: str, ends: list[tuple[int, int]], say: list[float]) -> list[tuple[int, int, str, float]]:
        """(start, end, lang, confidence) of the segments of a text, in order; none for a text without words.

        Evidence is fused in log space: the tokens of a piece, the document's label, and the prior of its source. The languages
        of the pieces are decoded by Viterbi with a cost for each change; the label and prior count once for each segment.
        """
        number, _, at = codes.tokens([blanked(text)])
        pieces = self.pieces(text, ends)
        if not len(number):
            number, _, at = codes.tokens([text])
            pieces = [(0, len(text), True)]
        if not len(number):
            return []
        place, w = self.weights(number)
        sums = np.vstack([np.zeros(len(LANGS)), np.cumsum(w[:, place], axis=1).T])
        rows = []
        for a, b, whole in pieces:
            i, j = np.searchsorted(at, (a, b))
            if j > i:
                rows.append((a, b, whole, (sums[j] - sums[i]).tolist()))
        if not rows:
            return []
        k = len(LANGS)
        v, back = [x + y for x, y in zip(rows[0][3], say)], []
        for _, _, whole, s in rows[1:]:
            cost = CHANGE if whole else CHANGE_WITHIN
            top = max(range(k), key=v.__getitem__)
            now, from_ = [], []
            for i in range(k):
                stay, change = v[i], v[top] - cost + 0.2 * say[i]
                from_.append(i if stay >= change else top)
                now.append(max(stay, change) + s[i])
            v = now
            back.append(from_)
        i = max(range(k), key=v.__getitem__)
        path = [i]
        for from_ in reversed(back):
            i = from_[i]
            path.append(i)
        path.reverse()
        out: list[list] = []
        for (a, b, _, s), i in zip(rows, path):
            if out and out[-1][2] == i:
                out[-1][1] = b
                out[-1][3] = [x + y for x, y in zip(out[-1][3], s)]
            else:
                out.append([a, b, i, list(s)])
        done = []
        for a, b, i, s in out:
            post = [x + y for x, y in zip(s, say)]
            top = max(post)
            done.append((a, b, LANGS[i], round(math.exp(post[i] - top) / sum(math.exp(x - top) for x in post), 6)))
        return done


def fit(documents: DataFrame):
    """Token counts by label over all labelled documents, and what a label says, as a broadcast of at most 1 / TOKEN_SHARE tokens; the
    rarer ones go to a file.

    A label says for a language the log of how often labels are right against wrong; labels are taken to be right
    RIGHT of the time, the rest spread over the other languages.
    """
    counted = written(counts(documents), "token-counts-by-label")
    sums = counted.agg(F.count("*"), *(F.coalesce(F.sum(c), F.lit(0)) for c in LANGS)).collect()[0]
    totals = np.array([int(x) for x in sums[1:]])
    n = sum((F.col(c) for c in LANGS), F.lit(0))
    counted = counted.where(n >= SEEN)
    often = n >= (totals.sum() * TOKEN_SHARE if sums[0] > 1 / TOKEN_SHARE else 0)
    token, *columns = codes.collected(counted.where(often))
    order = np.argsort(token)
    rare = codes.shared_file(counted.where(~often)) if sums[0] > 1 / TOKEN_SHARE else None
    labels = {(a, b): math.log(RIGHT if a == b else (1 - RIGHT) / (len(LANGS) - 1)) for a in LANGS for b in LANGS}
    return documents.sparkSession.sparkContext.broadcast((token[order], np.stack(columns, axis=1)[order] if len(token) else np.zeros((0, len(LANGS))), totals, labels, rare))


def segments(documents: DataFrame) -> DataFrame:
    """(doc_id, label, seg_no, start, last, lang, confidence), a row for each segment; seg_no is 0 for a document in one
    language, else from 1 in text order. Null, empty and blank texts and texts without words give no row. Whole texts are
    read. A document in one language is one segment, from its first character to its last.

    The model is one counting pass; the rest is one narrow pass. Each text is first scored as a whole, many in one step; only those
    that could change their language are cut into sentences, which SQL does, and decoded. The priors of sources are a small table by
    (source, doc_type), joined on both."""
    documents = documents.select("doc_id", "text", "lang", "source", "doc_type")  # other columns may have any name
    shared = fit(documents)
    p = priors(documents).withColumnsRenamed({"source": "_s", "doc_type": "_t"})
    p = written(p.select("_s", "_t", F.array(*(F.col(f"p_{c}") for c in LANGS)).alias("prior")), "priors")
    x = documents.where("text <> ''").withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_t", F.coalesce("doc_type", F.lit("")))
    # a row for each source and type: sent to all tasks where it is small, so that documents need not move
    x = x.join(F.broadcast(p) if p.count() <= BROADCAST_PRIORS else p, ["_s", "_t"], "left")
    x = x.select("doc_id", declared(F.col("lang")).alias("label"), "prior", "text")
    kind = documents.schema["doc_id"].dataType.simpleString()

    def first(batches):
        model = codes.once(shared, Text)
        for b in batches:
            label, prior, texts = (b.column(i).to_pylist() for i in (1, 2, 3))
            say = model.said(label, prior)
            for i, j in codes.steps(texts):
                lang, confidence, opens = model.whole(texts[i:j], say[i:j])
                kept = [t if o else None for t, o in zip(texts[i:j], opens)]
                sizes = [len(t) - 1 for t in texts[i:j]]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(lang, pa.int32()), pa.array(confidence), pa.array(sizes, pa.int32()), pa.array(list(say[i:j]), pa.list_(pa.float64())), pa.array(kept, pa.string())],
                    ["doc_id", "label", "lang", "confidence", "last", "say", "text"],
                )

    x = x.mapInArrow(first, f"doc_id {kind}, label string, lang int, confidence double, last int, say array<double>, text string").where("lang >= 0")
    x = x.withColumn("units", F.when(F.col("text").isNotNull(), F.transform(units(F.col("text")), lambda u: F.array(u["start"], u["last"]))))

    def second(batches):
        model = codes.once(shared, Text)
        for b in batches:
            rows = []
            for id_, label, lang, confidence, last, say, text, ends in zip(*(b.column(i).to_pylist() for i in range(8))):
                if text is None:
                    rows.append((id_, label, 0, 0, last, LANGS[lang], round(confidence, 6)))
                    continue
                got = model.segments(text, ends or [], say)
                if len(got) == 1:
                    rows.append((id_, label, 0, 0, last, *got[0][2:]))
                else:
                    rows += [(id_, label, i, a, e - 1, lang, conf) for i, (a, e, lang, conf) in enumerate(got, 1)]
            cols = list(map(list, zip(*rows))) if rows else [[]] * 7
            kinds = (b.schema.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "label", "seg_no", "start", "last", "lang", "confidence"])

    return x.mapInArrow(second, f"doc_id {kind}, label string, seg_no int, start int, last int, lang string, confidence double")


def found(documents: DataFrame) -> DataFrame:
    """(doc_id, seg_no, lang): documents in one language whose label is missing or wrong (seg_no 0) and all segments of
    documents that change language. A repeated doc_id gives its cases once."""
    s = segments(documents)
    return s.where((F.col("seg_no") > 0) | F.col("label").isNull() | (F.col("label") != F.col("lang"))).select("doc_id", "seg_no", "lang").distinct()
