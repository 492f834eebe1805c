"""Repair of text from scanned pages: furniture, broken words and misread characters.

A noisy channel: what a page shows is a path through candidate words, scored by how likely the scan turns a word into what was
read and by n-gram counts of the whole corpus, and decoded by Viterbi.
"""

from __future__ import annotations

import atexit
import gc
import math
import os
import re
import shutil
import tempfile
import unicodedata
import uuid
from collections import Counter
from contextlib import contextmanager
from hashlib import blake2b
from itertools import pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import codes
from vellum.llm.lookalikes import Model as LetterModel
from vellum.llm.lookalikes import _UNSEEN_RE, form

# What scanners confuse in Latin letters (as shown, as read), and signs they add.
CONFUSED = (("n", "u"), ("u", "n"), ("h", "b"), ("b", "h"), ("t", "f"), ("c", "e"), ("e", "c"), ("g", "9"), ("o", "0"), ("l", "1"), ("i", "1"), ("i", "!"), ("l", "!"), ("m", "rn"), ("s", "5"), ("b", "6"), ("l", "i"), ("i", "l"), ("đ", "d"))
ADDED = "|^~#"
HYPHENS = "-¬=­‐"
NUMERALS = "〇零一二三四五六七八九十百千"
#: Shares of the corpus that bound what is broadcast: a pair of words, a token or a header shape is broadcast if it makes up at least this
#: share of all, so that at most 1 / share of them are, whatever the corpus. Rarer pairs and tokens are looked up in a file.
PAIR_SHARE, SHAPE_SHARE, AT_EDGE = 1e-6, 2e-4, 0.4
#: A shape is a running header of a work if it is at the edge of so many of its pages and of this share of its texts, and so many times
#: out of those it occurs (AT_EDGE). It then counts in that work; those that make up SHAPE_SHARE of all texts count everywhere.
LEAST_PAGES, WORK_SHARE = 5, 0.005
#: Works whose headers are joined by broadcast; more are joined by a shuffle.
BROADCAST_WORKS = 100_000
#: Share of all tokens from which a word can be a candidate; share of the numbers from which the next word is a unit of measure.
COMMON, UNIT = 2e-5, 0.004
#: Log probabilities that a known error, another accent and any other one-character error turned a word into what was read.
KNOWN, MARK, OTHER = math.log(0.08), math.log(0.06), math.log(0.0004)
#: Log probability that a reader's correction of the same text shows a character that is not on the page.
READER = math.log(1e-12)
#: Weight of a word's own frequency where a pair was not seen.
SMOOTH = 0.5

_HAN = "㐀-鿿豈-﫿\U00020000-\U0003ffff"
_TOKEN = re.compile(rf"[{_HAN}]|[^\W_{_HAN}]+|[.,;:!?…。，、：；？！．○()\"“”«»‘’「」『』（）]+")
_HAN_RE = re.compile(f"[{_HAN}]")
_NUMBER = re.compile(r"\d+")
_ADDED_RE = re.compile(rf"[{re.escape(ADDED)}]")
_IN_WORD = re.compile(r"[^\W\d_]![^\W\d_:]|[^\W\d_]!:")
_IN_WORD_I = re.compile(r"([^\W\d_])!(?=[^\W\d_:])|(?<=[^\W\d_])!(?=:)")
_BROKEN = re.compile(rf"[^\W\d_{_HAN}][{HYPHENS}]\s*$")
_PAGE = re.compile(r"(?i)[\W_]*(?:tr(?:ang)?|p(?:age)?|tờ|fol)?[\W_]*\d+(?:\s*/\s*\d+)?[\W_]*")
_LAST_WORD = re.compile(rf"[^\W_{_HAN}]+$")
_BARE = re.compile(rf"\s*(?:\d+|[{NUMERALS}]+)\s*")
_DECORATED = re.compile(r"(?i)\s*(?:— ?\d+ ?—|- ?\d+ ?-|\[ ?\d+ ?\]|\. ?\d+ ?\.|\d+ ?/ ?\d+|tr(?:ang)?\.? ?\d+|p(?:age)?\.? ?\d+)\s*")
_FOLIO = re.compile(rf"\s*(?:第[{NUMERALS}]+[葉頁張]|[{NUMERALS}]+[上下])\s*")
_VOLUME = re.compile(rf"(?:\d+\s{{2,}})?[{_HAN}]{{2,8}}卷[{NUMERALS}上中下]+(?:\s{{2,}}\d+)?\s*")
_VOLUME_VI = re.compile(r"(?:\d+\s{2,})?[^\W\d_][^.!?…:;\d]{4,48},\s*tập\s+\d+(?:\s{2,}\d+)?\s*", re.I)
_OWN_NUMBER = re.compile(r"^\s*\d+\s{2,}|\s{2,}\d+\s*$")
_HYPHENS = frozenset(HYPHENS)
_MARKS = ".,;:!?…)”’»\"-¬= "
_BARE_LETTERS = LetterModel({})


def mends(text: str) -> bool:
    """Whether ``plain`` could change the text."""
    return not text.isascii() and _MENDS.search(text) is not None


def plain(text: str) -> str:
    """The text without what problem 5 mends, so that only errors of the scan are left."""
    if not mends(text):
        return text
    text = text.translate(_STROKED)
    # soft hyphens at a line's end are marks of broken words and stay
    return "\n".join(form(line[:-1], _BARE_LETTERS) + "-" if line.endswith("­") else form(line, _BARE_LETTERS) for line in text.split("\n"))


_STROKED = str.maketrans("ÐƉðɖ", "ĐĐđđ")
_MENDS = re.compile("[­​-‏⁠-⁤﻿︀-️̀-ͯͰ-αγ-ϿЀ-ԯ  -   ０-９Ａ-Ｚａ-ｚ⺀-⿟豈-﫿ÐƉ\U000e0100-\U000e01ef]")


class _Norm(dict):
    """What a token counts as: itself, 0 for a number, : or . for a run of marks."""

    def __missing__(self, t: str) -> str:
        if len(self) > 500_000:
            self.clear()
        self[t] = v = (":" if ":" in t else ".") if not t[0].isalnum() else "0" if t.isdigit() else t
        return v


_NORM = _Norm()


def tokens(line: str) -> list[str]:
    """Han characters, words in lower case, 0 for numbers, and : or . for runs of marks."""
    found = _TOKEN.findall(line.lower())
    return list(itemgetter(*found)(_NORM)) if len(found) > 1 else [_NORM[t] for t in found]


def shape(line: str) -> str:
    """A line in lower case without its page number, numbers as 9."""
    return _NUMBER.sub("9", _OWN_NUMBER.sub("", line).strip().lower())


def countable(s: str) -> bool:
    """Whether a shape can be a running header: some words, no final mark, no label, not Han."""
    return 8 <= len(s) <= 60 and s[-1] not in _MARKS and s.count(" ") >= 2 and ":" not in s and not _HAN_RE.search(s)


@contextmanager
def uncollected():
    """Without garbage collection, for tables of millions of small objects and no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def count(texts: DataFrame) -> DataFrame:
    """(kind, a, b, n, pages) over all rows of (han, shown, read, work, page); kind p: neighbouring tokens; t: texts of a work (b); e and a:
    shapes (a) of a work (b) at a text's first or last line and anywhere; c: Han characters confused, as shown in ``han`` and as read
    in ``read``. ``pages``: which of 64 classes of pages a shape is at the edge of, a bit each.

    ``shown`` holds texts as scanned, ``han`` corrected Han text, ``read`` its scan. Rows are combined in each task before
    the shuffle, so what is shuffled are distinct pairs of words.
    """

    def run(batches):
        pairs, shapes, confused, n, pages = Counter(), Counter(), Counter(), Counter(), {}
        known: dict[str, tuple[list[str], str | None]] = {}  # tokens and shape: answers of several models share most lines
        with uncollected():
            for b in batches:
                whole: dict[str, list[str]] = {}  # an answer given twice is read once
                for shown, work, page in zip(*(b.column(i).to_pylist() for i in (1, 3, 4))):
                    if not shown:
                        continue
                    lines = whole.get(shown)
                    if lines is None:
                        lines = whole[shown] = plain(shown).split("\n")
                    n["t", "", work] += 1
                    ts = ["."]
                    for i, line in enumerate(lines):
                        got = known.get(line)
                        if got is None:
                            if len(known) >= 60_000:
                                known.clear()
                            # Han text is counted as corrected only
                            s = shape(line) if 8 <= len(line) < 60 and line[-1] not in _MARKS and not line[0].islower() else ""
                            got = known[line] = ["."] if _HAN_RE.search(line) else tokens(line), s if s and countable(s) else None
                        ts += got[0]
                        if (s := got[1]) is not None:
                            shapes["a", s, work] += 1
                            if i == 0 or i == len(lines) - 1:
                                shapes["e", s, work] += 1
                                if page is not None:
                                    pages[s, work] = pages.get((s, work), 0) | 1 << (page & 63)
                    pairs.update(zip(ts, [*ts[1:], "."]))
                for han, read in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                    if han:
                        han = plain(han)
                        ts = tokens(han)
                        pairs.update(zip([".", *ts], [*ts, "."]))
                        if read:
                            body = "".join(x for x in plain(read).split("\n") if not furniture_han(x))
                            flat = han.replace("\n", "")
                            if len(body) == len(flat) and body != flat:
                                confused.update((x, y) for x, y in zip(flat, body) if x != y)
        out = [("p", a, c, k, 0) for (a, c), k in pairs.items()] + [("c", a, c, k, 0) for (a, c), k in confused.items()]
        out += [(k, s, w, v, _signed(pages.get((s, w), 0)) if k == "e" else 0) for (k, s, w), v in (*shapes.items(), *n.items())]
        for at in range(0, len(out), 50_000):
            yield pa.RecordBatch.from_pydict(dict(zip(("kind", "a", "b", "n", "pages"), map(list, zip(*out[at : at + 50_000])))))

    x = texts.select("han", "shown", "read", F.coalesce("work", F.lit("")), F.col("page").cast("long"))
    return x.mapInArrow(run, "kind string, a string, b string, n long, pages long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"), F.bit_or("pages").alias("pages"))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def furniture_han(line: str) -> bool:
    return bool(_FOLIO.fullmatch(line) or _VOLUME.fullmatch(line) or _DECORATED.fullmatch(line) or _BARE.fullmatch(line))


def _key(a: str, b: str) -> int:
    """A pair as a number of 63 bits; b is empty for a token."""
    return int.from_bytes(blake2b(f"{a}\0{b}".encode(), digest_size=8).digest(), "big") >> 1


class Counts(dict):
    """Counts of which the rare ones lie in a file, in the order of their keys; the file is mapped and not read into memory."""

    def __init__(self, often: dict, rare: tuple[np.ndarray, np.ndarray]):
        super().__init__(often)
        self.keys_, self.n = rare

    def __missing__(self, x: str | tuple[str, str]) -> int:
        key = _key(*x) if isinstance(x, tuple) else _key(x, "")
        at = int(np.searchsorted(self.keys_, key))
        return int(self.n[at]) if at < len(self.keys_) and self.keys_[at] == key else 0

    def get(self, x, default=0):
        return self[x] or default

    def __contains__(self, x) -> bool:
        return self[x] > 0


def rare_file(rare: DataFrame) -> str:
    """Sends (a, b, n) to all executors as two files of numbers, keys in order and counts, and returns their name. The driver passes on one
    batch at a time."""

    def key(batches):
        for x in batches:
            keys = [_key(a, b) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), x.column(2)], ["key", "n"])

    def pack(batches):
        for x in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.column(i).to_numpy().astype("<i8").tobytes()], pa.binary()) for i in (0, 1)], ["key", "n"])

    name = os.path.join(tempfile.mkdtemp(), f"rare-{uuid.uuid4().hex}")
    packed = rare.select("a", "b", "n").mapInArrow(key, "key long, n long").orderBy("key").mapInArrow(pack, "key binary, n binary")
    with open(name + ".key", "wb") as keys, open(name + ".n", "wb") as numbers:
        for r in packed.toLocalIterator():
            keys.write(r.key)
            numbers.write(r.n)
    for end in (".key", ".n"):
        rare.sparkSession.sparkContext.addFile(name + end)
    atexit.register(shutil.rmtree, os.path.dirname(name), True)  # executors fetch it from there
    return os.path.basename(name)


class _Safe(dict):
    """Whether pairs of tokens are safe, remembered."""

    def __init__(self, channel: Channel):
        super().__init__()
        self.channel = channel

    def __missing__(self, p: tuple[str, str]) -> bool:
        if len(self) > 500_000:
            self.clear()
        self[p] = got = self.channel.safe(*p)
        return got


class Headers:
    """Running headers, also as misread by a character."""

    def __init__(self, shapes: list[str]):
        self.shapes = frozenset(shapes)
        self.near: set[str] = set()
        for h in shapes:
            self.near |= {h[:i] + "*" + h[i + 1 :] for i in range(len(h))} | {h[:i] + h[i + 1 :] for i in range(len(h))}
        self.longest = max(map(len, shapes), default=0) + 8
        # one wrong character leaves the first four or the last four as they are
        self.starts, self.ends = {h[:4] for h in shapes}, {h[-4:] for h in shapes}

    def has(self, line: str) -> bool:
        if not self.shapes or not 8 <= len(line) <= max(self.longest, 60) or line[0].islower():
            return False
        s = shape(line)
        if s in self.shapes:
            return True
        if not 8 <= len(s) <= self.longest or s[:4] not in self.starts and s[-4:] not in self.ends or line[-1] in ".!?…)”’»\"" and not s[:-1] in self.near:
            return False
        return s in self.near or any(s[:i] + "*" + s[i + 1 :] in self.near or s[:i] + s[i + 1 :] in self.shapes for i in range(len(s)))


class Channel:
    """Candidates, scores and repair of lines, from the counts of a corpus.

    ``total``: of all tokens. ``rare``: the name of the file of pairs and tokens that are not in ``pairs`` and ``n``, if any.
    """

    def __init__(self, pairs: dict[tuple[str, str], int], n: dict[str, int], total: int, confused: dict[tuple[str, str], int], headers: list[str], rare: str | None = None):
        self.pairs, self.n = pairs, Counter(n)
        if rare:
            file = tuple(np.memmap(SparkFiles.get(rare + end), "<i8", "r") for end in (".key", ".n"))
            self.pairs, self.n = Counts(pairs, file), Counts(n, file)
        self.units = {b for (a, b), k in pairs.items() if a == "0" and k > UNIT * self.n["0"] and b.isalpha()}
        self.headers = Headers(headers)
        self.own: dict[tuple[str, ...], Headers] = {}
        self.total = total
        self.common = {w for w, k in self.n.items() if k >= max(3, COMMON * total) and w.isalpha()}
        self.index: dict[str, list[str]] = {}
        for w in self.common:
            if len(w) > 1 or not _HAN_RE.match(w):
                for i in range(len(w)):
                    self.index.setdefault(w[:i] + "*" + w[i + 1 :], []).append(w)
                    self.index.setdefault(w[:i] + w[i + 1 :], []).append(w)
        self.han: dict[str, dict[str, float]] = {}
        for (shown, read), k in confused.items():
            if _HAN_RE.match(shown) and _HAN_RE.match(read):
                self.han.setdefault(read, {})[shown] = math.log(max(min(k / (self.n[shown] + 1), 0.3), 0.01))
        self.confused = {(read, shown) for shown, read in CONFUSED}
        self.safe_pairs = _Safe(self)
        self.steps: dict[tuple[str, str], float] = {}
        self.lines: dict[str, tuple[bool, str, bool, list[str], list[int]]] = {}
        self.furniture: dict[str, bool | None] = {}
        self.spans: dict[tuple[str, ...], tuple[str, ...]] = {}
        self.of: dict[str, dict[str, float]] = {}

    def candidates(self, w: str) -> dict[str, float]:
        """Words that the scan may have turned into ``w``, with the log probability of that."""
        got = self.of.get(w)
        if got is not None:
            return got
        out: dict[str, float] = {}
        if _HAN_RE.match(w):
            out = dict(self.han.get(w, ()))
        elif len(w) > 1:
            for i in range(len(w)):
                for v in self.index.get(w[:i] + "*" + w[i + 1 :], ()):  # one character for another
                    if len(v) == len(w) and v != w:
                        a, b = v[i], w[i]
                        mark = unicodedata.normalize("NFD", a)[0] == unicodedata.normalize("NFD", b)[0]
                        out[v] = max(out.get(v, -99), KNOWN if (b, a) in self.confused else MARK if mark else OTHER)
                v = w[:i] + w[i + 1 :]
                if v in self.common:  # one too many
                    out[v] = max(out.get(v, -99), OTHER)
            for v in self.index.get(w, ()):  # one lost
                if len(v) == len(w) + 1:
                    out[v] = max(out.get(v, -99), OTHER)
            for read, shown in self.confused:
                if len(read) > 1 and read in w:
                    for m in re.finditer(read, w):
                        v = w[: m.start()] + shown + w[m.end() :]
                        if v in self.common:
                            out[v] = KNOWN
            if len(w) > 2 and not out and w not in self.common:  # two known errors in a word
                for i in range(len(w)):
                    for read, shown in self.confused:
                        if w.startswith(read, i):
                            x = w[:i] + shown + w[i + len(read) :]
                            if x in self.common:
                                out[x] = KNOWN
                            else:
                                for j in range(len(x)):
                                    for v in self.index.get(x[:j] + "*" + x[j + 1 :], ()):
                                        if len(v) == len(x):
                                            out[v] = max(out.get(v, -99), KNOWN + OTHER / 2)
        if len(self.of) > 300_000:
            self.of.clear()
        self.of[w] = out
        return out

    def weight(self, a: str, b: str) -> float:
        return self.pairs.get((a, b), 0) + SMOOTH * (self.n.get(b, 0) + 0.5) / (self.total + 1)

    def step_read(self, a: str, b: str) -> float:
        """``step`` for a pair as it was read, without its own occurrence in the counts: an error seen once speaks for nothing."""
        own = max(self.pairs.get((a, b), 0) - 1, 0) + SMOOTH * (max(self.n.get(b, 0) - 1, 0) + 0.5) / (self.total + 1)
        return math.log(own / (max(self.n.get(a, 0) - 1, 0) + SMOOTH))

    def step(self, a: str, b: str) -> float:
        got = self.steps.get((a, b))
        if got is None:
            if len(self.steps) >= 500_000:
                self.steps.clear()
            got = self.steps[a, b] = math.log(self.weight(a, b) / (self.n.get(a, 0) + SMOOTH))
        return got

    def safe(self, a: str, b: str) -> bool:
        """Whether no candidate in place of a, of b or of both could win on this pair."""
        k = max(self.pairs.get((a, b), 0) - 1, 0) + SMOOTH * (max(self.n.get(b, 0) - 1, 0) + 0.5) / (self.total + 1)
        return all(self.weight(a, v) * math.exp(p) * 4 < k for v, p in self.candidates(b).items()) and all(self.weight(v, b) * math.exp(p) * 4 < k for v, p in self.candidates(a).items()) and not self.both(a, b, k / 4)

    def both(self, a: str, b: str, k: float) -> bool:
        """Whether candidates in place of both words reach ``k``. A pair never seen cannot where b's candidate alone does not, and a pair is
        seen no more often than its words."""
        there = self.candidates(b)
        if not there:
            return False
        top = math.exp(max(there.values()))
        for v, p in self.candidates(a).items():
            p = math.exp(p)
            if (self.n.get(v, 0) + 1) * p * top >= k:
                for w, q in there.items():
                    if self.pairs.get((v, w), 0) and self.weight(v, w) * p * math.exp(q) >= k:
                        return True
        return False

    def read(self, line: str) -> tuple[bool, str, bool, list[str], list[int]]:
        """(whether signs show an error, the line without them, whether it ends in a broken word, its tokens, the places of pairs that are not
        safe)."""
        wrong = False
        if "|" in line or "^" in line or "~" in line or "#" in line or "!" in line and _IN_WORD.search(line):
            wrong = True
            line = _IN_WORD_I.sub(lambda m: (m[1] or "") + "i", _ADDED_RE.sub("", line))
        if "!" in line and (mended := self.points(line)) != line:
            wrong, line = True, mended
        end = line.rstrip()
        broken = end[-1:] in _HYPHENS and bool(_BROKEN.search(end[-3:]))
        ts, safe = tokens(end[:-1] if broken else line), self.safe_pairs
        return wrong, line, broken, ts, [i for i, p in enumerate(pairwise(ts)) if not safe[p]]

    def scan(self, line: str) -> tuple[bool, str, bool, list[str], list[int]]:
        """``read``, remembered: answers of several models share most lines."""
        got = self.lines.get(line)
        if got is None:
            if len(self.lines) >= 100_000:
                self.lines.clear()
            got = self.lines[line] = self.read(line)
        return got

    def decode(self, ts: list[str], unsafe: set[int], second: dict[int, str] | None = None) -> dict[int, str]:
        """Where and by what the best path differs from the tokens read (from 1 to the last but one; the outer two are context).

        ``unsafe``: the places of pairs that are not safe. ``second``: what another reader saw at some places; where both saw the
        same, nothing else can win.
        """
        n, out, i = len(ts), {}, 1
        if not unsafe and not second:
            return out
        open_ = [False] * n
        for j in unsafe:
            open_[j] = open_[j + 1] = True
        for k, t in (second or {}).items():
            open_[k] = t != ts[k]
        open_[0] = open_[-1] = False
        while i < n - 1:
            if not open_[i]:
                i += 1
                continue
            j = i
            while open_[j]:
                j += 1
            span = tuple(ts[i - 1 : j + 1])
            others = tuple(second.get(k) for k in range(i, j)) if second else ()
            key = (span, others) if any(others) else span
            best = self.spans.get(key)
            if best is None:
                if len(self.spans) >= 60_000:
                    self.spans.clear()
                best = self.spans[key] = self.viterbi(span, others)
            for k, v in enumerate(best, i):
                if v != ts[k]:
                    out[k] = v
            i = j
        return out

    def viterbi(self, span: tuple[str, ...], others: tuple[str | None, ...] = ()) -> tuple[str, ...]:
        """The best words in place of the inner tokens of a span, between its two outer ones. ``others``: what a second reader saw in
        place of each, if anything: then a word must explain both."""
        paths, before, steps = {span[0]: (0.0, ())}, span[0], self.steps

        def best(v: str, extra: float, as_read: bool) -> tuple[float, tuple[str, ...]]:
            """The best path to v, ties by the words before."""
            top, way = -math.inf, ()
            for a, (s, path) in paths.items():
                if as_read and a == before:
                    x = s + self.step_read(a, v)
                else:
                    x = steps.get((a, v))
                    x = s + (self.step(a, v) if x is None else x)
                if x > top or x == top and path > way:
                    top, way = x, path
            return top + extra, (*way, v)

        for k, t in enumerate(span[1:-1]):
            other = others[k] if others else None
            there = self.candidates(t)
            if other is not None and other not in there:
                there = {**there, other: OTHER}
            now = {t: best(t, 0.0 if other is None or other == t else READER, True)}
            for v, p in there.items():
                now[v] = best(v, p if other is None or other == v else p + READER, False)
            paths, before = now, t
        return best(span[-1], 0.0, True)[1][:-1]

    def is_furniture(self, line: str, after: str | None, own: tuple[str, ...] = ()) -> bool:
        """Whether a line is a running header, a footer or a page number; ``own``: headers of the text's work alone."""
        if own:
            if own not in self.own:
                if len(self.own) >= 1000:
                    self.own.clear()
                self.own[own] = Headers(own)
            if self.own[own].has(line):
                return True
        got = self.furniture.get(line, 0)
        if got == 0 and got is not False:
            if len(self.furniture) >= 200_000:
                self.furniture.clear()
            first = line.lstrip()[:1]
            # numbers, folios and volumes begin with a sign, a digit, a Han character, or with t or p
            word = first.isalpha() and first < "⺀" and first not in "tTpP"
            got = self.furniture[line] = None if not word and _BARE.fullmatch(line) else self._is_furniture(line, word)
        if got is None:  # a bare number may also stand before its unit of measure
            follows = tokens(after)[:1] if after else []
            return not (follows and follows[0] in self.units) and not (_HAN_RE.search(line) and follows and self.pairs.get((line.strip()[-1], follows[0]), 0) > 0.01 * self.n.get(line.strip()[-1], 0))
        return got

    def _is_furniture(self, line: str, word: bool = False) -> bool:
        if not word and (_DECORATED.fullmatch(line) or _FOLIO.fullmatch(line) or _VOLUME.fullmatch(line)):
            return True
        if not 8 <= len(line) <= max(self.headers.longest, 60) or line[0].islower():
            return False
        return bool(_VOLUME_VI.fullmatch(line)) or self.headers.has(line)

    def points(self, line: str) -> str:
        """The line with ! as i where a word with i is likelier."""

        def one(m: re.Match) -> str:
            w, after = m[1].lower(), m[2]
            if w + "i" in self.common:
                if after and (after[0] in ":,;" or after.strip()[:1].islower()):
                    return m[1] + "i" + after
                before = tokens(line[: m.start()])[-1:] or ["."]
                if self.pairs.get((before[0], w + "i"), 0) * math.exp(KNOWN) > self.pairs.get((before[0], w), 0) + 0.02:
                    return m[1] + "i" + after
            return m[0]

        return re.sub(r"([^\W\d_]+)!(?!!)(\s*.|$)", one, line)

    def repair(self, text: str, corrected: str | None = None, join: bool = True, own: tuple[str, ...] = ()) -> tuple[list[tuple[int, str]], str]:
        """The noise of a text, (line from 1, kind), and the text as continuous paragraphs.

        ``corrected``: the same text as a reader corrected it, where there is one; where it has as many characters as the body
        it is a second observation of each of them for the decoder. ``join``: whether the paragraphs are wanted. ``own``: running headers
        of the text's work alone.
        """
        if text == corrected and "\n" not in text and not join:
            return [], text
        lines = plain(text).split("\n")
        noise: list[tuple[int, str]] = []
        body: list[int] = []
        for i, line in enumerate(lines):
            if self.is_furniture(line, lines[i + 1] if i + 1 < len(lines) else None, own):
                noise.append((i + 1, "furniture"))
            elif line and not line.isspace():
                body.append(i)
        ts, owner, pieces, unsafe = ["."], [-1], [], set()
        carry = ""  # the first part of a broken word
        wrong: set[int] = set()
        heads: dict[int, tuple[int, int]] = {}  # token -> line of its first part, that part's length
        for i in body:
            start = len(ts)
            if carry:
                line = lines[i]
                m = re.match(r"\s*[^\W_]+", line)
                if m and not _HAN_RE.search(m[0]):
                    heads[start] = (carried, len(carry))
                bad, line, broken, got, places = self.read(carry + (line.lstrip() if m else line))
                carry = ""
            else:
                bad, line, broken, got, places = self.scan(lines[i])
            if bad:
                wrong.add(i)
            if broken:  # the last token waits for the rest of its word
                noise.append((i + 1, "broken_word"))
                m = _LAST_WORD.search(line.rstrip()[:-1])
                carry, carried, line = m[0], i, line[: m.start()]
                got = got[:-1]
                places = [k for k in places if k < len(got) - 1]
            if got:
                if ts[-1] not in ".:" and bool(_HAN_RE.match(ts[-1])) != bool(_HAN_RE.match(got[0])) and got[0] not in ".:":
                    # Latin and Han lines are not each other's context
                    if not self.safe_pairs[ts[-1], "."]:
                        unsafe.add(start - 1)
                    ts.append(".")
                    owner.append(-1)
                    if start in heads:
                        heads[start + 1] = heads.pop(start)
                    start += 1
                if not self.safe_pairs[ts[-1], got[0]]:
                    unsafe.add(start - 1)
                if places:
                    unsafe.update(start + k for k in places)
                ts += got
                owner += [i] * len(got)
            pieces.append((i, start, line))
        if carry:
            pieces.append((carried, len(ts), carry))
        if not self.safe_pairs[ts[-1], "."]:
            unsafe.add(len(ts) - 1)
        ts.append(".")
        owner.append(-1)
        second = None
        if corrected:
            shown = _HAN_RE.findall(plain(corrected))
            at = [k for k, t in enumerate(ts) if _HAN_RE.match(t)]
            if len(shown) == len(at) and sum(ts[k] != t for k, t in zip(at, shown)) <= max(2, len(at) // 4):
                second = dict(zip(at, shown))
        changed = self.decode(ts, unsafe, second)
        for k, v in changed.items():
            i = owner[k]
            if i < 0:
                continue
            if k in heads:
                first, size = heads[k]
                same = next((x for x, (a, b) in enumerate(zip(ts[k], v)) if a != b), min(len(ts[k]), len(v)))
                if same < size:
                    wrong.add(first)
                    continue
            wrong.add(i)
        noise += [(i + 1, "misread") for i in wrong]
        return noise, self.paragraphs(pieces, changed) if join else ""

    def paragraphs(self, pieces: list[tuple[int, int, str]], changed: dict[int, str]) -> str:
        """The body's lines with the best path's words, joined: Latin text by blanks, Han text by nothing."""
        out = ""
        for _, start, line in pieces:
            found, at, made = list(_TOKEN.finditer(line.lower())) if len(line.lower()) == len(line) else [], 0, ""
            for k, m in enumerate(found):
                v = changed.get(start + k)
                if v is not None:
                    v = v.capitalize() if line[m.start()].isupper() else v
                    made += line[at : m.start()] + v
                    at = m.end()
            made = (made + line[at:]).strip(" ")
            glue = "" if not out or not made or (_HAN_RE.match(out[-1]) or out[-1] in "。，、○」』）") and (_HAN_RE.match(made[0]) or made[0] in "。，、○「『（") else " "
            out += glue + made
        return out


def _work(df: DataFrame, name: str):
    """What names a text's work; all texts of a table without such a column are of one work."""
    return F.lower(F.trim(F.coalesce(F.col(name), F.lit("")))) if name in df.columns else F.lit("")


def _page(df: DataFrame, name: str):
    return F.col(name).cast("long") if name in df.columns else F.lit(None).cast("long")


def _read_well():
    return F.coalesce(F.regexp_replace("error", r"[\s\x{A0}\x{3000}]+", ""), F.lit("")) == ""


def texts(records: DataFrame, ocr_results: DataFrame) -> DataFrame:
    """(table_name, row_id, field_name, text, corrected, work): records.han_raw, records.meaning and ocr_results.text, the latter without rows whose error is not blank."""
    none = F.lit(None).cast("string")
    pair = F.explode(F.array(F.struct(F.lit("han_raw").alias("field_name"), F.col("han_raw").alias("text"), F.nullif(F.col("han"), F.lit("")).alias("corrected")), F.struct(F.lit("meaning").alias("field_name"), F.col("meaning").alias("text"), none.alias("corrected"))))
    a = records.select(F.lit("records").alias("table_name"), "row_id", pair.alias("x"), _work(records, "source_doc").alias("work")).select("table_name", "row_id", "x.*", "work")
    b = ocr_results.where(_read_well()).select(F.lit("ocr_results").alias("table_name"), "row_id", F.lit("text").alias("field_name"), "text", none.alias("corrected"), _work(ocr_results, "doc_id").alias("work"))
    return a.unionByName(b).where("text <> ''")


def work_headers(counted: DataFrame) -> DataFrame:
    """(a, work, n): shapes that are running headers of a work, by that work's own pages and texts."""
    n = counted.where("kind = 't'").select(F.col("b").alias("work"), F.col("n").alias("texts"))
    at = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")))
    x = counted.where("kind in ('e', 'a')").groupBy("a", F.col("b").alias("work")).agg(at("e").alias("n"), at("a").alias("anywhere"), F.max(F.bit_count("pages")).alias("pages"))
    x = x.where((F.col("pages") >= LEAST_PAGES) & (F.col("n") >= AT_EDGE * F.col("anywhere")))
    return x.join(n, "work").where(F.col("n") >= WORK_SHARE * F.col("texts")).select("a", "work", "n")


def fit(records: DataFrame, ocr_results: DataFrame):
    """(broadcast of the channel's counts over all rows, headers of single works). The broadcast has at most 1 / PAIR_SHARE pairs and
    tokens each, the confusions of Han characters, and 1 / SHAPE_SHARE header shapes. Where there are more pairs or tokens, those under
    PAIR_SHARE go to a file. Headers of single works, (work, own), are a table; None where there are none."""
    none = F.lit(None).cast("string")
    a = records.select("han", F.col("meaning").alias("shown"), F.when(F.col("han_raw") != F.col("han"), F.col("han_raw")).alias("read"), _work(records, "source_doc").alias("work"), _page(records, "page").alias("page"))
    b = ocr_results.where(_read_well()).select(none.alias("han"), F.col("text").alias("shown"), none.alias("read"), _work(ocr_results, "doc_id").alias("work"), _page(ocr_results, "page_no").alias("page"))
    from vellum.tables import written

    counted = written(count(a.unionByName(b)), "scan-counts")
    # every token follows one other
    words_ = counted.where("kind = 'p'").groupBy("b").agg(F.sum("n").alias("n")).select(F.lit("w").alias("kind"), F.col("b").alias("a"), F.lit("").alias("b"), "n", F.lit(0).cast("long").alias("pages"))
    all_words = counted.where("kind in ('p', 'c')").unionByName(words_)
    sums = counted.groupBy("kind").agg(F.sum("n"), F.count("*")).collect()
    all_ = {r[0]: r[1] for r in sums}
    whole = all(r[2] <= 1 / PAIR_SHARE for r in sums if r[0] == "p")
    word = F.col("kind").isin("p", "w")
    often = F.lit(True)
    if not whole:  # as many tokens as pairs; what the channel picks from all of them is never rare
        numbers = words_.where("a = '0'").agg(F.sum("n")).collect()[0][0] or 0
        often = (F.col("n") >= all_["p"] * PAIR_SHARE) | ((F.col("kind") == "w") & (F.col("n") >= max(3, COMMON * all_["p"]))) | ((F.col("kind") == "p") & (F.col("a") == "0") & (F.col("n") > UNIT * numbers))
    some = all_words.where((word & often) | (F.col("kind") == "c")).collect()
    rare = None if whole else rare_file(all_words.where(word & ~often))
    pairs = {(r.a, r.b): r.n for r in some if r.kind == "p"}
    words = {r.a: r.n for r in some if r.kind == "w"}
    confused = {(r.a, r.b): r.n for r in some if r.kind == "c"}
    found = written(work_headers(counted), "work-headers")
    everywhere = found.groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= SHAPE_SHARE * all_.get("t", 0)).select("a")  # 1 / SHAPE_SHARE at most
    headers = sorted(r.a for r in everywhere.collect())
    own = found.where(~F.col("a").isin(headers)) if headers else found
    own = own.groupBy("work").agg(F.sort_array(F.collect_list("a")).alias("own"))  # fewer than the work has pages
    return records.sparkSession.sparkContext.broadcast((pairs, words, all_.get("p", 0), confused, headers, rare)), None if own.isEmpty() else written(own, "own-headers")


FIELDS = (("records", "han_raw"), ("records", "meaning"), ("ocr_results", "text"))


def _run(fitted, df: DataFrame, join: bool, schema: str, make) -> DataFrame:
    shared, own = fitted

    def run(batches):
        channel = codes.once(shared, Channel)
        with uncollected():
            for b in batches:
                rows, seen = [], {}  # an answer given twice is read once
                for what, row, text, corrected, own in zip(*(b.column(i).to_pylist() for i in range(5))):
                    own = tuple(own or ())
                    if what == 0:
                        got = channel.repair(text, corrected, join, own)
                    elif (got := seen.get((text, own))) is None:
                        got = seen[text, own] = channel.repair(text, None, join, own)
                    rows += make(*FIELDS[what], row, *got)
                cols = list(map(list, zip(*rows))) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    names = [x.strip().split()[0] for x in schema.split(",")]
    types = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[x.strip().split()[1]] for x in schema.split(",")]
    if own is None:
        df = df.withColumn("own", F.lit(None).cast("array<string>"))
    else:
        df = df.join(F.broadcast(own) if own.count() <= BROADCAST_WORKS else own, "work", "left")
    what = F.when(F.col("field_name") == "han_raw", 0).when(F.col("field_name") == "meaning", 1).otherwise(2)
    return df.select(what.alias("what"), "row_id", "text", "corrected", "own").mapInArrow(run, schema)


def noise(records: DataFrame, ocr_results: DataFrame) -> DataFrame:
    """(table_name, row_id, field_name, line_no, noise) of every disturbed line, each once.

    Null and empty texts have no lines. Two passes over the texts: one counts, one decodes; a row's text is decoded
    whole. Texts of any length are read once, and only spans of words that some candidate could replace are searched.
    """
    shared = fit(records, ocr_results)

    def make(table, field, row, noise, text):
        return [(table, row, field, line, kind) for line, kind in set(noise)]

    # one line that a reader left as it was is seen alike twice: no candidate can win
    x = texts(records, ocr_results).where(~F.coalesce((F.col("text") == F.col("corrected")) & ~F.col("text").contains("\n"), F.lit(False)))
    found = _run(shared, x, False, "table_name string, row_id long, field_name string, line_no int, noise string", make)
    return found.distinct()


def repaired(records: DataFrame, ocr_results: DataFrame) -> DataFrame:
    """(table_name, row_id, field_name, repaired): continuous paragraphs without furniture, broken words and misread characters."""
    shared = fit(records, ocr_results)

    def make(table, field, row, noise, text):
        return [(table, row, field, text)]

    return _run(shared, texts(records, ocr_results), True, "table_name string, row_id long, field_name string, repaired string", make)
