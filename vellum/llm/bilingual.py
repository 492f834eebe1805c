"""Pairs of units that render one another in two languages.

Terms of both languages get vectors in one space by singular value decomposition of how they occur in paired documents. Units are
matched by margin-scored mutual coverage; windows of merged or divided units grow by what is not covered yet, in any order.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import codes
from vellum.llm.scans import mends, plain
from vellum.llm.sentences import ABBREVIATIONS, TITLES, units
from vellum.tables import written

#: A term is kept if it is in this share of the documents that have both sides. A document of n terms has at most n of them, so
#: at most n / TERM_SHARE terms are kept, n the mean number of terms of a document.
TERM_SHARE = 0.003
#: Dimensions of the vectors; cosine from which a term renders another; least characters and words of a pair's own, unless they are
#: most of a unit.
RANK, RENDERS, OWN, MOST = 300, 0.55, 3, 0.6
#: Columns of a page that are aligned in one step; of a longer page, every half of so many columns meets every other.
PAGE_COLUMNS = 512

_HAN = "㐀-鿿豈-﫿\U00020000-\U0003ffff"
_HAN_RE = re.compile(f"[{_HAN}]")
_WORD = re.compile(rf"[^\W\d_{_HAN}]+|\d+")
_JOIN = re.compile(r"([^\W\d_])[-¬=­]\s*\n\s*")
_QUOTES = re.compile(r"“[^”]*”|‘[^’]*’|«[^»]*»|\"[^\"]*\"|「[^「」]*」|『[^『』]*』")
_NOTES = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|（[^（）]*）")
_ANY_QUOTE = re.compile("[“‘«\"「『]")
_MASK = str.maketrans({c: "\x01" for c in "。．.○？！!?…"})
_MASK_NOTE = str.maketrans({c: "\x02" for c in "。．.○？！!?…"})
# a stop comes first in each pattern, so that what is before it is looked at only there
_DECIMAL = re.compile(r"\.(?<=\d\.)(?=\d)")
_ABBREVIATED = regex.compile(rf"(?<=(?<!\p{{L}})(?:{ABBREVIATIONS}))\.(?=\s?[\p{{Ll}}0-9(,;:])|(?<=(?<!\p{{L}})(?:{TITLES}))\.(?=\s?\p{{Lu}})|(?<=(?<!\p{{L}})\p{{Lu}})\.(?=\s?\p{{Lu}})|(?<=(?<!\p{{L}})v)\.(?=v(?!\p{{L}}))|(?<=(?<!\p{{L}})v\x03v)\.(?=\s*[,;:\p{{Ll}}])|(?<=(?<!\p{{L}})v\.v)\.(?=\s*[,;:\p{{Ll}}])")


def _short() -> re.Pattern:
    """A stop after a single letter or one of the abbreviations: whether the pattern above is needed. Words go by length, as a built-in
    pattern looks back over a fixed length only."""
    by: dict[int, list[str]] = {}
    for w in sorted({*ABBREVIATIONS.split("|"), *TITLES.split("|")}):
        by.setdefault(len(w), []).append(w)
    long = [rf"(?<=(?<![^\W\d_])(?:{'|'.join(ws)})\.)" for n, ws in sorted(by.items()) if n > 1]
    return re.compile(r"\.(?:(?<=(?<![^\W\d_])[^\W\d_]\.)|" + "|".join(long) + ")")


_SHORT = _short()
_END = re.compile(r"[.!?…]+[”’»\")\]]*(?=\s|$)")
_END_QUOTED = re.compile(r"[.!?…]+[”’»\")\]]*(?=\s|$)|(?<=\x01)[”’»\"](?=\s|$)")


def latin_ends(text: str) -> list[tuple[int, int]]:
    """(start, last) of the units of a Latin text: those of sentences.units, without Spark; the tests compare both."""
    s = _DECIMAL.sub("\x03", text)
    if "(" in s or "[" in s or "（" in s:
        s = _NOTES.sub(lambda m: m[0].translate(_MASK_NOTE), s)
    if _ANY_QUOTE.search(s):
        s = _QUOTES.sub(lambda m: m[0][0] + m[0][1:-1].translate(_MASK) + m[0][-1], s)
    if _SHORT.search(s):
        s = _ABBREVIATED.sub("\x03", s)
    out, at, n = [], 0, len(s)
    for m in (_END_QUOTED if "\x01" in s else _END).finditer(s):
        end = after = m.end()
        while after < n and s[after].isspace():
            after += 1
        if after < n:
            c = s[after]
            if s[m.start()] in ".!?…":
                if c.islower():
                    continue
            elif not (c.isupper() or c.isdigit()):
                continue
        start = at
        while text[start].isspace():
            start += 1
        if start < end:
            out.append((start, end - 1))
        at = end
    rest = len(text[at:].rstrip())
    if rest:
        start = at
        while text[start].isspace():
            start += 1
        out.append((start, at + rest - 1))
    return out


def mended(text: str) -> str:
    """A text without what problem 5 mends and with the words whole that a line's end divides."""
    text = plain(text)
    return _JOIN.sub(r"\1", text) if "\n" in text else text


#: A document as numbers: the tokens of its units on either side, the lengths of the units (none is empty), and what names each unit.
#: Numbers are packed (int32, tags int64), so that a document is a few values for the JVM and not hundreds.
CODED = "doc long, a binary, a_len binary, a_tag binary, b binary, b_len binary, b_tag binary"
_NAMES = [x.split()[0] for x in CODED.split(", ")]
#: Elements of one step over a batch; bounds the memory of a task.
STEP = 3_000_000


def _coded(units_: list[str], of: np.ndarray, tags: list[int], documents: int, han: bool) -> list[pa.Array]:
    """(tokens, lengths of the units, tags) of each document, packed, from the texts of all units and the document ``of`` each. A word's
    number is the same in every task. Units without tokens are left out."""
    number, unit = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in codes.steps(units_):
        n, u, _ = codes.tokens(units_[i:j], digits=True)
        right = codes.is_han(n) == han
        number.append(n[right])
        unit.append(u[right] + i)
    number, unit = np.concatenate(number), np.concatenate(unit)
    sizes = np.bincount(unit, minlength=len(units_))
    kept = sizes > 0
    doc = of[kept]
    tokens_ = (number & 0x7FFFFFFF).astype("<i4")
    return [
        _binary(tokens_, np.bincount(of[unit], minlength=documents)),
        _binary(sizes[kept].astype("<i4"), np.bincount(doc, minlength=documents)),
        _binary(np.array(tags, "<i8")[kept], np.bincount(doc, minlength=documents)),
    ]


def _binary(numbers: np.ndarray, many: np.ndarray) -> pa.Array:
    """Numbers as binary values, so many for each row."""
    ends = np.append(0, np.cumsum(many)) * numbers.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(many), [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(numbers.tobytes())])


def _unpacked(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a packed column, and how many each row has."""
    if column.null_count or column.type != pa.binary():
        column = column.cast(pa.binary()).fill_null(b"")
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, "<i4")[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    numbers = np.frombuffer(data[int(ends[0]) : int(ends[-1])] if data else b"", kind).astype(np.int64)
    return numbers, np.diff(ends).astype(np.int64) // np.dtype(kind).itemsize


class Side:
    """One side of a batch of coded documents as flat arrays."""

    def __init__(self, tokens: pa.Array, sizes: pa.Array):
        self.tokens, self.doc_tokens = _unpacked(tokens, "<i4")
        self.sizes, self.doc_units = _unpacked(sizes, "<i4")
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.unit_at = np.cumsum(self.doc_units) - self.doc_units  # first unit of each document
        self.token_at = np.cumsum(self.doc_tokens) - self.doc_tokens
        ends = np.zeros(len(self.tokens), bool)
        ends[self.starts + self.sizes - 1] = True
        # a term is a token or a pair of neighbours within a unit; -1 where there is no pair
        self.pairs = np.full(len(self.tokens), -1, np.int64)
        self.pairs[:-1] = np.where(ends[:-1], -1, ((self.tokens[:-1] + 1) << 32) | self.tokens[1:]) if len(self.tokens) > 1 else self.pairs[:-1]

    def ids(self, known: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Places among the sorted known terms; their number for unknown ones."""
        if not len(known):
            return np.zeros(len(terms), np.int64)
        at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
        return np.where(known[at] == terms, at, len(known))


def _sides(b: pa.RecordBatch) -> tuple[Side, Side]:
    c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
    return Side(c["a"], c["a_len"]), Side(c["b"], c["b_len"])


def fit(coded: DataFrame):
    """The similarities of the terms of both sides over all coded documents, as a broadcast.

    Two passes over numbers. The first counts terms; the second adds up, for each task, one matrix of how often two of the terms that
    could be kept share a document, a document counting for 1 over its number of terms, and in how many documents each is; those in
    fewer than TERM_SHARE of them are then dropped. Matrices are summed by row of the matrix, so the
    shuffle depends on tasks and terms and not on rows. The decomposition is of one matrix of kept terms, whose number
    TERM_SHARE bounds.
    """
    spark = coded.sparkSession
    coded = coded.select("a", "a_len", "b", "b_len").where("length(a) > 0 and length(b) > 0")

    def count(batches):
        for b in batches:
            if not b.num_rows:
                continue
            out = [("n", np.array([0]), np.array([b.num_rows]))]
            for name, side in zip("ab", _sides(b)):
                codes, found = pd.factorize(np.concatenate([side.tokens, side.pairs[side.pairs >= 0]]))
                out.append((name, found, np.bincount(codes)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out]).tolist()), pa.array(np.concatenate([o[1] for o in out])), pa.array(np.concatenate([o[2] for o in out]))], ["side", "term", "n"])

    counted = coded.mapInArrow(count, "side string, term long, n long").groupBy("side", "term").agg(F.sum("n").alias("n"))
    counted = written(counted, "term-counts")
    docs = counted.where("side = 'n'").agg(F.sum("n")).collect()[0][0] or 0
    kept = counted.where((F.col("side") != "n") & (F.col("n") >= max(2.0, TERM_SHARE * docs))).collect()
    left, right = (np.array(sorted(r.term for r in kept if r.side == side), np.int64) for side in "ab")
    if not len(left) or not len(right):
        return spark.sparkContext.broadcast((left, right, np.zeros((len(left) + 1, len(right) + 1), bool)))
    known = spark.sparkContext.broadcast((left, right))

    def together(batches):
        left, right = known.value
        c = np.zeros((len(left) + 1, len(right) + 1), np.float32)  # the last row and column hold sums
        within = [np.zeros(len(t) + 1, np.float32) for t in (left, right)]  # documents with each term
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                m = []
                for side, terms in zip(_sides(part), (left, right)):
                    x = np.zeros((part.num_rows, len(terms) + 1), np.float32)
                    doc = np.repeat(np.arange(part.num_rows), side.doc_tokens)
                    x[doc, side.ids(terms, side.tokens)] = 1
                    x[doc, side.ids(terms, side.pairs)] = 1
                    x[:, -1] = 1
                    m.append(x)
                for w, x in zip(within, m):
                    w += x.sum(0)
                m[0] *= 30 / np.maximum(10, m[0].sum(1, keepdims=True))
                c += m[0].T @ m[1]
        yield pa.RecordBatch.from_arrays([pa.array(range(-2, len(c)), pa.int32()), pa.array([r.tobytes() for r in (*within, *c)], pa.binary())], ["i", "row"])

    def add(batches):
        rows: dict[int, np.ndarray] = {}
        for b in batches:
            for i, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.frombuffer(r, np.float32).astype(np.float64)
                rows[i] = rows[i] + v if i in rows else v
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array([r.astype(np.float32).tobytes() for r in rows.values()], pa.binary())], ["i", "row"])

    parts = coded.mapInArrow(together, "i int, row binary").repartition(8, "i").mapInArrow(add, "i int, row binary")
    c, within = np.zeros((len(left) + 1, len(right) + 1)), {}
    for r in parts.collect():  # a row for each term
        if r.i < 0:
            within[r.i] = np.frombuffer(r.row, np.float32)
        else:
            c[r.i] = np.frombuffer(r.row, np.float32)
    keep = [np.append(within[k][:-1] >= max(2.0, TERM_SHARE * docs), True) for k in (-2, -1)]
    c, left, right = c[keep[0]][:, keep[1]], left[keep[0][:-1]], right[keep[1][:-1]]
    return spark.sparkContext.broadcast((left, right, similarities(c) >= RENDERS))


def similarities(c: np.ndarray) -> np.ndarray:
    """Cosines of the terms' vectors, from the matrix of shared documents with sums in the last row and column; the last row and
    column of the result are zero and stand for unknown terms."""
    total, px, py, c = c[-1, -1], c[:-1, -1], c[-1, :-1], c[:-1, :-1]
    expected = np.outer(px, py) / max(total, 1e-9)
    weight = np.maximum(np.log(np.maximum(c, 1e-9) / np.maximum(expected, 1e-9)) - 0.3, 0) * np.sqrt(c / (c + 1))
    u, s, vt = np.linalg.svd(weight, full_matrices=False)
    r = min(RANK, len(s))
    a, b = u[:, :r] * np.sqrt(s[:r]), vt[:r].T * np.sqrt(s[:r])
    a /= np.linalg.norm(a, axis=1, keepdims=True) + 1e-9
    b /= np.linalg.norm(b, axis=1, keepdims=True) + 1e-9
    out = np.zeros((len(a) + 1, len(b) + 1), np.float32)
    out[:-1, :-1] = a @ b.T
    return out


def _packed(renders: np.ndarray) -> np.ndarray:
    """Rows of bits in words of 64."""
    words_ = (renders.shape[1] >> 6) + 1
    bits = np.zeros((len(renders), words_ * 64), np.uint8)
    bits[:, : renders.shape[1]] = renders
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


class Aligner:
    """Pairs of units of coded documents, a batch at a time."""

    def __init__(self, left: np.ndarray, right: np.ndarray, renders: np.ndarray):
        self.left, self.right = left, right
        self.rows, self.columns = _packed(renders), _packed(np.ascontiguousarray(renders.T))

    @staticmethod
    def _covered(own: Side, rows: np.ndarray, ids: tuple, other: Side, other_ids: tuple, none: int):
        """For each unit of ``own`` and token of ``other`` of a document, in this order: whether a term of the unit renders the token or a pair it
        is in."""
        cover = np.bitwise_or.reduceat(rows[ids[0]] | rows[ids[1]], own.starts, axis=0)
        width = cover.shape[1]
        sizes = own.doc_units * other.doc_tokens
        first = np.cumsum(sizes) - sizes
        out = np.zeros(sizes.sum(), bool)
        # the known terms of the other side's tokens, by token; every unit of a document meets each of the document's
        terms = np.stack(other_ids, axis=1).ravel()
        known = np.flatnonzero(terms < none)
        terms, token = terms[known], known // len(other_ids)
        ends = np.searchsorted(token, np.append(other.token_at, len(other.tokens)))
        many = np.diff(ends)
        unit = np.repeat(np.arange(len(own.sizes)), np.repeat(many, own.doc_units))
        doc = np.repeat(np.arange(len(sizes)), own.doc_units * many)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(own.doc_units * many) - own.doc_units * many, own.doc_units * many)
        at = ends[doc] + at % np.maximum(many, 1)[doc]
        x = terms[at]
        hit = np.flatnonzero(cover.ravel()[unit * width + (x >> 6)] >> (x & 63).astype(np.uint64) & np.uint64(1))
        doc = doc[hit]
        out[first[doc] + (unit[hit] - own.unit_at[doc]) * other.doc_tokens[doc] + token[at[hit]] - other.token_at[doc]] = True
        return out, first

    @staticmethod
    def _with_before(side: Side, ids: np.ndarray, none: int) -> np.ndarray:
        """The pair that ends at each token."""
        out = np.full(len(ids), none, np.int64)
        out[1:] = ids[:-1]
        out[side.starts] = none
        return out

    @staticmethod
    def _sums(a: Side, o: Side, on_a: np.ndarray, on_o: np.ndarray, first: np.ndarray, doc: np.ndarray, i: np.ndarray, j: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many tokens of either unit of each pair are covered."""
        seg = o.sizes[v]
        co = np.add.reduceat(on_o, np.cumsum(seg) - seg, dtype=np.int64)
        turned = np.argsort(first[doc] + j * a.doc_units[doc] + i, kind="stable")  # by unit of b
        seg = a.sizes[u[turned]]
        ch = np.empty(len(doc), np.int64)
        ch[turned] = np.add.reduceat(on_a, np.cumsum(seg) - seg, dtype=np.int64)
        return ch, co

    def _both(self, a: Side, o: Side):
        """What units of a cover in b and of b in a, and where each document's part starts."""
        a1, a2 = a.ids(self.left, a.tokens), a.ids(self.left, a.pairs)
        o1, o2 = o.ids(self.right, o.tokens), o.ids(self.right, o.pairs)
        a0, o0 = self._with_before(a, a2, len(self.left)), self._with_before(o, o2, len(self.right))
        return *self._covered(a, self.rows, (a1, a2), o, (o1, o2, o0), len(self.right)), *self._covered(o, self.columns, (o1, o2), a, (a1, a2, a0), len(self.left))

    def tile(self, b: pa.RecordBatch):
        """Of one document with units on both sides: (covered characters and words of each pair of units, tokens of a covered by each unit
        of b, tokens of b covered by each unit of a, lengths of the units)."""
        a, o = _sides(b)
        on_o, _, on_a, _ = self._both(a, o)
        shape = (len(a.sizes), len(o.sizes))
        i, j = (x.ravel() for x in np.indices(shape))
        none = np.zeros(len(i), np.int64)
        ch, co = self._sums(a, o, on_a, on_o, none[:1], none, i, j, i, j)
        return ch.reshape(shape), co.reshape(shape), on_a.reshape(shape[1], -1), on_o.reshape(shape[0], -1), a.sizes, o.sizes

    def pairs(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, unit of a, unit of b), the units as places in the batch, for units of which one renders the other wholly or in part."""
        a, o = _sides(b)
        none = np.zeros(0, np.int64)
        if not len(a.tokens) or not len(o.tokens):
            return none, none, none
        on_o, o_at, on_a, a_at = self._both(a, o)
        # every pair of units of a document: n of them from place ``first``, by unit of a
        n = a.doc_units * o.doc_units
        first = np.cumsum(n) - n
        doc = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(doc)) - first[doc]
        i, j = at // o.doc_units[doc], at % o.doc_units[doc]
        u, v = a.unit_at[doc] + i, o.unit_at[doc] + j
        if not len(doc):
            return none, none, none
        ch, co = self._sums(a, o, on_a, on_o, first, doc, i, j, u, v)
        la = a.sizes[u]
        good = _enough(ch, co, la, o.sizes[v])
        single = n[doc] == 1
        good = np.where(single, (ch >= np.maximum(2, 0.25 * la)) | (ch >= la), good)
        # documents in which all pairs are mutual nearest neighbours need no search
        dice = (ch + co) / (la + o.sizes[v])
        turned = np.argsort(v, kind="stable")
        near, back = _near(dice, u), np.empty(len(v), np.int64)
        back[turned] = np.arange(len(v))
        near_v = _near(dice[turned], v[turned])[back]
        score = _margin(dice, near, near_v)
        mutual = (score >= _tops(score, u)) & (score >= _tops(score[turned], v[turned])[back])
        unclear = np.zeros(len(n), bool)
        unclear[doc[good & ~mutual & ~single]] = True
        for unit, units_ in ((u, len(a.sizes)), (v, len(o.sizes))):  # ties
            many = np.bincount(unit[good], minlength=units_) > 1
            unclear[doc[many[unit]]] = True
        good &= ~unclear[doc]
        for d in np.flatnonzero(unclear):
            k = slice(first[d], first[d] + n[d])
            shape = (a.doc_units[d], o.doc_units[d])
            sa = slice(a.unit_at[d], a.unit_at[d] + shape[0])
            so = slice(o.unit_at[d], o.unit_at[d] + shape[1])
            oa = on_a[a_at[d] : a_at[d] + shape[1] * a.doc_tokens[d]].reshape(shape[1], -1)
            oo = on_o[o_at[d] : o_at[d] + shape[0] * o.doc_tokens[d]].reshape(shape[0], -1)
            good[k] = _search(score[k].reshape(shape), ch[k].reshape(shape), co[k].reshape(shape), oa, oo, a.sizes[sa], o.sizes[so]).ravel()
        return doc[good], u[good], v[good]


def _enough(ch: np.ndarray, co: np.ndarray, la: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Whether so many characters and words make a pair of units of these lengths."""
    return (ch >= 2) & (co >= 2) & (((ch >= OWN) & (co >= OWN)) | (ch >= MOST * la) | (co >= MOST * lo))


def _tops(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The largest of each run of ``of``, for each of its members."""
    new = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    return np.repeat(np.maximum.reduceat(values, new), np.diff(np.append(new, len(of))))


def _near(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The mean of the two largest of each run of ``of``, or of the one there is."""
    top = _tops(values, of)
    place = np.arange(len(of))
    first = -_tops(np.where(values == top, -place, -len(of) - 1), of)  # where it is
    second = _tops(np.where(place == first, -1.0, values), of)
    return np.where(second < 0, top, (top + second) / 2)


def _margin(dice: np.ndarray, near_a: np.ndarray, near_b: np.ndarray) -> np.ndarray:
    """What two units share, against what either shares with its nearest neighbours."""
    return dice * 2 * dice / (near_a + near_b + 1e-6)


def _search(score: np.ndarray, ch: np.ndarray, co: np.ndarray, on_a: np.ndarray, on_o: np.ndarray, la: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Which pairs of one document's units hold: by margin over each unit's nearest neighbours, best first; a pair needs characters and words
    of its own, that is such as no pair before it has covered, so that windows grow where units were merged or divided, in any order."""
    out = np.zeros(score.shape, bool)
    at = np.flatnonzero((ch >= 2) & (co >= 2))
    at = at[np.argsort(-score.ravel()[at], kind="stable")]
    bits = lambda m: [int.from_bytes(r.tobytes(), "little") for r in np.packbits(m, axis=1, bitorder="little")]
    by_b, by_a = bits(on_a), bits(on_o)
    sa, so = ([((1 << n) - 1) << k for n, k in zip(sizes.tolist(), (np.cumsum(sizes) - sizes).tolist())] for sizes in (la, lo))
    la, lo, width = la.tolist(), lo.tolist(), score.shape[1]
    free_a, free_o = (1 << sum(la)) - 1, (1 << sum(lo)) - 1
    for k in at.tolist():
        i, j = divmod(k, width)
        ma, mo = by_b[j] & sa[i], by_a[i] & so[j]
        ga, go = (ma & free_a).bit_count(), (mo & free_o).bit_count()
        if (ga >= OWN and go >= OWN) or (ga >= MOST * la[i] and go >= 2) or (go >= MOST * lo[j] and ga >= 2):
            out[i, j] = True
            free_a &= ~ma
            free_o &= ~mo
    return out


def align(coded: DataFrame, shared) -> DataFrame:
    """(doc, a_tag, b_tag) of the pairs of units of coded documents. One narrow pass; a batch goes in steps of bounded size."""

    def run(batches):
        aligner = codes.once(shared, Aligner)
        for b in batches:
            ta, ua, tb, ub = (pa.compute.binary_length(b.column(k)).to_numpy(zero_copy_only=False).astype(np.int64) // 4 for k in (1, 2, 4, 5))
            work = np.cumsum(ta * ub + tb * ua + 1)
            at = 0
            while at < b.num_rows:
                upto = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + STEP)))
                part = b.slice(at, upto - at)
                at = upto
                doc, u, v = aligner.pairs(part)
                tags = [_unpacked(part.column(k), "<i8")[0] for k in (3, 6)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(tags[0][u]), pa.array(tags[1][v])], ["doc", "a_tag", "b_tag"])

    return coded.select(*_NAMES).where("length(a) > 0 and length(b) > 0").mapInArrow(run, "doc long, a_tag long, b_tag long")


def coded_records(records: DataFrame) -> DataFrame:
    """Records with both sides as coded documents; a unit's tag is its end. Han units are cut in SQL."""
    rows = records.where("han <> '' and meaning <> ''")
    x = rows.select("row_id", "han", "meaning", F.transform(units(F.col("han")), lambda u: F.array(u["start"], u["last"])).alias("units"))

    def run(batches):
        for b in batches:
            sides = [([], [], []), ([], [], [])]  # texts of units, their documents, their tags
            for doc, (han, meaning, us) in enumerate(zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))):
                for (texts, of, tags), text, ends in ((sides[0], han, us), (sides[1], meaning, latin_ends(meaning))):
                    made = [text[i : j + 1] for i, j in ends]
                    # texts with nothing to mend need no look at each unit
                    texts += map(mended, made) if "\n" in text or mends(text) else made
                    of += [doc] * len(made)
                    tags += [j for _, j in ends]
            made = [_coded(texts, np.array(of, np.int64), tags, b.num_rows, k == 0) for k, (texts, of, tags) in enumerate(sides)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made[0], *made[1]], _NAMES)

    return x.mapInArrow(run, CODED)


def record_pairs(records: DataFrame) -> DataFrame:
    """(table_name, row_id, han_end, other_row_id, other_end) of records: units of han and meaning that render one another.

    Rows with a null or empty side have no pairs. Texts are read once and written as numbers; a row is aligned for itself, one with more than
    PAGE_COLUMNS² pairs of units in tiles like a long page.
    """
    coded = written(coded_records(records), "coded-records")
    shared = fit(coded)
    units_ = lambda c: F.length(c) / 4
    long = coded.where(units_("a_len") * units_("b_len") > PAGE_COLUMNS**2)
    found = align(coded.where(units_("a_len") * units_("b_len") <= PAGE_COLUMNS**2), shared)
    if not long.isEmpty():
        found = found.unionByName(long_pages(apart(long.dropDuplicates(["doc"])), shared).select(F.col("page").cast("long").alias("doc"), "a_tag", "b_tag"))
    return found.select(F.lit("records").alias("table_name"), F.col("doc").alias("row_id"), F.col("a_tag").cast("int").alias("han_end"), F.col("doc").alias("other_row_id"), F.col("b_tag").cast("int").alias("other_end"))


def apart(coded: DataFrame) -> DataFrame:
    """The units of coded documents as columns of a page each, for ``long_pages``: (doc, a, …, b_tag, page, n)."""

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                part = b.slice(at, 1)
                page, out = str(part.column(0)[0].as_py()), []
                for k in (1, 4):
                    tokens_, sizes, tags = (_unpacked(part.column(k + i), t)[0] for i, t in enumerate(("<i4", "<i4", "<i8")))
                    one = np.ones(len(sizes), np.int64)
                    made = [_binary(tokens_.astype("<i4"), sizes), _binary(sizes.astype("<i4"), one), _binary(tags.astype("<i8"), one)]
                    none = [pa.array([b""] * len(sizes), pa.binary())] * 3
                    out.append((len(sizes), [*made, *none] if k == 1 else [*none, *made]))
                n = max(x[0] for x in out)
                for many, columns in out:
                    yield pa.RecordBatch.from_arrays([pa.array(range(many), pa.int64()), *columns, pa.array([page] * many, pa.string()), pa.array([n] * many, pa.int64())], [*_NAMES, "page", "n"])

    return coded.select(*_NAMES).mapInArrow(run, CODED + ", page string, n long")


def _joined(name: str):
    """A packed column of all members of ``c``, one after the other."""
    return F.aggregate(F.col(f"c.{name}"), F.lit(b""), lambda x, y: F.concat(x, y)).alias(name)


def long_pages(columns: DataFrame, shared) -> DataFrame:
    """(page, a_tag, b_tag) of the pairs of columns of pages of more than PAGE_COLUMNS; ``columns`` are coded, with their page's ``n``.

    Blocks of columns of either side meet each other block of the other side in a tile of bounded size, so every column meets
    every other and a page is spread over all tasks. A tile yields the pairs that could hold with what they cover, and each
    column's two nearest neighbours; the latter make the margins of the whole page. One task then decides a page's pairs, best
    first, as ``_search`` does; they stream through it in order, and it keeps a number for each column that has a pair. The
    work grows with the square of a page's columns.
    """
    spark = columns.sparkSession
    x = columns.withColumn("blocks", F.ceil(F.col("n") / max(1, PAGE_COLUMNS // 2))).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")))

    def side(k: str) -> DataFrame:
        names = [k, f"{k}_len", f"{k}_tag"]
        c = x.where(F.length(k) > 0).groupBy("page", "blocks", "block").agg(F.sort_array(F.collect_list(F.struct("doc", *names))).alias("c"))
        return c.select("page", "blocks", F.col("block").alias(f"{k}_block"), *map(_joined, names))

    tiles = side("a").withColumn("b_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(side("b").drop("blocks"), ["page", "b_block"])
    tiles = tiles.repartition(4 * spark.sparkContext.defaultParallelism, "page", "a_block", "b_block").select("page", "a", "a_len", "a_tag", "b", "b_len", "b_tag")
    bits = lambda m: np.packbits(m, bitorder="little").tobytes()

    def run(batches):
        aligner = codes.once(shared, Aligner)
        for b in batches:
            for at in range(b.num_rows):
                part = b.slice(at, 1)
                page = part.column(0)[0].as_py()
                ch, co, on_a, on_o, la, lo = aligner.tile(part)
                ta, to = (_unpacked(part.column(k), "<i8")[0] for k in (3, 6))
                dice = (ch + co) / (la[:, None] + lo[None])
                i, j = np.nonzero(_enough(ch, co, la[:, None], lo[None]))
                ua, uo = np.cumsum(la) - la, np.cumsum(lo) - lo
                masks = [bits(on_a[q, ua[p] : ua[p] + la[p]]) for p, q in zip(i, j)], [bits(on_o[p, uo[q] : uo[q] + lo[q]]) for p, q in zip(i, j)]
                none = [None] * len(i)
                yield _found_in_tile(page, "c", ta[i], to[j], dice[i, j], none, la[i], lo[j], *masks)
                for kind, tags, d in (("a", ta, dice), ("b", to, dice.T)):
                    d = np.sort(d, axis=1)
                    none = [None] * len(tags)
                    yield _found_in_tile(page, kind, tags, tags, d[:, -1], d[:, -2] if d.shape[1] > 1 else none, none, none, none, none)

    met = written(tiles.mapInArrow(run, TILE), "tiles")

    def near(kind: str) -> DataFrame:  # mean of the two nearest neighbours on the page
        two = F.slice(F.sort_array(F.filter(F.flatten(F.collect_list(F.array("dice", "second"))), lambda d: d.isNotNull()), asc=False), 1, 2)
        mean = F.aggregate("two", F.lit(0.0), lambda s, d: s + d) / F.size("two")
        return met.where(F.col("kind") == kind).groupBy("page", F.col(f"{kind}_tag")).agg(two.alias("two")).select("page", f"{kind}_tag", mean.alias(f"near_{kind}"))

    c = met.where("kind = 'c'").join(near("a"), ["page", "a_tag"]).join(near("b"), ["page", "b_tag"])
    c = c.withColumn("score", F.col("dice") * F.lit(2.0) * F.col("dice") / (F.col("near_a") + F.col("near_b") + F.lit(1e-6)))
    c = c.repartition("page").sortWithinPartitions("page", F.desc("score"), "a_tag", "b_tag").select("page", "a_tag", "b_tag", "la", "lo", "on_a", "on_b")

    def decide(batches):
        now, free_a, free_b = None, {}, {}
        for b in batches:
            out = []
            for page, i, j, la, lo, ma, mb in zip(*(b.column(k).to_pylist() for k in range(7))):
                if page != now:
                    now, free_a, free_b = page, {}, {}
                ma, mb = int.from_bytes(ma, "little"), int.from_bytes(mb, "little")
                fa, fb = free_a.get(i, -1), free_b.get(j, -1)
                ga, gb = (ma & fa).bit_count(), (mb & fb).bit_count()
                if (ga >= OWN and gb >= OWN) or (ga >= MOST * la and gb >= 2) or (gb >= MOST * lo and ga >= 2):
                    out.append((page, i, j))
                    free_a[i], free_b[j] = fa & ~ma, fb & ~mb
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["page", "a_tag", "b_tag"])

    return c.mapInArrow(decide, "page string, a_tag long, b_tag long")


#: What a tile yields: pairs of columns (c), and the two nearest neighbours of a column of either side (a, b).
TILE = "page string, kind string, a_tag long, b_tag long, dice double, second double, la int, lo int, on_a binary, on_b binary"


def _found_in_tile(page: str, kind: str, *columns) -> pa.RecordBatch:
    n = len(columns[0])
    types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([page] * n, pa.string()), pa.array([kind] * n, pa.string()), *map(pa.array, columns, types)], [x.split()[0] for x in TILE.split(", ")])


def column_pairs(aligned: DataFrame) -> DataFrame:
    """The same of aligned_sentences: columns of a page whose sn_chars are read in qn_words, also their own; ends are -1.

    A page is sentence_id without its last part. The columns of a page are aligned together, up to PAGE_COLUMNS by one task and
    beyond it by ``long_pages``, with the same result. Null and empty sides pair with nothing.
    """
    clean = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x, F.lit(""))), " ")
    rows = aligned.where("row_id is not null and sentence_id is not null").select("row_id", F.regexp_replace("sentence_id", r"\.[^.]*$", "").alias("page"), clean(F.col("sn_chars")).alias("han"), clean(F.col("qn_words")).alias("other")).dropDuplicates(["row_id"])

    def run(batches):
        for b in batches:
            n = b.num_rows
            made = [_coded([mended(t or "") for t in b.column(k).to_pylist()], np.arange(n), b.column(0).to_pylist(), n, k == 2) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made[0], *made[1], b.column(1)], [*_NAMES, "page"])

    coded = written(rows.select("row_id", "page", "han", "other").mapInArrow(run, CODED + ", page string"), "coded-columns")
    shared = fit(coded)
    x = coded.where("length(a) > 0 or length(b) > 0")
    sizes = x.groupBy("page").agg(F.greatest(F.count_if(F.length("a") > 0), F.count_if(F.length("b") > 0)).alias("n"))
    long = written(sizes.where(F.col("n") > PAGE_COLUMNS), "long-pages")
    any_long = not long.isEmpty()
    short = x.join(long, "page", "left_anti") if any_long else x
    names = _NAMES[1:]
    pages = short.groupBy("page").agg(F.min("doc").alias("doc"), F.sort_array(F.collect_list(F.struct("doc", *names))).alias("c"))  # 2 PAGE_COLUMNS at most
    pages = pages.select("doc", *(_joined(n) for n in names))
    found = align(pages, shared).select("a_tag", "b_tag")
    if any_long:
        found = found.unionByName(long_pages(x.join(long, "page"), shared).drop("page"))
    return found.select(F.lit("aligned_sentences").alias("table_name"), F.col("a_tag").alias("row_id"), F.lit(-1).alias("han_end"), F.col("b_tag").alias("other_row_id"), F.lit(-1).alias("other_end"))


def found(records: DataFrame, aligned: DataFrame) -> DataFrame:
    """All pairs, each once: (table_name, row_id, han_end, other_row_id, other_end)."""
    return record_pairs(records).unionByName(column_pairs(aligned)).distinct()
