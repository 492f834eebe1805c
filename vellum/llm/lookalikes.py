"""One form for texts that look the same and are stored with different characters."""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts and the Latin letters they look like.
LOOK_ALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "ү": "y",
    "х": "x", "ѵ": "v", "ԝ": "w", "к": "k", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Һ": "H", "Ԛ": "Q", "Ԝ": "W", "Ԁ": "D", "Ѵ": "V", "ο": "o", "ν": "v", "α": "a", "ι": "i", "κ": "k",
    "ρ": "p", "υ": "u", "τ": "t", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j", "η": "n", "ω": "w", "σ": "o", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z",
    "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ð": "Đ", "Ɖ": "Đ", "ð": "đ", "ɖ": "đ",
    "ɑ": "a", "ɡ": "g", "ı": "i", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "ք": "p", "մ": "u",
}
#: Characters that do not show, as a class of Java and Python patterns: default ignorable code points and controls.
_UNSEEN = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF), (0x0, 0x8), (0xE, 0x1F), (0x7F, 0x9F))
#: Blanks other than the ordinary one; tab and line ends are not blanks of a line, U+3000 is one outside Han text.
_BLANK = ((0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F))
def _java(ranges) -> str:
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


def _python(ranges) -> str:
    return "".join(re.escape(chr(a)) if a == b else f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges)


_HAN_JAVA = r"\x{2E80}-\x{2FDF}\x{3001}-\x{303F}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF01}-\x{FF0F}\x{20000}-\x{3FFFF}"
_UNSEEN_RE, _BLANK_RE = re.compile(f"[{_python(_UNSEEN)}]"), re.compile(f"[{_python(_BLANK)}]")
_WIDE_RE = re.compile("(?<![⺀-⿟、-〿㐀-鿿豈-﫿！-／\U00020000-\U0003ffff　])　+(?![⺀-⿟、-〿㐀-鿿豈-﫿！-／\U00020000-\U0003ffff　])")
_TOKEN = re.compile(r"[^\W\d_]+(?:\.[^\W\d_]+)*")



def _ranges(points) -> list[list[int]]:
    out: list[list[int]] = []
    for cp in sorted(points):
        if out and cp == out[-1][1] + 1:
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    return out


def is_open(text: Column) -> Column:
    """False for a text that is in its one form already, for it has nothing to fold and its lattice has one path.

    A short class of everyday characters settles most texts; the long class of all that can change is asked of the others.
    """
    everyday, all_ = open_patterns()
    return text.rlike(everyday) & text.rlike(all_)


@lru_cache(1)
def open_patterns() -> tuple[str, str]:
    """Java patterns: any character that is not everyday, and any that can change.

    Made from the Unicode tables: what is deleted, odd blanks, letters of the look-alike table, characters with a compatibility form that is
    folded, and those that compose with the character before them.
    """
    found = set(map(ord, LOOK_ALIKES))
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        parts = unicodedata.decomposition(ch)
        if parts:
            if plain(ch) != ch or unicodedata.normalize("NFC", ch) != ch:
                found.add(cp)
            if parts[0] != "<" and " " in parts:
                found.add(int(parts.split()[-1], 16))
        elif unicodedata.combining(ch):
            found.add(cp)
    found |= set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))  # parts of Hangul syllables
    ranges = _ranges(found)
    blocks = ((0x9, 0xA), (0x20, 0x7E), (0xA1, 0x17F), (0x1A0, 0x1B0), (0x1EA0, 0x1EF9), (0x2010, 0x2027), (0x25CB, 0x25CB), (0x3001, 0x3020), (0x3400, 0x9FFF), (0xFF01, 0xFF20))
    everyday = _ranges({cp for a, b in blocks for cp in range(a, b + 1)} - found - {cp for a, b in _UNSEEN + _BLANK for cp in range(a, b + 1)})
    return f"[^{_java(everyday)}]", f"[{_java(_UNSEEN + _BLANK)}{_java(ranges)}]|(?<![{_HAN_JAVA}\\x{{3000}}])\\x{{3000}}+(?![{_HAN_JAVA}\\x{{3000}}])"


#: Classes of letters in the n-gram model. Letters outside the listed scripts share a class, so a table has CLASSES**2 entries at most.
_LETTERS = sorted({ch for a, b in ((0x61, 0x7B), (0xDF, 0x180), (0x1A0, 0x1B1), (0x1E00, 0x1EFF), (0x370, 0x400), (0x400, 0x530), (0x250, 0x2B0)) for ch in map(chr, range(a, b)) if ch.isalpha() and ch == ch.lower()})
EDGE, REST = 0, 1
CLASSES = len(_LETTERS) + 2


@lru_cache(1)
def class_table() -> np.ndarray:
    """The class of each code point: 0 for what is no letter, 1 for other letters."""
    t = np.zeros(sys.maxunicode + 1, dtype=np.int32)
    own = {ch: i + 2 for i, ch in enumerate(_LETTERS)}
    for cp in range(0x41, 0x2FFF):
        ch = chr(cp)
        if ch.isalpha():
            t[cp] = own.get(ch.lower(), REST)
    for a, b in ((0x3040, 0xD7FF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)):
        t[a : b + 1] = REST
    return t


def ngrams(texts: DataFrame, text: str = "text") -> DataFrame:
    """(pair INT, n BIGINT): how often two classes of letters stand side by side in ``texts``, over all rows.

    Each task counts its rows into one table of CLASSES**2 entries, and its rows that are not zero are summed; what is
    shuffled depends on the number of tasks, not of rows.
    """

    def run(batches):
        table, total = class_table(), np.zeros(CLASSES * CLASSES, dtype=np.int64)
        for b in batches:
            column = b.column(0).drop_null()
            if not len(column):
                continue
            joined = "\n" + "\n".join(column.to_pylist()) + "\n"
            cls = table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
            total += np.bincount(cls[:-1] * CLASSES + cls[1:], minlength=CLASSES * CLASSES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["pair", "n"])

    return texts.select(F.col(text).cast("string")).mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


class Model:
    """Log probabilities of a letter class after another, smoothed."""

    def __init__(self, counts: dict[int, int]):
        self.counts, self.of = counts, [0] * CLASSES
        for pair, n in counts.items():
            self.of[pair // CLASSES] += n
        self.known: dict[tuple[int, int], float] = {}

    def score(self, a: int, b: int) -> float:
        got = self.known.get((a, b))
        if got is None:
            got = self.known[a, b] = math.log((self.counts.get(a * CLASSES + b, 0) + 0.5) / (self.of[a] + 0.5 * CLASSES))
        return got


#: Log costs of replacing a letter by one that it looks like, of a change of script within a word, and of a letter that is not Latin in a word that has Latin
#: letters.
REPLACED, SWITCHED, FOREIGN = -2.0, -12.0, -2.5
_LIKE_RE = re.compile(f"[{''.join(LOOK_ALIKES)}]")
_LIKE: dict[str, set[str]] = {}
for _a, _b in LOOK_ALIKES.items():
    _LIKE.setdefault(_a, set()).add(_b)
    if _b.isascii():
        _LIKE.setdefault(_b, set()).add(_a)


@lru_cache(65536)
def script(ch: str) -> str:
    name = unicodedata.name(ch, "OTHER")
    return "LATIN" if ch.isascii() else name.split()[0]


def decode(token: str, model: Model) -> str:
    """The best path through the token's lattice of look-alikes (Viterbi).

    A node is a letter or one it looks like; an edge scores the letter after the one before it, with a cost for a change of
    script. A letter that stands alone is a siglum of its own script and stays.
    """
    letters = [c for c in token if c != "."]
    if len(letters) < 2 or not any(c in LOOK_ALIKES for c in letters):
        return token
    table, latin = class_table(), any(script(c) == "LATIN" for c in letters)
    paths = {"": (0.0, "")}  # last letter -> score, text
    for ch in token:
        if ch == ".":
            paths = {k: (s, t + ".") for k, (s, t) in paths.items()}
            continue
        now: dict[str, tuple[float, str]] = {}
        for c in (ch, *sorted(_LIKE.get(ch, ()))):
            k, cost = int(table[ord(c)]), 0.0 if c == ch else REPLACED
            if latin and script(c) != "LATIN":
                cost += FOREIGN
            for last, (s, t) in paths.items():
                total = s + cost + model.score(int(table[ord(last)]) if last else EDGE, k)
                if last and script(last) != script(c):
                    total += SWITCHED
                if c not in now or total > now[c][0]:
                    now[c] = (total, t + c)
        paths = now
    return max((s + model.score(int(table[ord(last)]) if last else EDGE, EDGE), t) for last, (s, t) in paths.items())[1]


@lru_cache(65536)
def plain(ch: str) -> str:
    """A letter, digit, mark or ideograph without its variant form; other characters as they are."""
    if ch in LOOK_ALIKES:  # the lattice decides
        return ch
    kind = unicodedata.category(ch)
    if kind[0] in "LN" or 0x2E80 <= ord(ch) <= 0x2FDF:
        return unicodedata.normalize("NFKC", ch)
    return ch


def form(text: str, model: Model) -> str:
    """The one form of a text: unseen characters deleted, blanks ordinary, letters, digits and ideographs without variant
    forms, accented letters composed, and look-alike letters decoded word by word. Punctuation stays as it is."""
    s = _UNSEEN_RE.sub("", text)
    s = _WIDE_RE.sub(lambda m: " " * len(m[0]), _BLANK_RE.sub(" ", s))
    s = unicodedata.normalize("NFC", s if s.isascii() else "".join(map(plain, s)))
    return _TOKEN.sub(lambda m: decode(m[0], model), s) if _LIKE_RE.search(s) else s


def fit(*texts: tuple[DataFrame, str]) -> dict[int, int]:
    """The n-gram counts over all rows of the given (table, column) pairs; at most CLASSES**2 entries reach the driver."""
    all_ = None
    for df, column in texts:
        one = df.select(F.col(column).cast("string").alias("text"))
        all_ = one if all_ is None else all_.unionByName(one)
    return {r[0]: r[1] for r in ngrams(all_).collect()}


def form_of(spark, counts: dict[int, int]):
    """A column function: the one form of a text column; null for null.

    Only texts that is_open go to Python, others have one path and stay.
    """
    shared = spark.sparkContext.broadcast(counts)  # bounded by CLASSES**2 entries

    @F.pandas_udf("string")
    def decoded(column: pd.Series) -> pd.Series:
        model = Model(shared.value)
        return column.map(lambda t: None if t is None else form(t, model))

    def apply(text: Column) -> Column:
        return F.coalesce(decoded(F.when(is_open(text), text)), text)

    return apply


def fields(records: DataFrame, detections: DataFrame) -> DataFrame:
    """(table_name, row_id, field_name, text) of records.han, records.meaning and detections.text; nulls left out."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in ("han", "meaning"))))
    a = records.select(F.lit("records").alias("table_name"), "row_id", pairs.alias("x")).select("table_name", "row_id", "x.*")
    b = detections.select(F.lit("detections").alias("table_name"), "row_id", F.lit("text").alias("field_name"), "text")
    return a.unionByName(b).where("text is not null")


def forms(records: DataFrame, detections: DataFrame) -> DataFrame:
    """Every text in its one form: (table_name, row_id, field_name, form, changed). Repeated rows are kept; empty texts stay empty."""
    x = fields(records, detections)
    f = form_of(records.sparkSession, fit((x, "text")))
    return x.withColumn("form", f(F.col("text"))).select("table_name", "row_id", "field_name", "form", (F.col("form") != F.col("text")).alias("changed"))


def changed(records: DataFrame, detections: DataFrame) -> DataFrame:
    """(table_name, row_id, field_name) of each value whose one form is another text, each once."""
    x = fields(records, detections)
    f = form_of(records.sparkSession, fit((x, "text")))
    open_ = x.where(is_open(F.col("text")))
    return open_.withColumn("form", f(F.col("text"))).where("form <> text").select("table_name", "row_id", "field_name").distinct()
