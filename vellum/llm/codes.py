"""Tokens of many texts at once, as numbers: arrays of code points instead of a string for each word."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds of characters: neither, letter, digit, Han, one that does not show, apostrophe.
OTHER, LETTER, DIGIT, HAN, UNSEEN, APOSTROPHE = range(6)
#: Code points from here on are no letters (planes of variation selectors and private use).
LAST = 0x32400
# Ranges of Han characters with radicals, and characters that do not show.
HAN_RANGES = ((0x2E80, 0x2FDF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
UNSEEN_RANGES = ((0x00, 0x08), (0x0B, 0x0B), (0x0E, 0x1F), (0x7F, 0x7F), (0x200B, 0x200D), (0x2060, 0x2060), (0xFEFF, 0xFEFF), (0xFFFD, 0xFFFD))
#: Characters of texts that are looked at in one step; bounds the memory of a task unless one text is longer.
STEP = 1_000_000
_WORD = np.uint64(1) << np.uint64(62)


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind of each code point, number of its lower case, powers of the places in a word), made once in a process."""
    kind = np.zeros(0x110000, np.uint8)
    low = np.arange(0x110000, dtype=np.uint64)
    for c in range(LAST):
        x = chr(c)
        if x.isalnum():
            kind[c] = DIGIT if x.isdecimal() else LETTER
            low[c] = ord(x.lower()[0])
    for a, b in HAN_RANGES:
        kind[a : b + 1] = HAN
    for a, b in UNSEEN_RANGES:
        kind[a : b + 1] = UNSEEN
    kind[[ord("'"), ord("’")]] = APOSTROPHE
    with np.errstate(over="ignore"):
        low = (low + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        low ^= low >> np.uint64(27)
        power = np.cumprod(np.full(4096, 0x5851F42D4C957F2D, np.uint64), dtype=np.uint64)
    return kind, low, power


def word_key(word: str) -> int:
    """The number of a word, for tests and lookups of single words."""
    return int(tokens([word])[0][0])


def tokens(texts: list[str], digits: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, text, place) of each token of the texts, in order: words without regard to case and single Han characters.

    An apostrophe between letters ends a word and belongs to it. Characters that do not show are passed over. ``digits``: runs of
    digits are tokens too. Numbers have 63 bits: a Han character is its code point, a word a hash of its letters.
    """
    kinds, low, power = tables()
    raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "replace"), np.uint32)
    kind = kinds[raw]
    where = None
    if (kind == UNSEEN).any():
        where = np.flatnonzero(kind != UNSEEN)
        raw, kind = raw[where], kind[where]
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    letter = kind == LETTER
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    inside = letter
    mark = np.flatnonzero(kind == APOSTROPHE)
    mark = mark[(mark > 0) & (mark < len(kind) - 1)]
    mark = mark[letter[mark - 1] & letter[mark + 1]]
    if len(mark):
        inside = letter.copy()
        inside[mark] = True
    if digits:
        digit = kind == DIGIT
        inside = inside | digit
        first = digit.copy()
        first[1:] &= ~digit[:-1]
        start |= first
    at = np.flatnonzero(inside)
    if len(at):
        begins = np.flatnonzero(start[at])
        place = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
        with np.errstate(over="ignore"):
            number = np.add.reduceat(low[raw[at]] * power[place & 4095], begins)
            number ^= number >> np.uint64(31)
            number = ((number * np.uint64(0x94D049BB133111EB)) >> np.uint64(2)) | _WORD
        at, number = at[begins], number.astype(np.int64)
    else:
        number = np.zeros(0, np.int64)
    han = np.flatnonzero(kind == HAN)
    if len(han):
        number = np.concatenate([number, raw[han].astype(np.int64)])
        at = np.concatenate([at, han])
        if len(number) > len(han):
            order = np.argsort(at, kind="stable")
            at, number = at[order], number[order]
    if where is not None:
        at = where[at]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    first = np.cumsum(lengths) - lengths
    text = np.searchsorted(first, at, side="right") - 1
    return number, text, at - first[text]


def is_han(numbers: np.ndarray) -> np.ndarray:
    return numbers < 0x110000


def steps(texts: list[str], size: int = STEP):
    """(from, to) of runs of texts of at most ``size`` characters together, or one longer text."""
    at, room = 0, size
    for i, t in enumerate(texts):
        n = len(t)
        if n > room and i > at:
            yield at, i
            at, room = i, size
        room -= n
    if at < len(texts):
        yield at, len(texts)


def distinct(numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each number once, in order, with the sums of its rows of counts."""
    order = np.argsort(numbers, kind="stable")
    numbers = numbers[order]
    new = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1])) if len(numbers) else np.zeros(0, np.int64)
    return numbers[new], np.add.reduceat(counts[order], new, axis=0) if len(new) else counts[:0]


def _packed(df: DataFrame) -> DataFrame:
    """The columns of ``df``, all longs, as one binary value a column for each batch."""
    names = df.columns

    def pack(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()) for c in b.columns], names)

    return df.mapInArrow(pack, ", ".join(f"{n} binary" for n in names))


def collected(df: DataFrame) -> list[np.ndarray]:
    """The columns of ``df``, all longs, as arrays. The caller bounds its rows."""
    rows = _packed(df).collect()
    return [np.frombuffer(b"".join(r[i] for r in rows), "<i8") for i in range(len(df.columns))]


def shared_file(df: DataFrame) -> str:
    """Sends the columns of ``df``, all longs, to all executors as files of numbers, in the order of the first; returns their name.

    The driver passes on one batch at a time and keeps none; executors map the files and do not read them into memory.
    """
    context = df.sparkSession.sparkContext
    name = os.path.join(folder := tempfile.mkdtemp(), f"rare-{uuid.uuid4().hex}")
    atexit.register(shutil.rmtree, folder, True)  # executors fetch the files from the driver
    files = [open(f"{name}.{i}", "wb") for i in range(len(df.columns))]
    for r in _packed(df.orderBy(df.columns[0])).toLocalIterator():
        for f, x in zip(files, r):
            f.write(x)
    for i, f in enumerate(files):
        f.close()
        context.addFile(f"{name}.{i}")
    return os.path.basename(name)


def mapped(name: str, columns: int) -> list[np.ndarray]:
    """The columns that ``shared_file`` sent, in an executor."""
    from pyspark import SparkFiles

    return [np.memmap(p, "<i8", "r") if os.path.getsize(p := SparkFiles.get(f"{name}.{i}")) else np.zeros(0, np.int64) for i in range(columns)]


def once(shared, make):
    """What ``make`` makes of a broadcast's value. It is kept with the broadcast in a worker for its later tasks, and goes with it."""
    if "_made" not in shared.__dict__:
        shared._made = make(*shared.value)
    return shared._made
