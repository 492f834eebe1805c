"""Encoding of texts with a byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import importlib.util
import os

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: how texts are split before merges, as the vocabulary's publisher defines it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NONE = 1 << 30
#: Pieces up to so many characters are remembered, so many of them in a worker.
REMEMBER_CHARS, REMEMBER = 48, 150_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The place of a public vocabulary file on this machine."""
    at = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(at.origin) if at and at.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece.

    A segment tree over byte positions holds in each node the least rank of a pair that starts below it; the root names
    the next merge and a walk to the left finds its first place. A merge changes three leaves (the pair's, its left
    neighbour's, and the swallowed one), each in logarithmic time, so a piece of n bytes takes n log n.
    """
    n = len(piece)
    if piece in ranks:
        return [ranks[piece]]
    if n == 2:
        return [ranks[piece[:1]], ranks[piece[1:]]]
    size = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        tree[size + i] = get(piece[i : i + 2], NONE)
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b
    after = list(range(1, n + 2))  # start of the live neighbour to the right; n is the end
    before = list(range(-1, n))

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a <= b else b
            if tree[k] == low:
                break
            tree[k] = low
            k >>= 1

    while (low := tree[1]) < NONE:
        k = 1
        while k < size:
            k += k
            if tree[k] != low:
                k += 1
        i = k - size
        j = after[i]
        end = after[i] = after[j]
        if end <= n:
            before[end] = i
        put(j, NONE) if j < n else None
        put(i, get(piece[i : after[end]], NONE) if end < n else NONE)
        if (p := before[i]) >= 0:
            put(p, get(piece[p:end], NONE))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Encoder:
    """Encodes texts and remembers short pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.find, self.known = ranks, regex.compile(pattern).findall, {}

    def ids(self, text: str | None) -> list[int]:
        """Ids without special tokens; an empty list for null and for the empty text."""
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for piece in self.find(text):
            got = known.get(piece)
            if got is None:
                got = merge(piece.encode("utf-8"), self.ranks)
                if len(piece) <= REMEMBER_CHARS:
                    if len(known) >= REMEMBER:
                        known.clear()
                    known[piece] = got
            out += got
        return out

    def count(self, text: str | None) -> int:
        return len(self.ids(text))


def shared_ranks(df: DataFrame, path: str | None):
    """The vocabulary as a broadcast; its size is that of the file (0.8 MB), whatever the data's."""
    return df.sparkSession.sparkContext.broadcast(read_ranks(path or vocabulary_path()))


def encode(df: DataFrame, text: str = "text", id_: str = "doc_id", path: str | None = None) -> DataFrame:
    """(id_, ids ARRAY<INT>) for each row of ``df``, as often as it is given.

    Null and empty texts give an empty list, blank texts the ids of their blanks; strings that look like special tokens
    are ordinary text. Whole texts are encoded, however long. One narrow pass: no shuffle, Arrow in and out, two columns read.
    """
    ranks = shared_ranks(df, path)

    def run(batches):
        encoder = Encoder(ranks.value)
        for b in batches:
            rows = [encoder.ids(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32()))], ["id", "ids"])

    kind = df.schema[id_].dataType.simpleString()
    return df.select(F.col(id_).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_)


def token_counts(df: DataFrame, text: str = "text", id_: str = "doc_id", path: str | None = None) -> DataFrame:
    """(id_, n_tokens INT) for each row; 0 for null and empty texts."""
    ranks = shared_ranks(df, path)

    def run(batches):
        encoder = Encoder(ranks.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encoder.count(t.as_py()) for t in b.column(1)], pa.int32())], ["id", "n_tokens"])

    kind = df.schema[id_].dataType.simpleString()
    return df.select(F.col(id_).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_tokens int").withColumnRenamed("id", id_)
