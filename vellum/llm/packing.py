"""Filling containers of fixed capacity with documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.encoding import token_counts
from vellum.tables import written

CAPACITY = 2048
#: Length buckets; more of them mean less padding and a longer plan.
BUCKETS = 400
#: Pieces of a part of a bucket that is ranked apart, so that a bucket with a third of all rows is no single task.
PART = 1_000_000


def boundaries(counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of the length buckets with the least padding, by dynamic programming over the histogram.

    ``counts[s]`` is the number of pieces of size s (index 0 unused). A piece in bucket (a, b] pads b - s. The cost of a
    bucket is b * N(a, b) - T(a, b) with N and T the running counts and tokens, so a step of the programme is one vector
    operation for each halving of the sizes: the cost is Monge, so the programme takes buckets * capacity * log(capacity) steps.
    The histogram has capacity + 1 entries, whatever the data's size.
    """
    sizes = np.flatnonzero(counts)
    if not len(sizes):
        return []
    n, t = np.cumsum(counts[sizes]).astype(float), np.cumsum(counts[sizes] * sizes).astype(float)
    n, t = np.r_[0.0, n], np.r_[0.0, t]
    m, k = len(sizes), min(buckets, len(sizes))
    if k == m:
        return sizes.tolist()
    best, back = np.full(m + 1, np.inf), np.zeros((k + 1, m + 1), dtype=np.int32)
    best[0] = 0
    top = 1 << max(m - 1, 1).bit_length()
    for b in range(1, k + 1):
        now, cut = np.full(m + 1, np.inf), back[b]
        gap = top
        while gap:  # the best cut never falls as j grows, so it is looked for between those of the places halfway before and after
            j = np.arange(gap, m + 1, 2 * gap)
            j = j[j >= b]
            if len(j):
                low = np.where(j - gap >= b, cut[j - gap], b - 1)
                after = np.minimum(j + gap, m)
                high = np.minimum(np.where((after > j) & (now[after] < np.inf), cut[after], j - 1), j - 1)
                n_ = high - low + 1
                first = np.cumsum(n_) - n_
                i = np.arange(n_.sum()) - np.repeat(first - low, n_)
                jj = np.repeat(j, n_)
                cost = best[i] + sizes[jj - 1] * (n[jj] - n[i]) - (t[jj] - t[i])
                least = np.minimum.reduceat(cost, first)
                hit = np.flatnonzero(cost == np.repeat(least, n_))
                hit = hit[np.searchsorted(hit, first)]
                now[j], cut[j] = least, i[hit]
            gap >>= 1
        best = now
    out, j = [], m
    for b in range(k, 0, -1):
        out.append(int(sizes[j - 1]))
        j = back[b, j]
    return out[::-1]


def fullest(sizes: list[int], left: list[int], room: int) -> dict[int, int]:
    """How many of each bucket fill ``room`` best (a bounded subset sum; a bit of an integer is a reachable sum)."""
    reach, steps = 1, []
    limit = (1 << (room + 1)) - 1
    for k in range(len(sizes) - 1, -1, -1):  # largest first, so that large sizes are used up early
        if not left[k] or sizes[k] > room:
            continue
        steps.append((k, reach))
        size, many, lot = sizes[k], min(left[k], room // sizes[k]), 1
        while many:
            lot = min(lot, many)
            reach |= (reach << (size * lot)) & limit
            many -= lot
            lot *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for k, before in reversed(steps):
        many = 0
        while not before >> total & 1:
            total -= sizes[k]
            many += 1
        if many:
            used[k] = many
    return used


def plan(counts: np.ndarray, capacity: int = CAPACITY, buckets: int = BUCKETS) -> tuple[list[int], list[tuple[int, int, int, int]], int]:
    """(bounds, slots, containers): the buckets and which ranks of a bucket go to which container.

    Batches form inside each bucket from the largest down: a batch opens with pieces of its bucket, each counted at the
    bucket's bound, and the tokens left of its budget are filled as full as the smaller buckets allow. The same batch is repeated
    as long as all its buckets have pieces, so the plan has a few rows for each bucket whatever the data's size. A slot is
    (bucket, first rank, pieces a container, first container).
    """
    bounds = boundaries(counts, buckets)
    edges = np.searchsorted(bounds, np.arange(len(counts)))
    left = np.bincount(edges[1:], weights=counts[1:], minlength=len(bounds)).astype(np.int64).tolist() if bounds else []
    taken, slots, containers = [0] * len(bounds), [], 0
    for k in range(len(bounds) - 1, -1, -1):
        while left[k]:
            left[k] -= 1
            used = fullest(bounds, left, capacity - bounds[k])
            left[k] += 1
            used[k] = used.get(k, 0) + 1
            times = min(left[i] // m for i, m in used.items())
            for i, m in used.items():
                slots.append((i, taken[i], m, containers))
                taken[i] += m * times
                left[i] -= m * times
            containers += times
    return bounds, slots, containers


def pieces(sizes: DataFrame, id_: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """(id_, piece_no from 0, first_token, n_tokens): a row for an item, or, where it alone exceeds a container, for each capacity of it.

    Null and negative sizes count as 0.
    """
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    last = F.greatest(F.ceil(n / capacity) - 1, F.lit(0))
    cut = sizes.select(F.col(id_), n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("k"))
    first = F.col("k") * capacity
    return cut.select(id_, F.col("k").cast("int").alias("piece_no"), first.alias("first_token"), F.least(F.col("n") - first, F.lit(capacity)).cast("int").alias("n_tokens"))


def pack(sizes: DataFrame, id_: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, buckets: int = BUCKETS, part: int = PART) -> DataFrame:
    """Assigns every item to containers: (id_, piece_no, first_token, n_tokens, container_id).

    No container holds more than ``capacity``; an item is divided only where it alone exceeds one. Items of size 0 (null,
    empty) take no room and go to container 0. Rows that repeat are items of their own. An empty table gives no rows.

    What reaches the driver is the histogram (at most ``capacity`` rows) and the counts of the parts (one for each bucket and for
    every ``part`` pieces). A piece's rank in its bucket is its rank in its part, (bucket, hash of the id), of which a bucket has as
    many as its pieces need, plus the number of pieces in earlier parts: one shuffle, and no bucket is a single task.
    """
    rows = pieces(sizes, id_, size, capacity)
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in rows.where("n_tokens > 0").groupBy("n_tokens").count().collect():
        counts[r[0]] = r[1]
    bounds, slots, _ = plan(counts, capacity, buckets)
    if not bounds:
        return rows.withColumn("container_id", F.lit(0).cast("long"))
    edges = np.searchsorted(bounds, np.arange(capacity + 1))
    parts = -(-np.bincount(edges, weights=counts, minlength=len(bounds)).astype(np.int64) // part)
    table = [(s, int(k), max(int(parts[k]), 1)) for s, k in enumerate(edges)]
    table = sizes.sparkSession.createDataFrame(table, "n_tokens int, bucket int, parts int")  # capacity + 1 rows
    marked = rows.join(F.broadcast(table), "n_tokens").withColumn("part", F.pmod(F.xxhash64(id_, "piece_no"), F.col("parts")).cast("int"))
    filled, empty = marked.where("n_tokens > 0"), marked.where("n_tokens = 0")
    before, base = {}, {}
    for r in sorted(filled.groupBy("bucket", "part").count().collect()):
        before[r[0], r[1]] = base.get(r[0], 0)
        base[r[0]] = base.get(r[0], 0) + r[2]
    by_bucket = {k: np.array(sorted(s[1:] for s in slots if s[0] == k), dtype=np.int64) for k in {s[0] for s in slots}}
    shared = sizes.sparkSession.sparkContext.broadcast((before, by_bucket))

    from pyspark.sql import Window

    ranked = filled.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "part").orderBy(id_, "piece_no")))

    def run(batches):
        before, by_bucket = shared.value
        for b in batches:
            k, part, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "part", "rank"))
            rank = rank.astype(np.int64) - 1 + np.array([before[x] for x in zip(k.tolist(), part.tolist())], dtype=np.int64)
            to = np.empty(len(k), dtype=np.int64)
            for x in np.unique(k):
                at, s = k == x, by_bucket[int(x)]
                j = np.searchsorted(s[:, 0], rank[at], side="right") - 1
                to[at] = s[j, 2] + (rank[at] - s[j, 0]) // s[j, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(4)), pa.array(to)], ["id", "piece_no", "first_token", "n_tokens", "container_id"])

    kind = sizes.schema[id_].dataType.simpleString()
    out = ranked.select(F.col(id_).alias("id"), "piece_no", "first_token", "n_tokens", "bucket", "part", "rank").mapInArrow(run, f"id {kind}, piece_no int, first_token long, n_tokens int, container_id long")
    return out.withColumnRenamed("id", id_).unionByName(empty.select(id_, "piece_no", "first_token", "n_tokens", F.lit(0).cast("long").alias("container_id")))


def pack_documents(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``pack`` over documents measured in tokens; the counts are written once, as they are read three times."""
    return pack(written(token_counts(documents, path=path), "token-counts"), capacity=capacity)


def fill(assigned: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: (containers, tokens, unused_share)."""
    one = assigned.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    return one.agg(F.count("*").alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), (1 - F.sum("n") / (F.count("*") * capacity)).alias("unused_share"))
