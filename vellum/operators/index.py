"""Chunks of scanned pages with stable ids, and nearest neighbours among vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.ids import point_id
from vellum.functions.text import strip


def usable(pages: DataFrame) -> DataFrame:
    return pages.where(F.coalesce(strip(F.col("error")), F.lit("")) == "")


def page_chunks(pages: DataFrame) -> DataFrame:
    """A chunk for each page with text."""
    x = usable(pages).withColumn("t", strip(F.col("text"))).where("t <> ''")
    return x.select(point_id(F.col("doc_id"), F.col("model_name"), F.col("page_no"), "page").alias("point_id"), "doc_id", "page_no", "model_name", F.lit("page").alias("chunk_type"), F.lit(None).cast("int").alias("block_index"), F.col("t").alias("text"), "confidence", F.col("confidence").alias("page_confidence"))


def block_chunks(pages: DataFrame) -> DataFrame:
    """A chunk for each block with text; block_index is the block's place in the original list, from 0."""
    x = usable(pages).select("doc_id", "page_no", "model_name", F.col("confidence").alias("page_confidence"), F.posexplode("blocks").alias("block_index", "b"))
    x = x.withColumn("t", strip(F.col("b.text"))).where("t <> ''")
    return x.select(point_id(F.col("doc_id"), F.col("model_name"), F.col("page_no"), "block", F.col("block_index")).alias("point_id"), "doc_id", "page_no", "model_name", F.lit("block").alias("chunk_type"), "block_index", F.col("t").alias("text"), F.coalesce("b.confidence", "page_confidence").alias("confidence"), "page_confidence")


def counters(pages: DataFrame) -> DataFrame:
    """One row: pages with at least one block chunk, and all block chunks."""
    n = F.size(F.filter(F.coalesce("blocks", F.array().cast("array<struct<text:string,confidence:double,box:array<array<double>>>>")), lambda b: strip(F.coalesce(b["text"], F.lit(""))) != ""))
    x = usable(pages).select(n.alias("n"))
    return x.agg(F.count_if(F.col("n") > 0).alias("pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("points"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_: str = "vec_id", vector: str = "embedding", block: int = 2048) -> DataFrame:
    """(query_id, id_, score, rank): the k nearest rows by cosine of each query, ties by id.

    The queries are a stated set: they go round in blocks of ``block``, and each block passes over all rows once, so a task holds one
    block of queries and one batch of rows. Each task keeps k rows for a query before the shuffle. The row itself is no neighbour;
    null vectors and zero vectors have score 0 and null vectors are left out.
    """
    spark = vectors.sparkSession
    out = None
    q = queries.where(F.col(vector).isNotNull()).select(id_, vector).orderBy(id_)
    n = q.count()
    for at in range(0, max(n, 1), block):
        part = q.offset(at).limit(block).collect() if n else []  # at most ``block`` queries at once
        ids = np.array([r[0] for r in part], dtype=np.int64)
        m = np.array([r[1] for r in part], dtype=np.float64).reshape(len(part), -1)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        shared = spark.sparkContext.broadcast((ids, m))

        def run(batches, shared=shared):
            ids, m = shared.value
            best: list[list] = [[] for _ in ids]
            for b in batches:
                keys = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                if not len(keys) or not len(ids):
                    continue
                rows = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), -1)
                rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
                s = m @ rows.T
                s[ids[:, None] == keys[None, :]] = -np.inf
                least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(ids), -np.inf)
                for i in range(len(ids)):
                    top = np.flatnonzero(s[i] >= least[i])  # with ties, which go by id
                    top = top[np.lexsort((keys[top], -s[i, top]))][:k]
                    best[i] = sorted(best[i] + [(-s[i, j], int(keys[j])) for j in top if s[i, j] > -np.inf])[:k]
            rows = [(int(ids[i]), key, float(-s)) for i, x in enumerate(best) for s, key in x]
            cols = list(map(list, zip(*rows))) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", id_, "score"])

        one = vectors.where(F.col(vector).isNotNull()).select(id_, vector).mapInArrow(run, f"query_id long, {id_} long, score double")
        out = one if out is None else out.unionByName(one)
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(id_).alias("i")))), 1, k)
    g = out.groupBy("query_id").agg(top.alias("t"))  # at most k rows from each task
    return g.select("query_id", F.posexplode("t").alias("rank", "x")).select("query_id", F.col("x.i").alias(id_), F.round(-F.col("x.s"), 6).alias("score"), (F.col("rank") + 1).alias("rank"))
