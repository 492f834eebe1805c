"""Best representative of each group of duplicate answers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.tables import written

#: Iterations end when no source's reliability moves by more than this; it is an error if it still does after ROUNDS.
MOVED, ROUNDS = 1e-4, 500
#: So many sources are sent to all tasks; beyond it they are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Groups of up to so many claims of a field are a row of arrays each, so that a round moves nothing; those of larger ones are summed by shuffles.
PACKED_CLAIMS = 4096
FIELDS = ("text", "confidence")


def trimmed(c: Column) -> Column:
    """Lower case without outer blanks of any kind."""
    return F.lower(F.regexp_replace(c, r"^[\s\x{A0}\x{3000}]+|[\s\x{A0}\x{3000}]+$", ""))


def instant(c: Column) -> Column:
    """Microseconds of an ISO 8601 text as an instant; a text with no zone is UTC; null where there is none."""
    zoned = F.when(c.rlike(r"[T ].*([Zz]|[+-]\d\d:?(\d\d)?)$"), c).otherwise(F.concat(F.trim(c), F.lit("Z")))
    return F.unix_micros(F.try_to_timestamp(zoned))


def answers(ocr_results: DataFrame, ocr_models: DataFrame) -> DataFrame:
    """One row for each answer: (row_id, doc, page_no, source, rank, older, text, confidence, n).

    A repeated row_id is one row. Rows with a null doc_id, page_no or row_id are in no group. Rows with an error that is not blank
    stay in the group and supply nothing. text is a hash of the text without regard to blanks, null unless it has a letter or ideograph;
    confidence is null unless it is in (0, 1]; n is the text's length. Models without a rank come last. ``older`` orders by time, latest
    first. Texts themselves stay where they are read: only their hash and length are moved.
    """
    ranks = ocr_models.where("model_name is not null").groupBy(trimmed(F.col("model_name")).alias("source")).agg(F.min("trust_rank").alias("rank"))
    failed = F.coalesce(F.regexp_replace("error", r"[\s\x{A0}\x{3000}]+", ""), F.lit("")) != ""
    rows = ocr_results.where("row_id is not null and doc_id is not null and page_no is not null")
    ok = ~failed & F.col("text").rlike(r"\p{L}")
    confidence = F.when(~failed & (F.col("confidence") > 0) & (F.col("confidence") <= 1), F.col("confidence"))
    rows = rows.select(
        "row_id", trimmed(F.col("doc_id")).alias("doc"), "page_no", trimmed(F.coalesce("model_name", F.lit(""))).alias("source"),
        F.coalesce(-instant(F.col("created_at")), F.lit(2**62)).alias("older"), F.when(ok, F.xxhash64(F.regexp_replace(F.col("text"), r"\s+", " "))).alias("text"), confidence.alias("confidence"), F.when(ok, F.length("text")).alias("n"),
    )
    rows = rows.dropDuplicates(["row_id"])
    rows = rows.join(F.broadcast(ranks) if ranks.count() <= BROADCAST_SOURCES else ranks, "source", "left")
    return rows.withColumn("rank", F.coalesce("rank", F.lit(2**31 - 1)))


def by_precedence(rows: DataFrame) -> DataFrame:
    """(group_id, text_from, confidence_from) of each group of at least two rows, by declared precedence.

    Precedence is the best rank, then the latest time, then the smallest row_id; -1 where no row qualifies. Texts under 0.8
    times the longest qualifying text of the group do not qualify. Two partial aggregations: first by group and text length,
    where each length keeps its best row, then by group over its lengths. What a group gathers is bounded by the length of its longest
    text and not by its rows, so a group with a third of all rows is spread and combined before the shuffle.
    """
    best = F.struct(F.col("rank"), F.col("older"), F.col("row_id"))
    lengths = rows.groupBy("doc", "page_no", "n").agg(
        F.count("*").alias("rows"), F.min("row_id").alias("first"), F.min(F.when(F.col("n").isNotNull(), best)).alias("t"), F.min(F.when(F.col("confidence").isNotNull(), best)).alias("c")
    )
    groups = lengths.groupBy("doc", "page_no").agg(
        F.sum("rows").alias("rows"), F.min("first").alias("group_id"), F.max(F.when(F.col("t").isNotNull(), F.col("n"))).alias("longest"), F.min("c").alias("c"), F.collect_list(F.when(F.col("t").isNotNull(), F.struct("n", "t"))).alias("ts")
    )
    text = F.array_min(F.transform(F.filter("ts", lambda x: x["n"] * 10 >= F.col("longest") * 8), lambda x: x["t"]))
    return groups.where("rows >= 2").select("group_id", F.coalesce(text["row_id"], F.lit(-1)).cast("long").alias("text_from"), F.coalesce(F.col("c.row_id"), F.lit(-1)).cast("long").alias("confidence_from"))


def claims(rows: DataFrame) -> DataFrame:
    """(doc, page_no, field, value, source, n, row_id): how often a source claims a value; value is a hash of what compares equal.

    Texts compare without regard to blanks, confidences to two places. row_id is the smallest row that has the value.
    """
    each = F.array(
        F.struct(F.lit("text").alias("field"), F.col("text").alias("value")),
        F.struct(F.lit("confidence").alias("field"), F.when(F.col("confidence").isNotNull(), F.xxhash64(F.round("confidence", 2))).alias("value")),
    )
    x = rows.select("doc", "page_no", "source", "row_id", F.explode(F.filter(each, lambda e: e["value"].isNotNull())).alias("e"))
    return x.groupBy("doc", "page_no", "e.field", "e.value", "source").agg(F.count("*").alias("n"), F.min("row_id").alias("row_id"))


def votes(c: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc, page_no, field, value, support, row_id): support is the value's share of the weighted votes of its group and field."""
    values = c.join(weights, ["source", "field"]).groupBy("doc", "page_no", "field", "value").agg(F.sum(F.col("n") * F.col("weight")).alias("support"), F.min("row_id").alias("row_id"))
    all_ = values.groupBy("doc", "page_no", "field").agg(F.sum("support").alias("all_votes"))
    return values.join(all_, ["doc", "page_no", "field"]).withColumn("support", F.col("support") / F.col("all_votes")).drop("all_votes")


def packed(c: DataFrame, few: DataFrame | None) -> DataFrame:
    """(group_id, field, claims): the claims of a field of a group as one array, by value; ``few``: the groups that are packed, if not all."""
    x = c if few is None else c.join(few, ["doc", "page_no", "field"], "left_anti")
    return x.groupBy("doc", "page_no", "field").agg(F.min("group_id").alias("group_id"), F.sort_array(F.collect_list(F.struct("value", "source", "n", "row_id"))).alias("claims")).select("group_id", "field", "claims")


def _supports(b: pa.RecordBatch, weight: dict[tuple[str, str], float]):
    """Of a batch of packed claims: (claims, field of each, first claim of each value, first value of each group, support of each value)."""
    lists = b.column(2)
    claims_, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
    group = np.repeat(np.arange(len(sizes)), sizes)
    source, field = claims_.field("source").dictionary_encode(), b.column(1).dictionary_encode()
    table = np.array([[weight[s, f] if (s, f) in weight else 0.0 for f in field.dictionary.to_pylist()] for s in source.dictionary.to_pylist()])
    code, of = source.indices.to_numpy(), field.indices.to_numpy()[group]
    value, n = (claims_.field(k).to_numpy(zero_copy_only=False) for k in ("value", "n"))
    new = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (value[1:] != value[:-1])))
    votes_ = np.add.reduceat(n * table[code, of], new)
    first = np.flatnonzero(np.append(True, group[new][1:] != group[new][:-1]))
    share = votes_ / np.repeat(np.add.reduceat(votes_, first), np.diff(np.append(first, len(new))))
    return claims_, source, field, code, of, n, new, first, share


def means(p: DataFrame, shared) -> DataFrame:
    """(source, field, s, n): the sums of the supports of each source's claims, and their number, over packed claims. Nothing is moved but a
    row for each task and source."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            _, source, field, code, of, n, new, _, share = _supports(b, shared.value)
            share = np.repeat(share, np.diff(np.append(new, len(n))))
            names, fields = source.dictionary.to_pylist(), field.dictionary.to_pylist()
            at = code * len(fields) + of
            s, k = np.bincount(at, n * share), np.bincount(at, n)
            hit = np.flatnonzero(k)
            yield pa.RecordBatch.from_arrays([pa.array([names[i // len(fields)] for i in hit]), pa.array([fields[i % len(fields)] for i in hit]), pa.array(s[hit]), pa.array(k[hit].astype(np.int64))], ["source", "field", "s", "n"])

    return p.mapInArrow(run, "source string, field string, s double, n long")


def highest(p: DataFrame, shared) -> DataFrame:
    """(group_id, field, value_from, support) of packed claims."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            claims_, _, _, _, _, n, new, first, share = _supports(b, shared.value)
            row = np.minimum.reduceat(claims_.field("row_id").to_numpy(zero_copy_only=False), new)
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(new))))
            order = np.lexsort((row, -np.round(share, 9), group))
            best = order[np.searchsorted(group, np.arange(len(first)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(row[best]), pa.array(np.round(share[best], 6))], ["group_id", "field", "value_from", "support"])

    return p.mapInArrow(run, "group_id long, field string, value_from long, support double")


def discover(rows: DataFrame, rounds: int = ROUNDS, moved: float = MOVED) -> tuple[DataFrame, DataFrame]:
    """Iterative truth discovery: (survivors, weights).

    Alternately, a value's support is its share of the votes weighted by source, and a source's reliability is the mean support of its
    claims, weighted as -log(1 - reliability); it ends when no reliability moves by more than ``moved``, and
    raises if one still does after ``rounds``. survivors:
    (group_id, field, value_from, support), the highest-supported value of each field of each group of at least two rows, ties to
    the smallest row_id; groups in which no row supplies a field have no row for it. weights: (source, field, weight).

    Claims are counted before any shuffle of a round. Groups of up to PACKED_CLAIMS of them are written as a row of arrays each, and a round
    over them is one narrow pass that sends a row for each task and source; the claims of larger groups, hot ones among them, stay rows
    and are summed map-side. Of each round only the sources' weights remain, a row for each source and field, so no lineage grows.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy("doc", "page_no").agg(F.count("*").alias("rows"), F.min("row_id").alias("group_id")).where("rows >= 2").drop("rows")
    c = written(claims(rows).join(sizes, ["doc", "page_no"]), "claims")
    sources = written(c.select("source", "field").distinct(), "sources")
    many = sources.count() > BROADCAST_SOURCES
    weigh = (-F.log(1 - F.least(F.greatest(F.col("r"), F.lit(1e-3)), F.lit(0.999)))).alias("weight")
    keys = ["doc", "page_no", "field"]
    large = written(c.groupBy(*keys).count().where(F.col("count") > PACKED_CLAIMS).select(*keys), "large-groups")
    some_large = many or not large.isEmpty()
    p = None if many else written(packed(c, large if some_large else None), "packed-claims")
    rest = (c if many else c.join(large, keys, "left_semi")) if some_large else None

    def by_join(w: DataFrame) -> DataFrame:
        v = votes(rest, w).drop("row_id")
        return rest.join(v, [*keys, "value"]).groupBy("source", "field").agg(F.sum(F.col("n") * F.col("support")).alias("s"), F.sum("n").alias("n"))

    now, change, done = sources.withColumn("r", F.lit(0.8)), math.inf, 0
    while True:
        w = now.select("source", "field", weigh)
        known = None
        if not many:
            known = {(r.source, r.field): r.weight for r in w.collect()}  # at most BROADCAST_SOURCES rows
            w = F.broadcast(spark.createDataFrame([(*k, v) for k, v in known.items()], "source string, field string, weight double"))
            if not known:
                change = 0.0
        shared = spark.sparkContext.broadcast(known)
        if change <= moved:
            break
        if done == rounds:
            raise RuntimeError(f"reliabilities still move by {change:.2g} after {rounds} rounds")
        done += 1
        sums = [by_join(w)] if rest is not None else []
        sums += [means(p, shared)] if p is not None else []
        new = sums[0] if len(sums) == 1 else sums[0].unionByName(sums[1])
        new = written(new.groupBy("source", "field").agg((F.sum("s") / F.sum("n")).alias("r")), "reliabilities")
        change = new.join(now.withColumnRenamed("r", "before"), ["source", "field"]).agg(F.max(F.abs(F.col("r") - F.col("before")))).collect()[0][0] or 0.0
        now = new
    parts = [highest(p, shared)] if p is not None else []
    if rest is not None:
        groups = rest.groupBy(*keys).agg(F.min("group_id").alias("group_id"))
        best = votes(rest, w).groupBy(*keys).agg(F.max(F.struct(F.round("support", 9).alias("support"), (-F.col("row_id")).alias("row"))).alias("b"))
        parts.append(best.join(groups, keys).select("group_id", "field", (-F.col("b.row")).alias("value_from"), F.round("b.support", 6).alias("support")))
    return (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])), w
