"""Orphan references: keys that point to rows which are missing, deleted or created later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key that holds more than one part in HOT_SHARE of all references is spread over SALTS tasks, so at most HOT_SHARE keys are hot.
HOT_SHARE = 1000
SALTS = 32


def month(seconds: Column) -> Column:
    """The UTC month YYYY-MM of epoch seconds, null for null. Computed from days, so the session's time zone has no part in it."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")), "yyyy-MM")


def validity(parents: DataFrame, removals: DataFrame) -> DataFrame:
    """The interval of each parent key: (kind, scope, key, born, last, gone).

    ``parents``: (kind, scope, key, at), a row for each version; ``removals``: (kind, scope, key, at). born and last are the
    first and last creation, gone is the last removal. A key known only by a removal is there with born null. Rows with
    a null key name nothing and are left out; a null time counts as no time (a parent with no time was always there).
    """
    rows = parents.where(F.col("key").isNotNull()).select("kind", "scope", "key", F.coalesce("at", F.lit(float("-inf"))).alias("up"), F.lit(None).cast("double").alias("down"))
    rows = rows.unionByName(removals.where(F.col("key").isNotNull() & F.col("at").isNotNull()).select("kind", "scope", "key", F.lit(None).cast("double").alias("up"), F.col("at").alias("down")))
    return rows.groupBy("kind", "scope", "key").agg(F.min("up").alias("born"), F.max("up").alias("last"), F.max("down").alias("gone"))


def dangling(references: DataFrame, parents: DataFrame, removals: DataFrame) -> DataFrame:
    """Every reference whose key has no valid parent, with its reason: all columns of ``references`` and ``reason``.

    ``references``: any columns with (kind, scope, key, at, salt_by); a null key is no reference. The result is, for each
    row of ``references``,

    * ``deleted``: a removal names the key and no version was created at or after the last removal;
    * ``missing``: else, no version exists;
    * ``later``: else, the first version was created after the reference (never where its time is null);
    * and no row where the parent was there.

    References and parents' intervals are co-partitioned by key, sorted, and merged in one linear pass (a merge join). The
    intervals are unique by key, so nothing multiplies. A hot key's references are spread over SALTS tasks by ``salt_by`` and
    only its one interval is repeated; hot keys are those above 1/HOT_SHARE of all references, so at most HOT_SHARE of
    them are broadcast whatever the data's size. Repeated reference rows are kept as often as they are given.
    """
    refs = references.where(F.col("key").isNotNull())
    match = ["kind", "scope", "key"]
    known = validity(parents, removals)
    least = refs.count() / HOT_SHARE
    hot = refs.groupBy(*match).agg(F.count("*").alias("n")).where(F.col("n") > least).select(*match).collect()  # fewer than HOT_SHARE rows
    if hot and least >= 1:
        hot = refs.sparkSession.createDataFrame([(*h, SALTS) for h in hot], ", ".join(f"{c} string" for c in match) + ", salts int")
        salted = refs.join(F.broadcast(hot), on=match, how="left")
        salted = salted.withColumn("salt", F.pmod(F.xxhash64("salt_by"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        known = known.join(F.broadcast(hot), on=match, how="left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    else:
        salted, known = refs.withColumn("salt", F.lit(0)), known.withColumn("salt", F.lit(0))
    merged = salted.hint("merge").join(known, on=[*match, "salt"], how="left")
    gone = F.col("gone").isNotNull() & (F.col("last").isNull() | (F.col("last") < F.col("gone")))
    reason = F.when(gone, "deleted").when(F.col("born").isNull(), "missing").when(F.col("born") > F.col("at"), "later")
    return merged.withColumn("reason", reason).where("reason is not null").drop("salt", "born", "last", "gone")


def record_references(records: DataFrame, jobs: DataFrame, users: DataFrame, removals: DataFrame) -> DataFrame:
    """The dangling references of records: (row_id, field_name, reason, period), each case once.

    job_id names jobs.id, part_of a human_id within the same job_id, reviewed_by users.id. A repeated row_id gives its
    cases once. Null and empty values are no references; a part_of without a job_id is looked up among records without
    a job_id and so is never found by accident. Empty tables give no rows (no parents: every reference is missing).
    """
    r = records.select("row_id", "job_id", "human_id", "part_of", "reviewed_by", "created_at", "reviewed_at")
    none = F.lit("")  # scope of keys that have none; joins compare it like any value
    job = F.coalesce(F.col("job_id").cast("string"), none)
    one = lambda kind, scope, key, at: F.struct(F.lit(kind).alias("kind"), scope.alias("scope"), key.alias("key"), at.alias("at"))
    each = F.array(
        one("job_id", none, F.col("job_id").cast("string"), F.col("created_at")),
        one("part_of", job, F.nullif(F.col("part_of"), none), F.col("created_at")),
        one("reviewed_by", none, F.col("reviewed_by").cast("string"), F.coalesce("reviewed_at", "created_at")),
    )
    refs = r.withColumn("x", F.explode(F.filter(each, lambda x: x["key"].isNotNull()))).select("row_id", F.col("created_at"), "x.*", F.col("row_id").alias("salt_by"))
    parents = (
        jobs.select(F.lit("job_id").alias("kind"), none.alias("scope"), F.col("id").cast("string").alias("key"), F.col("created_at").alias("at"))
        .unionByName(r.select(F.lit("part_of").alias("kind"), job.alias("scope"), F.nullif(F.col("human_id"), none).alias("key"), F.col("created_at").alias("at")))
        .unionByName(users.select(F.lit("reviewed_by").alias("kind"), none.alias("scope"), F.col("id").cast("string").alias("key"), F.col("created_at").alias("at")))
    )
    kinds = F.when(F.col("table_name") == "jobs", "job_id").when(F.col("table_name") == "records", "part_of").when(F.col("table_name") == "users", "reviewed_by")
    scope = F.when(F.col("table_name") == "records", F.coalesce(F.col("job_id").cast("string"), none)).otherwise(none)
    gone = removals.select(kinds.alias("kind"), scope.alias("scope"), F.col("key_text").alias("key"), F.col("removed_at").alias("at")).where("kind is not null")
    found = dangling(refs, parents, gone)
    return found.select("row_id", F.col("kind").alias("field_name"), "reason", month(F.col("created_at")).alias("period")).distinct()


def report(found: DataFrame) -> DataFrame:
    """Orphans per field, reason and period: (field_name, reason, period, n)."""
    return found.groupBy("field_name", "reason", "period").agg(F.count("*").alias("n"))
