"""The job queue as tables: latest state, next job, recovery, idempotent batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(jobs: DataFrame) -> DataFrame:
    """The last version of each job by updated_at, ties by status."""
    rest = [c for c in jobs.columns if c != "id"]
    g = jobs.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("updated_at", "status")).alias("r"))
    return g.select("id", *(F.col("r")[c].alias(c) for c in rest))


def next_pending(jobs: DataFrame) -> DataFrame:
    """The oldest pending job: one row, or none."""
    return latest(jobs).where("status = 'pending'").orderBy("id").limit(1)


def claim(jobs: DataFrame, n: int = 1) -> DataFrame:
    """The first n pending jobs, in order."""
    return latest(jobs).where("status = 'pending'").orderBy("id").limit(n)


def requeued(jobs: DataFrame) -> DataFrame:
    """Jobs as they stand after a restart: running ones are pending again."""
    return latest(jobs).withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")))


def state_counts(jobs: DataFrame) -> DataFrame:
    return latest(jobs).groupBy("status").agg(F.count("*").alias("n"))


def newest(jobs: DataFrame, n: int = 50) -> DataFrame:
    """The n jobs made last: a list, newest first."""
    return latest(jobs).orderBy(F.col("id").desc()).limit(n)
