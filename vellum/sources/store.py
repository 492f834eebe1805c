"""Keyed tables in folders: create, swap."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def create_if_missing(spark: SparkSession, path: str, schema: str) -> None:
    """An empty table of a schema where there is none."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        spark.createDataFrame([], schema).write.parquet(path)


def swap(df: DataFrame, path: str) -> None:
    """Writes ``df`` beside ``path`` and then puts it in its place. Between the two renames there is no table at ``path``, and an object store
    copies on rename; where readers must always find a table, use ``publish``."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path + ".new")
    p, fs = _fs(spark, path)
    new, old = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + x) for x in (".new", ".old"))
    fs.delete(old, True)
    if fs.exists(p):
        fs.rename(p, old)
    fs.rename(new, p)
    fs.delete(old, True)


def publish(df: DataFrame, path: str) -> str:
    """Writes ``df`` as a new version under ``path`` and then names it current, in one small file that is written last; returns the version's
    folder. Readers (``current``) see the old version or the new one. Versions are kept, so a run that fails changes nothing."""
    spark = df.sparkSession
    folder = f"{path}/version={uuid.uuid4().hex}"
    df.write.parquet(folder)
    p, fs = _fs(spark, f"{path}/_current-{time.time_ns():020d}")
    out = fs.create(p, False)
    out.write(folder.encode())
    out.close()
    return folder


def current(spark: SparkSession, path: str) -> DataFrame:
    """The version of a published table that was named last."""
    p, fs = _fs(spark, path)
    names = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith("_current-"))
    _, fs = _fs(spark, names[-1])
    data = fs.open(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(names[-1]))
    folder = bytes(x & 0xFF for x in data.readAllBytes()).decode()
    data.close()
    return spark.read.parquet(folder)


def claim(spark: SparkSession, folder: str, job: int) -> bool:
    """Claims a job for this caller: true for one caller only, however many try at once, as a file is created by one alone."""
    p, fs = _fs(spark, f"{folder}/claim-{job}")
    return bool(fs.createNewFile(p))
