"""Table access and small helpers shared by all operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.session import ship


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``, with filters and columns left to the scan."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset it is a folder of this machine, on a local master only: a
    cluster's executors do not share one, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = known.get() if known.isDefined() else f"file://{tempfile.gettempdir()}/vellum-{os.getuid()}"
    return folder.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and returns the table read again.

    It cuts the lineage: a lost executor never makes an earlier iteration run again. The tables lie in one folder per
    application, and ``drop_written`` or the end of the cluster's retention removes them.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Deletes every table that ``written`` made in this application."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/vellum-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, among the tables of ``written``."""
    return f"{shared_folder(spark)}/vellum-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex[:12]}"


def latest_rows(df: DataFrame, key: str = "row_id") -> DataFrame:
    """One row for each ``key``: a repeated key is the same row delivered again. Null keys are kept as they are."""
    return df.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(df.where(F.col(key).isNull()))
