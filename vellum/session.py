"""Session settings the engine is designed for."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Runtime SQL settings; each may be changed in a running session.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def build(master: str = "local[*]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session with the engine's settings; on a cluster leave master to spark-submit and pass extra settings."""
    b = SparkSession.builder.master(master).appName("vellum").config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**SETTINGS, **extra}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark context, so that its Python functions can be loaded there. The driver
    serves the archive; no executor reads the driver's disk."""
    context = spark.sparkContext
    if getattr(context, "_vellum_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    files = sorted(os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".py"))
    mark = hashlib.sha1(b"".join(f.encode() + open(f, "rb").read() for f in files)).hexdigest()[:16]
    folder = tempfile.mkdtemp(prefix=f"vellum-{mark}-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(path := os.path.join(folder, "vellum.zip"), "w") as z:
        for f in files:
            z.write(f, os.path.relpath(f, os.path.dirname(root)))
    context.addPyFile(path)
    context._vellum_shipped = True
