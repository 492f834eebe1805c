"""The queue as a stream: an append-only folder of jobs, each handled once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOB = "id BIGINT, filename STRING, input_path STRING, source_doc STRING, status STRING, output_path STRING, error STRING, created_at DOUBLE, updated_at DOUBLE, kind STRING, payload STRING, created_by INT"


def incoming(spark: SparkSession, folder: str, schema: str = JOB) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def once_each(events: DataFrame, id_: str, at: str, late: str = "1 hour") -> DataFrame:
    """Events without repeats of an id within the watermark; state is dropped as the watermark moves on."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([id_])


def windowed(events: DataFrame, at: str, size: str, *keys: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums of value by event-time window; later rows than the watermark are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Handles all that is there and ends; after a crash the checkpoint replays the batch, so ``handle`` must be idempotent."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def dispatch(handlers: dict[str, Callable[[DataFrame], DataFrame]], path: str) -> Callable[[DataFrame, int], None]:
    """A batch handler: pending jobs go by kind to their handler, whose rows are written under the batch's number; a batch that is
    replayed overwrites its own rows and no others.

    Where a handler fails, its jobs are run one by one; those that fail again are written as failed with the error, under
    ``kind=failed``, and the others go on. The number of a batch's jobs is bounded by the stream's trigger (maxFilesPerTrigger).
    """

    def run(f, rows: DataFrame, to: str) -> str | None:
        try:
            f(rows).write.mode("overwrite").parquet(to)
        except Exception as e:  # noqa: BLE001 - the error is recorded and the stream goes on
            return str(e).splitlines()[0][:1000] if str(e) else type(e).__name__
        return None

    def handle(batch: DataFrame, number: int) -> None:
        rows, failed = batch.where("status = 'pending'"), []
        for kind, f in handlers.items():
            mine = rows.where(F.col("kind") == kind)
            if run(f, mine, f"{path}/kind={kind}/batch={number}") is None:
                continue
            _remove(batch.sparkSession, f"{path}/kind={kind}/batch={number}")
            for r in mine.select("id").distinct().collect():
                error = run(f, mine.where(F.col("id") == r.id), f"{path}/kind={kind}/batch={number}/job={r.id}")
                if error is not None:
                    _remove(batch.sparkSession, f"{path}/kind={kind}/batch={number}/job={r.id}")
                    failed.append((r.id, "failed", error))
        if failed:
            batch.sparkSession.createDataFrame(failed, "id long, status string, error string").write.mode("overwrite").parquet(f"{path}/kind=failed/batch={number}")

    return handle
