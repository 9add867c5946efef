"""Incremental ingest with Structured Streaming: exactly once a file, accepted rows and failure ledger side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.records import ledger, todo


def exactly_once(prepare: Callable[[DataFrame], DataFrame], out: str, failures: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: prepared rows (a column `reason` marks failures) to two tables.

    Each batch writes below its own id and replaces what a broken attempt left there, so a repeated batch adds nothing.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        held = prepare(batch).persist()  # prepared once for both tables; lost blocks are computed again
        try:
            good, bad = ledger(held)
            good.write.mode("overwrite").parquet(f"{out}/batch={epoch}")
            bad.write.mode("overwrite").parquet(f"{failures}/batch={epoch}")
        finally:
            held.unpersist()

    return write


def ingest(spark: SparkSession, source: str, schema, prepare: Callable[[DataFrame], DataFrame], out: str, failures: str, checkpoint: str, files_per_trigger: int = 100) -> None:
    """Reads the files that are new, prepares them and appends accepted rows and failures."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    q = stream.writeStream.foreachBatch(exactly_once(prepare, out, failures)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def fill_sidecar(source: DataFrame, path: str, key: str, compute: Callable[[DataFrame], DataFrame]) -> int:
    """Computes and appends the sidecar rows that are missing; returns how many there were to do."""
    spark = source.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
    except Exception as missing:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        done = spark.createDataFrame([], source.select(key).schema)
    rest = todo(source, done, key).persist()
    try:
        n = rest.count()
        if n:
            compute(rest).write.mode("append").parquet(path)
        return n
    finally:
        rest.unpersist()


def slow_windows(stream: DataFrame, step: str, value: str, threshold: float, minutes: str = "10 minutes") -> DataFrame:
    """Streaming counterpart of the watchdog's input: mean value by event-time window, marked slow."""
    w = stream.withWatermark(step, minutes).groupBy(F.window(step, minutes)).agg(F.avg(value).alias("v"))
    return w.select("window", "v", (F.col("v") < threshold).alias("slow"))
