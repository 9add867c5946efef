"""A watchdog over streams of logging windows: an alarm at each slow window that makes a run of `most` or more in a row.

The state of a series is its present run, so it is one row however long the stream; it lives in the state store and goes on
over restarts. Windows of a series must come in the order of their steps; one that comes again, or late, is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ALARMS = "series string, step bigint, first_step bigint, length bigint"
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Watchdog(StatefulProcessor):
    def __init__(self, threshold: float, most: int):
        self.threshold, self.most = threshold, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "length bigint, first bigint, last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        length, first, last = self.run.get() if self.run.exists() else (0, None, None)
        windows = pd.concat(list(rows)).sort_values("step", kind="stable")
        alarms = []
        for step, value in zip(windows["step"].tolist(), windows["value"].tolist()):
            if last is not None and step <= last:
                continue
            last = step
            if value < self.threshold:
                length, first = length + 1, first if length else step
                if length >= self.most:
                    alarms.append((key[0], step, first, length))
            else:
                length = 0
        if last is not None:
            self.run.update((length, first, last))
        yield pd.DataFrame(alarms, columns=["series", "step", "first_step", "length"])

    def close(self) -> None:
        pass


def alarms(stream: DataFrame, threshold: float, most: int) -> DataFrame:
    """stream: series string, step bigint, value double (null series or steps take no part; a null value is not slow).

    State of this kind needs the RocksDB store: set STORE to ROCKS while the query starts, as watch does.
    """
    rows = stream.filter("series is not null and step is not null").withColumn("value", F.coalesce("value", F.lit(float("inf"))))
    return rows.groupBy("series").transformWithStateInPandas(statefulProcessor=Watchdog(threshold, most), outputStructType=ALARMS, outputMode="Append", timeMode="None")


def batch_alarms(windows: DataFrame, threshold: float, most: int) -> DataFrame:
    """The same of a finished log: a row of a series' windows, in order, is a partition."""
    order = Window.partitionBy("series").orderBy("step")
    marked = windows.filter("series is not null and step is not null").withColumn("slow", F.coalesce(F.col("value") < threshold, F.lit(False)))
    group = marked.withColumn("g", F.sum(F.when(F.col("slow"), 0).otherwise(1)).over(order)).filter("slow")
    run = Window.partitionBy("series", "g").orderBy("step")
    counted = group.withColumn("length", F.row_number().over(run).cast("bigint")).withColumn("first_step", F.min("step").over(run))
    return counted.filter(F.col("length") >= most).select("series", F.col("step").cast("bigint").alias("step"), F.col("first_step").cast("bigint").alias("first_step"), "length")


def watch(spark: SparkSession, source: str, out: str, checkpoint: str, threshold: float, most: int, files_per_trigger: int = 100) -> None:
    """Reads the window files (series, step, value) that are new and writes their alarms, a folder a batch."""
    stream = spark.readStream.schema("series string, step bigint, value double").option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    write = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}")
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        q = alarms(stream, threshold, most).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(STORE, before)
