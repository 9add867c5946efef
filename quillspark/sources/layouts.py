"""Tables laid out for the joins that read them: buckets for gathers by key, shards for reads by row number."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.records import addressed, small
from quillspark.session import scratch

#: Shards whose numbers the driver looks at to prune before the plan; of more, the join prunes while it runs.
FEW_SHARDS = 256


def bucketed(df: DataFrame, key: str, buckets: int, path: str | None = None) -> str:
    """Writes a table in buckets by key, sorted within, a file a bucket; its name. Without a path it goes when the driver ends."""
    name = f"bucketed_{uuid.uuid4().hex}"
    path = path or scratch(df.sparkSession, "buckets")
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return name


def gather(rows: DataFrame, name: str, key: str, columns: dict[str, str], on: str) -> DataFrame:
    """Adds columns (new name: column) of a bucketed table to rows, by rows' column `on`. Only the rows are exchanged, never the table."""
    spark = rows.sparkSession
    found = [r["data_type"] for r in spark.sql(f"describe extended {name}").filter("col_name = 'Num Buckets'").collect()]
    if not found:
        raise ValueError(f"{name} has no buckets")
    side = spark.table(name).select(F.col(key).alias(on), *(F.col(c).alias(new) for new, c in columns.items()))
    return rows.repartition(int(found[0]), on).hint("merge").join(side, on)


def write_shards(df: DataFrame, row: str, shard_size: int, path: str) -> None:
    """A folder a shard; within it rows in order of their place, so that row groups hold ranges of places."""
    placed = addressed(df, row, shard_size).repartition("shard_id").sortWithinPartitions("shard_id", "local_row")
    placed.write.partitionBy("shard_id").parquet(path)


def read_rows(spark: SparkSession, path: str, wanted: DataFrame, row: str, shard_size: int) -> DataFrame:
    """The rows of a sharded table that `wanted` (row numbers in column row) names.

    Of up to FEW_SHARDS shards their numbers and the range of places go into the scan's filters, so other folders are not
    listed as input and row groups outside the range are skipped; beyond that, dynamic pruning by the join leaves out shards.
    """
    places = addressed(wanted.select(row).filter(F.col(row).isNotNull()).distinct(), row, shard_size).drop(row)
    shards = [r["shard_id"] for r in places.select("shard_id").distinct().limit(FEW_SHARDS + 1).collect()]
    held = spark.read.parquet(path)
    if len(shards) <= FEW_SHARDS:
        low, high = places.agg(F.min("local_row"), F.max("local_row")).first()
        held = held.filter(F.col("shard_id").isin(shards) & F.col("local_row").between(low, high) if shards else F.lit(False))
    return held.join(small(places), ["shard_id", "local_row"])
