"""Gathers without an exchange of the table, and reads by row number that leave out shards and row groups."""

import re

import pytest
from pyspark.sql import functions as F

from quillspark.sources import layouts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("shuffles", ["4", "64"])
def test_the_table_is_not_exchanged(spark, shuffles):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    try:
        table = layouts.bucketed(spark.range(300).select("id", (F.col("id") * 2).alias("v")), "id", 8)
        rows = spark.range(1000).select((F.col("id") % 310).alias("at"), "id")
        got = layouts.gather(rows, table, "id", {"x": "v"}, "at")
        said = plan(got)
        assert "SortMergeJoin" in said and len(re.findall(r"Exchange hashpartitioning", said)) == 1 and "Bucketed: true" in said
        assert sorted((r["at"], r["x"]) for r in got.collect()) == sorted((i % 310, 2 * (i % 310)) for i in range(1000) if i % 310 < 300)
        twice = layouts.gather(got.select("at", "x"), table, "id", {"y": "v"}, "x")
        assert sorted((r["x"], r["y"]) for r in twice.collect()) == sorted((2 * (i % 310), 4 * (i % 310)) for i in range(1000) if i % 310 < 150)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError, match="no buckets"):
        spark.range(3).createOrReplaceTempView("plain_rows")
        layouts.gather(rows, "plain_rows", "id", {"x": "id"}, "at")


def test_row_numbers_prune_shards_and_groups(spark, tmp_path):
    path = str(tmp_path / "t")
    layouts.write_shards(spark.range(1000).select(F.col("id").alias("row"), (F.col("id") * 3).alias("v")), "row", 100, path)
    wanted = spark.createDataFrame([(110,), (115,), (720,), (115,), (None,), (5000,)], "row long")
    got = layouts.read_rows(spark, path, wanted, "row", 100)
    assert sorted((r["row"], r["v"]) for r in got.collect()) == [(110, 330), (115, 345), (720, 2160)]
    said = plan(got)
    assert re.search(r"PartitionFilters: \[[^]]*shard_id", said)
    assert "GreaterThanOrEqual(local_row" in said and "LessThanOrEqual(local_row" in said
    assert layouts.read_rows(spark, path, wanted.limit(0), "row", 100).count() == 0


def test_many_shards_prune_by_the_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layouts, "FEW_SHARDS", 1)
    path = str(tmp_path / "t")
    layouts.write_shards(spark.range(1000).select(F.col("id").alias("row")), "row", 100, path)
    spark.range(2000).select(F.col("id").alias("row")).write.parquet(str(tmp_path / "w"))
    wanted = spark.read.parquet(str(tmp_path / "w")).filter("row in (5, 205, 999)")
    got = layouts.read_rows(spark, path, wanted, "row", 100)
    assert sorted(r["row"] for r in got.collect()) == [5, 205, 999]
    assert "dynamicpruning" in plan(got)
