"""Sinks: sharded tables, configuration guard, gz tables, one-row documents."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.records import addressed

#: Settings that change speed, not content: they take no part in the hash.
SPEED_ONLY = {"batch_size", "num_workers", "prefetch"}


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps({k: v for k, v in config.items() if k not in SPEED_ONLY}, sort_keys=True).encode()).hexdigest()


def settings_hash(settings: dict[str, Column], text: tuple[str, ...] = ()) -> Column:
    """config_hash of settings that stand in columns: whole numbers and, where named in text, ASCII strings."""
    value = lambda k: F.regexp_extract(F.to_json(F.struct(settings[k].alias("x"))), r"^\{\"x\":(.*)\}$", 1) if k in text else settings[k].cast("string")
    items = [F.concat(F.lit(json.dumps(k) + ": "), value(k)) for k in sorted(settings) if k not in SPEED_ONLY]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *items), F.lit("}")), 256)


def guard(df_dir: str, spark, config: dict) -> None:
    """Writes the configuration on the first run; a later run with another content raises."""
    want = config_hash(config)
    try:
        held = spark.read.json(f"{df_dir}/config").first()
    except Exception as missing:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        spark.createDataFrame([(want, json.dumps(config, sort_keys=True))], "hash string, config string").coalesce(1).write.json(f"{df_dir}/config")
        return
    if held["hash"] != want:
        raise ValueError("the folder was written with other settings")


def sharded(df: DataFrame, row: str, shard_size: int, path: str, mode: str = "append") -> None:
    """One folder a shard; committed files only are ever visible."""
    addressed(df, row, shard_size).write.partitionBy("shard_id").mode(mode).parquet(path)


def gz_table(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("compression", "gzip").mode("overwrite").csv(path)


def document(values: dict[str, float], spark, path: str) -> None:
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def prepared(cells: DataFrame, latents: DataFrame, pairs: DataFrame, path: str) -> None:
    """The prepared endpoint dataset: cells, latents and pairs as tables of one folder."""
    for name, df in (("cells", cells), ("latents", latents), ("pairs", pairs)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def pair_dataset(spark, path: str, split: str) -> DataFrame:
    """Pairs of a split with both latents attached; reserved pairs can't be read, an empty split raises."""
    code = {"train": 0, "test": 1}[split]
    p = spark.read.parquet(f"{path}/pairs").filter(F.col("split") == code)
    if not p.limit(1).count():
        raise ValueError(f"split {split} is empty")
    x = spark.read.parquet(f"{path}/latents")
    side = lambda i, v: x.select(F.col("compact_cell_id").alias(i), F.col("latent").alias(v))
    return p.join(side("early_idx", "x_0"), "early_idx").join(side("late_idx", "x_1"), "late_idx")
