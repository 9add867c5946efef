"""Registration of queries with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import vec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", vec.doubles("embedding").alias("e"), F.col("label").cast("bigint").alias("label"))


def r6(c: Column) -> Column:
    """Six decimals; no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


#: The same in SQL, and vectors as doubles.
def q6(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


E = "e as (select vec_id, embedding::double[] as e, label::bigint as label from embeddings)"
