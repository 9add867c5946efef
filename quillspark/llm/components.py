"""Connected components by alternating large and small stars (Kiveris et al. 2014): aggregates and joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import _common as C


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of bigints to a staged star forest (node, component): every linked node but the roots, component the smallest node.

    Every round is a minimum by node and a join back, so a node with very many links is never gathered in one task.
    """
    now = C.stage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    while True:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(low, "x").filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v"))).distinct()
        new = C.stage(small)
        C.drop(now)
        before, mark, now = mark, _mark(new), new
        if mark == before:
            return now


def _mark(edges: DataFrame) -> tuple:
    """A digest of a set of links that doesn't depend on order."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
