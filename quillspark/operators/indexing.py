"""Dense numbering, selection and partitioning by order, without pulling all rows into one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

SLICE_ROWS = 100_000  # rows that are ordered to find a cut


def dense_index(df: DataFrame, key: str, name: str, slices: int | None = None) -> DataFrame:
    """0..n-1 in ascending order of a unique numeric key, like row_number over everything less one.

    Rows fall into slices at approximate quantiles of the key; each slice is numbered alone and shifted by the sizes of
    the slices before it, so only the slice sizes (one row each) meet in one place.
    """
    spark = df.sparkSession
    slices = slices or max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    cuts = df.agg(F.percentile_approx(key, [i / slices for i in range(1, slices)] or [0.5], 10000)).first()[0] or []
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    cut = df.withColumn("_slice", F.size(F.filter(bounds, lambda b: b < F.col(key))))
    sizes = cut.groupBy("_slice").agg(F.count("*").alias("_n"))
    before = sizes.select("_slice", F.coalesce(F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_slice").orderBy(key))
    return cut.withColumn("_in", inside).join(F.broadcast(before), "_slice").withColumn(name, (F.col("_in") - 1 + F.col("_before")).cast("bigint")).drop("_slice", "_in", "_before")


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Distinct labels, sorted, coded 0..k-1."""
    kinds = df.select(F.col(column).alias("label")).distinct()
    return kinds.withColumn("code", (F.row_number().over(Window.orderBy("label")) - 1).cast("bigint"))  # one row a label


def prefix_percent(df: DataFrame, shard: str, filled: Column, pct: float) -> DataFrame:
    """Shards whose exclusive running count of filled rows is below pct percent of the total; larger pct nest smaller."""
    counts = df.groupBy(shard).agg(F.sum(filled.cast("bigint")).alias("n_filled"))
    every = Window.orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    marked = counts.withColumn("before", F.coalesce(F.sum("n_filled").over(every), F.lit(0))).withColumn("total", F.sum("n_filled").over(Window.partitionBy(F.lit(1))))
    return marked.filter(F.col("before") < F.col("total") * F.lit(float(pct)) / F.lit(100.0)).select(shard, "n_filled", "before")


def round_robin(df: DataFrame, key: str, world: int) -> DataFrame:
    return dense_index(df, key, "idx").withColumn("rank", F.pmod("idx", F.lit(world)).cast("int"))


#: Shares of the rows, by key, that are looked at in turn until enough are found.
SHARES = (0.001, 0.01, 0.1)


def first_short(df: DataFrame, key: str, length: Column, most: int, n: int) -> DataFrame:
    """The first n rows by a numeric key (null first) whose length is at most `most`; a row of unknown length is not short.

    Lengths are taken of a first share of the rows, by approximate quantiles of the key, and of a larger one only if
    that holds too few short ones; the key's bound is pushed to the scan.
    """
    cuts = df.approxQuantile(key, list(SHARES), 0.0005) if n > 0 else []
    kind = df.schema[key].dataType
    whole = isinstance(kind, IntegralType)
    for cut in cuts:
        bound = F.lit(int(cut // 1) if whole else cut).cast(kind)  # of the key's own type, or it would not reach the scan
        some = df.filter((F.col(key) <= bound) | F.col(key).isNull()).filter(length <= most)
        if some.limit(n).count() == n:
            return some.orderBy(key).limit(n)
    return df.filter(length <= most).orderBy(key).limit(n)


def order_cuts(df: DataFrame, digest: Column, key: str, ranks: Callable[[int], list[int]]) -> list[Column]:
    """Conditions "among the k least rows by (digest, key)", for the counts k that ranks gives for the number of rows.

    Counts by leading hex digits (at most 65,536 of them reach the driver) find the slice that holds each cut; only the
    rows of that slice are ordered. No task holds the k rows.
    """
    held = df.select(digest.alias("_h"), F.col(key).alias("_k"))
    width = 4

    def counts(prefix: str) -> list:
        size = len(prefix) + width
        rows = held.filter(F.startswith("_h", F.lit(prefix))) if prefix else held
        return sorted((r["p"], r["n"]) for r in rows.groupBy(F.substring("_h", 1, size).alias("p")).agg(F.count("*").alias("n")).collect())

    whole = counts("")
    wanted = ranks(sum(n for _, n in whole))
    slices: list[tuple[str, int] | None] = []
    for k in wanted:
        if k <= 0:
            slices.append(None)
            continue
        found, prefix, left = whole, "", k
        while True:
            for prefix, n in found:
                if left <= n:
                    break
                left -= n
            if n <= SLICE_ROWS or len(prefix) >= 32:
                break
            found = counts(prefix)
        slices.append((prefix, left))
    ends = {}
    for size in {len(s[0]) for s in slices if s}:  # one round for all cuts, but for slices that had to be looked into
        here = [s for s in slices if s and len(s[0]) == size]
        mine = held.withColumn("_p", F.substring("_h", 1, size)).filter(F.col("_p").isin([p for p, _ in here]))
        ranked = mine.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("_h", "_k")))
        asked = F.lit(False)
        for p, left in here:
            asked = asked | ((F.col("_p") == p) & (F.col("_r") == left))
        ends |= {(r["_p"], r["_r"]): (r["_h"], r["_k"]) for r in ranked.filter(asked).collect()}
    below = lambda h, k: (digest < F.lit(h)) | ((digest == F.lit(h)) & (F.col(key) <= F.lit(k)))
    return [below(*ends[s]) if s else F.lit(False) for s in slices]


def best_by_digest(df: DataFrame, digest: Column, key: str, n: int) -> DataFrame:
    """The n rows of least digest (a seeded sample without replacement), in key order."""
    return df.withColumn("_h", digest).orderBy("_h", key).limit(n).drop("_h").orderBy(key)
