"""Clone-conditioned endpoint pairs and leakage-free splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import det
from quillspark.operators.indexing import order_cuts

#: Fixed value: what counts as a number in a time label.
NUMBER = r"[-+]?(?:\d*\.\d+|\d+)"


def first_number(text: Column) -> Column:
    """First number in a text, else NaN."""
    found = F.nullif(F.regexp_extract(text, NUMBER, 0), F.lit(""))
    return F.coalesce(found.try_cast("double"), F.lit(float("nan")))


def close(a: Column, b) -> Column:
    """|a - b| <= 1e-8 + 1e-5 |b|; NaN is close to nothing."""
    b = F.lit(float(b))
    return ~F.isnan(a) & (F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b))


def endpoints(df: DataFrame, time: Column, clone: str, early: float, late: float) -> DataFrame:
    """Rows of an assigned clone at one of the two times, with time_numeric and side."""
    t = df.withColumn("time_numeric", time).filter(F.col(clone).isNotNull())
    return t.withColumn("side", F.when(close(F.col("time_numeric"), early), "e").when(close(F.col("time_numeric"), late), "l")).filter("side is not null")


def assign_clones(coo: DataFrame, row: str, clone: str, allow_multi: bool = False) -> DataFrame:
    """Per row: its only clone; with several the first stored one if allowed, else none."""
    keep = F.col("n_clones") == 1 if not allow_multi else F.col("n_clones") >= 1
    return clone_counts(coo, row, clone).select(row, "n_clones", F.when(keep, F.col("first_clone")).alias("clone_id"))


def clone_counts(coo: DataFrame, row: str, clone: str) -> DataFrame:
    """Per row: how many clones it has, and the first stored one."""
    return coo.groupBy(row).agg(F.countDistinct(clone).alias("n_clones"), F.min(clone).alias("first_clone"))


def _first_ranks(cells: DataFrame, clone: str, cell: str, seed: int, most: int) -> DataFrame:
    """Rank of the first `most` cells of each clone and side by digest; each task keeps only these before the shuffle."""
    order = Window.partitionBy(clone, "side").orderBy("_h", cell)
    held = cells.withColumn("_h", det.digest(seed, "rank", F.col("side"), F.col(cell)))
    return held.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).withColumn("r", (F.col("r") - 1).cast("bigint")).drop("_h")


def _ranked(cells: DataFrame, clone: str, cell: str, seed: int) -> DataFrame:
    """Rank of each cell within its clone and side by digest. A clone is ranked in 256 slices, so a large one is spread."""
    h = det.digest(seed, "rank", F.col("side"), F.col(cell))
    cut = cells.withColumn("_h", h).withColumn("_s", F.substring("_h", 1, 2))
    sizes = cut.groupBy(clone, "side", "_s").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(clone, "side").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # at most 256 rows
    offsets = sizes.select(clone, "side", "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(clone, "side", "_s").orderBy("_h", cell)) - 1
    return cut.withColumn("_in", inside).join(offsets, [clone, "side", "_s"]).withColumn("r", (F.col("_in") + F.col("_before")).cast("bigint")).drop("_h", "_s", "_in", "_before")


def eligible(cells: DataFrame, clone: str, least: int) -> DataFrame:
    g = cells.groupBy(clone).agg(F.sum((F.col("side") == "e").cast("bigint")).alias("n_early"), F.sum((F.col("side") == "l").cast("bigint")).alias("n_late"))
    return g.filter((F.col("n_early") >= least) & (F.col("n_late") >= least))


def sampled_pairs(cells: DataFrame, clone: str, cell: str, per_clone: int, seed: int = 0, least: int = 1) -> DataFrame:
    """per_clone pairs a clone: each side drawn on its own, with replacement only where it is smaller than per_clone."""
    ok = eligible(cells, clone, least)
    ranked = _first_ranks(cells.join(ok.select(clone), clone), clone, cell, seed, per_clone)
    draws = ok.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(per_clone - 1).cast("bigint"))))
    for side, n in (("e", "n_early"), ("l", "n_late")):
        again = det.below(det.digest(seed, "draw" + side, F.col(clone), F.col("k")), F.col(n))
        draws = draws.withColumn("r" + side, F.when(F.col(n) >= per_clone, F.col("k")).otherwise(again))
    early = ranked.filter("side = 'e'").select(clone, F.col("r").alias("re"), F.col(cell).alias("early_id"))
    late = ranked.filter("side = 'l'").select(clone, F.col("r").alias("rl"), F.col(cell).alias("late_id"))
    return draws.join(early, [clone, "re"]).join(late, [clone, "rl"]).select(clone, "k", "early_id", "late_id")


def all_pairs(cells: DataFrame, clone: str, cell: str, most: int, seed: int = 0, least: int = 1) -> DataFrame:
    """The cross product of a clone's sides; of more than `most` pairs so many are drawn without replacement.

    Pairs are numbered, and a keyed permutation of the numbers gives the drawn ones: never more rows than it returns.
    """
    ok = eligible(cells, clone, least)
    ranked = _ranked(cells.join(ok.select(clone), clone), clone, cell, seed)
    size = F.col("n_early") * F.col("n_late")
    kept = F.least(size, F.lit(most).cast("bigint"))
    draws = ok.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), kept - 1)))
    at = F.when(size > most, det.permuted(seed, "pairs", F.col(clone), F.col("k"), size)).otherwise(F.col("k"))
    draws = draws.withColumn("at", at).withColumn("re", F.expr("at div n_late")).withColumn("rl", F.pmod("at", F.col("n_late")))
    early = ranked.filter("side = 'e'").select(clone, F.col("r").alias("re"), F.col(cell).alias("early_id"))
    late = ranked.filter("side = 'l'").select(clone, F.col("r").alias("rl"), F.col(cell).alias("late_id"))
    return draws.join(early, [clone, "re"]).join(late, [clone, "rl"]).select(clone, "k", "early_id", "late_id")


def split_sizes(n: int, test: float, reserve: float) -> tuple[int, int, int]:
    """(reserve, test, train): halves round to even, at least one each of n >= 3, and a train group always remains."""
    def want(f: float) -> int:
        return max(1, round(n * f)) if n >= 3 and f > 0 else 0

    r = min(want(reserve), max(0, n - 1))
    t = min(want(test), max(0, n - 1 - r))
    return r, t, n - r - t


def group_split(groups: DataFrame, key: str, test: float = 0.1, reserve: float = 0.1, seed: int = 0) -> DataFrame:
    """(key, split): 2 reserved, 1 test, 0 train; whole groups, by the order of their digests."""

    def ranks(n: int) -> list[int]:
        r, t, _ = split_sizes(n, test, reserve)
        return [r, r + t]

    reserved, tested = order_cuts(groups, det.digest(seed, "split", F.col(key)), key, ranks)
    return groups.select(key, F.when(reserved, 2).when(tested, 1).otherwise(0).alias("split"))
