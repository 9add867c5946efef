"""Record-level operators: addresses, sidecars, validation ledger, sparse column moments, standardisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Caption kinds with their codes (fixed values).
CAPTION_TYPES = {"tag": 0, "short": 1, "medium": 2, "long": 3}
#: A side is broadcast only if its rows, counted, are at most this many.
BROADCAST_ROWS = 200_000


def small(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a side for broadcast if counting finds it small; else the join shuffles."""
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side


def addressed(df: DataFrame, row: str, shard_size: int) -> DataFrame:
    return df.withColumn("shard_id", F.expr(f"{row} div {shard_size}")).withColumn("local_row", F.pmod(F.col(row), F.lit(shard_size)).cast("bigint"))


def attach(df: DataFrame, side: DataFrame, key: str, column: str, size: int) -> DataFrame:
    """Left join of an optional sidecar: zeros and present = false where it is missing."""
    marked = side.withColumn("present", F.lit(True))
    zeros = F.array_repeat(F.lit(0.0), size)
    return df.join(marked, key, "left").withColumn(column, F.coalesce(F.col(column), zeros)).withColumn("present", F.coalesce("present", F.lit(False)))


def todo(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of the source that the sidecar hasn't got."""
    return source.join(done.select(key).distinct(), key, "left_anti")


def reason(key: Column, kind: Column, caption: Column) -> Column:
    """First rule that fails, or null."""
    empty = F.coalesce(caption, F.lit("")) == ""
    known = F.coalesce(kind.isin(*CAPTION_TYPES), F.lit(False))
    return F.when(F.coalesce(key, F.lit("")) == "", "bad_record").when(~known | empty, F.when(~empty, "bad_caption_type").otherwise("empty_caption"))


def ledger(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, failures (key, reason)) of rows that carry a reason."""
    return df.filter("reason is null").drop("reason"), df.filter("reason is not null").select("key", "reason")


def variable_columns(coo: DataFrame, row: str, column: str, value: str, names: DataFrame, name: str, k: int, scale: float = 1e4) -> DataFrame:
    """The k columns of greatest population variance of log1p(value * scale), absent entries being zeros; ties to the smaller name."""
    n = coo.select(row).distinct().count()
    x = F.log1p(F.col(value) * F.lit(scale)) if scale > 0 else F.col(value)
    moments = coo.groupBy(column).agg(F.sum(x).alias("s"), F.sum(x * x).alias("ss"))
    v = names.join(moments, F.col(name) == F.col(column), "left").select(name, (F.coalesce("s", F.lit(0.0)) / max(1, n)).alias("mean"), (F.coalesce("ss", F.lit(0.0)) / max(1, n)).alias("square"))
    v = v.withColumn("var", F.col("square") - F.col("mean") * F.col("mean"))
    return v.orderBy(F.desc(F.round("var", 9)), name).limit(k).drop("square")


def standardised(df: DataFrame, key: str, column: str, floor: float = 1e-6) -> DataFrame:
    """(x - mean) / std by component; population std, 1 where it is below floor. Only one row a component is gathered."""
    stats = df.select(F.posexplode(column).alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd")).orderBy("pos").collect()
    mu = F.array(*[F.lit(r["mu"]) for r in stats])
    sd = F.array(*[F.lit(1.0 if r["sd"] < floor else r["sd"]) for r in stats])
    return df.withColumn("z", F.transform(column, lambda x, i: (x - F.get(mu, i)) / F.get(sd, i)))


def crop_geometry(width: Column, height: Column, size: int) -> dict[str, Column]:
    """Shorter side to size, then a centre crop."""
    short = F.least(width, height)
    w, h = F.bround(width * F.lit(float(size)) / short, 0).cast("int"), F.bround(height * F.lit(float(size)) / short, 0).cast("int")
    return {"new_w": w, "new_h": h, "left": F.floor((w - size) / 2).cast("int"), "top": F.floor((h - size) / 2).cast("int")}
