"""Perturbation and editing sweeps: token choice, noising, increments, corruption paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import bridge, det
from quillspark.operators import simulate


def chosen_positions(key: Column, valid: Column, k: int, seed: int) -> Column:
    """min(k, valid) distinct positions below valid, by digest, ascending."""
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.greatest(valid - 1, F.lit(0))), lambda i: F.struct(det.digest(seed, "pick", key, i).alias("h"), i.alias("i"))))
    return F.when(valid > 0, F.array_sort(F.transform(F.slice(ranked, 1, k), lambda r: r["i"]))).otherwise(F.array().cast("array<int>"))


def position_table(spark: SparkSession, grid: int, dim: int) -> DataFrame:
    """(row, col, pos array<double>): sin and cos of both coordinates, the column's half first."""
    if dim % 4:
        raise ValueError("dim must be a multiple of 4")
    quarter = dim // 4
    waves = lambda x: F.transform(F.sequence(F.lit(0), F.lit(quarter - 1)), lambda i: x.cast("double") / F.pow(F.lit(10000.0), i.cast("double") / F.lit(float(quarter))))
    half = lambda x: F.concat(F.transform(waves(x), F.sin), F.transform(waves(x), F.cos))
    cells = spark.range(grid * grid).select(F.expr(f"id div {grid}").alias("row"), (F.col("id") % grid).alias("col"))
    return cells.withColumn("pos", F.concat(half(F.col("col")), half(F.col("row"))))


def sampled_time(h: Column, kind: str = "uniform", eps: float = 1e-3, mean: float = 0.0, std: float = 1.0) -> Column:
    """Uniform on (eps, 1 - eps), or logit-normal clipped to it."""
    if kind == "uniform":
        return F.lit(eps) + det.unit(h) * F.lit(1 - 2 * eps)
    if kind == "logit_normal":
        z = F.lit(mean) + F.lit(std) * det.gauss(h)
        return F.least(F.lit(1 - eps), F.greatest(F.lit(eps), F.lit(1.0) / (F.lit(1.0) + F.exp(-z))))
    raise ValueError(f"unknown kind {kind}")


def keeps_condition(h: Column, p_drop: float) -> Column:
    return det.unit(h) > F.lit(p_drop) if p_drop > 0 else F.lit(True)


def process_ends(x0: Column, x1: Column, noise0: Column, noise1: Column, start_as_noise: bool = False, end_as_noise: bool = False) -> dict[str, Column]:
    """Ends of the process, either of which may be noise, and the conditions, which stay the data."""
    return {"x0": noise0 if start_as_noise else x0, "x1": noise1 if end_as_noise else x1, "cond0": x0, "cond1": x1}


def noised(x: Column, far: Column, p: bridge.Process, t, noise: Column) -> Column:
    """Bridge sample at t between x and a far endpoint, which may itself be noise."""
    w0, w1, var = bridge.conditional(p, 0.0, t, 1.0)
    sd = F.sqrt(F.greatest(var, F.lit(0.0)))
    return F.transform(F.arrays_zip(x.alias("a"), far.alias("b"), noise.alias("g")), lambda z: w0 * z["a"] + w1 * z["b"] + sd * z["g"])


def augmented(x: Column, p: bridge.Process, t, noise: Column) -> Column:
    """x + sqrt(C(0, t, t)) noise."""
    sd = F.sqrt(p.cov(0.0, t, t))
    return F.zip_with(x, noise, lambda v, g: v + sd * g)


def inferred_increments(path: Column, p: bridge.Process, score: simulate.Score, steps: int) -> Column:
    """Brownian increments that a path of steps + 1 states implies: dX / sigma - sigma score dt, by step."""
    dt = 1.0 / steps

    def step(k: Column) -> Column:
        t = k / F.lit(float(steps))
        s = p.sigma(t)
        return F.transform(F.get(path, k), lambda v, i: (F.get(F.get(path, k + 1), i) - v) / s - s * score(v, t, i) * F.lit(dt))

    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), step)


def corruption(x: Column, p: bridge.Process, score: simulate.Score, fractions: list[float], base_steps: int) -> list[tuple[float, Column]]:
    """States at ascending fractions of the way, each run on from the one before."""
    out, state, at = [], x, 0.0
    for f in sorted(fractions):
        steps = max(1, round(base_steps * (f - at))) if f > at else 0
        state = simulate.euler(state, p, score, steps, start=at, stop=f)
        out.append((f, state))
        at = f
    return out


def edm_loss(prediction: Column, x: Column, target: Column, c: dict[str, Column]) -> Column:
    """Squared error of the network's effective target (target - c_skip x) / c_out."""
    e = prediction - (target - c["c_skip"] * x) / c["c_out"]
    return e * e


def angle(a: Column, b: Column) -> Column:
    from quillspark.functions import vec

    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), vec.dot(a, b))))


def mean_changed_angle(df: DataFrame, a: str, b: str, least: float = 1e-3) -> DataFrame:
    """Mean angle between unit rows that changed by more than `least`, 0 if none did."""
    x = angle(F.col(a), F.col(b))
    return df.select(x.alias("x")).agg(F.coalesce(F.avg(F.when(F.col("x") > least, F.col("x"))), F.lit(0.0)).alias("angle"), F.count(F.when(F.col("x") > least, 1)).alias("n"))


