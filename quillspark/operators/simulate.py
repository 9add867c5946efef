"""Simulators over vector columns: Euler steps as one aggregate() over a step sequence, so plans don't grow with steps.

A score is any function (component x, time t, index i) -> Column; models that need NumPy run through `simulate_numpy`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.bridge import Process, forward_score, reverse_score, vp

Score = Callable[[Column, Column, Column], Column]
Noise = Callable[[Column, Column], Column]


def euler(x0: Column, p: Process, score: Score, steps: int, reverse: bool = False, noise: Noise | None = None, start: float | None = None, stop: float | None = None) -> Column:
    """State after `steps` steps from start to stop (0 to 1, or 1 to 0 in reverse); noise(step, index) is standard normal."""
    if steps <= 0 or (start is not None and start == stop):
        return x0
    a = start if start is not None else (1.0 if reverse else 0.0)
    b = stop if stop is not None else (0.0 if reverse else 1.0)
    if (b < a) != reverse:
        raise ValueError("start and stop must run in the simulated direction")
    dt = abs(b - a) / steps
    sign = 1.0 if reverse else -1.0

    def step(x: Column, k: Column) -> Column:
        t = F.lit(a) + (F.lit(b - a) * k) / F.lit(float(steps))
        s = p.sigma(t)

        def move(v: Column, i: Column) -> Column:
            out = v + F.lit(sign * p.drift * dt) * v + s * s * score(v, t, i) * F.lit(dt)
            return out + s * F.lit(dt**0.5) * noise(k, i) if noise is not None else out

        return F.transform(x, move)

    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), x0, step)


def probability_flow(x0: Column, p: Process, score: Score, steps: int, start: Column, noise: Noise, reverse: bool = False) -> Column:
    """Deterministic transport by half of sigma squared times the difference of score and the base process's own score.

    The base score is singular at the start: the first step is a stochastic one. start is the vector x0 began from; the
    process must have no drift.
    """
    if p.drift:
        raise ValueError("the probability flow needs a process without drift")
    dt = 1.0 / steps

    def step(x: Column, k: Column) -> Column:
        t = F.lit(1.0) - k / F.lit(float(steps)) if reverse else k / F.lit(float(steps))
        s = p.sigma(t)

        def move(v: Column, i: Column) -> Column:
            own = F.get(start, i)
            base = forward_score(p, v, own, t, 1.0) if reverse else reverse_score(p, v, own, t)
            first = s * s * score(v, t, i) * F.lit(dt) + s * F.lit(dt**0.5) * noise(k, i)
            return v + F.when(k == 0, first).otherwise(F.lit(0.5) * s * s * (score(v, t, i) - base) * F.lit(dt))

        return F.transform(x, move)

    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), x0, step)


def euler_path(x0: Column, p: Process, score: Score, steps: int) -> Column:
    """All states of a noise-free forward run, the start first: array of vectors."""
    dt = 1.0 / steps

    def step(path: Column, k: Column) -> Column:
        t = k / F.lit(float(steps))
        s = p.sigma(t)
        return F.concat(path, F.array(F.transform(F.element_at(path, -1), lambda v, i: v + s * s * score(v, t, i) * F.lit(dt))))

    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.array(x0), step)


def snapshot(k: Column, steps: int, every: int) -> Column:
    """Step index k (0-based) is kept: each `every`-th step, and the last."""
    return (F.pmod(k + 1, F.lit(every)) == 0) | (k == steps - 1)


def flow(x0: Column, velocity: Score, steps: int, reverse: bool = False, ascending: bool = False) -> Column:
    """Euler on a velocity field; in reverse time falls and the field is followed backwards.

    `ascending` asks for the single-cell convention: time rises and the field is followed forwards in both directions.
    """
    back = reverse and not ascending

    def step(x: Column, k: Column) -> Column:
        t = k / F.lit(float(steps))
        t = F.lit(1.0) - t if back else t
        return F.transform(x, lambda v, i: v + F.lit((-1.0 if back else 1.0) / steps) * velocity(v, t, i))

    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), x0, step)


def denoise(x: Column, predict: Score, steps: int, top: float = 0.99) -> Column:
    """Deterministic noise-to-data sampler from t = top to 0."""
    def step(v: Column, k: Column) -> Column:
        t, u = F.lit(top) * (F.lit(1.0) - k / F.lit(float(steps))), F.lit(top) * (F.lit(1.0) - (k + 1) / F.lit(float(steps)))
        (a, s), (a2, s2) = vp(t), vp(u)

        def move(c: Column, i: Column) -> Column:
            e = predict(c, t, i)
            return a2 * ((c - s * e) / F.greatest(a, F.lit(1e-3))) + s2 * e

        return F.transform(v, move)

    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), x, step)


def replay(x0: Column, increments: Column, p: Process, score: Score, steps: int) -> Column:
    """Runs forward with given Brownian increments: increments[step][component]."""
    dt = 1.0 / steps

    def step(x: Column, k: Column) -> Column:
        t = k / F.lit(float(steps))
        s = p.sigma(t)
        return F.transform(x, lambda v, i: v + s * s * score(v, t, i) * F.lit(dt) + s * F.get(F.get(increments, k), i))

    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), x0, step)


def simulate_numpy(df: DataFrame, column: str, out: str, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Any NumPy sampler over blocks of vectors (rows, dim); all other columns pass."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(column).to_pylist(), float).reshape(batch.num_rows, -1)
            y = kernel(x) if len(x) else x
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(y), arrow.field(out).type)], schema=arrow)

    return df.mapInArrow(run, schema)
