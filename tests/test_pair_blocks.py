"""Pair statistics in blocks: values by brute force, and time far below plain differences."""

import time

import numpy as np
import pyarrow as pa
import pytest

from quillspark.operators import metrics


def block(rng, n, dim):
    return rng.normal(size=(n, dim)), rng.integers(0, 2, n)


def batch(u, us, v, vs, same=False):
    row = {"same": same, "u": u.tobytes(), "us": us.tobytes(), "v": v.tobytes(), "vs": vs.tobytes()}
    return pa.RecordBatch.from_pylist([row])


def test_mmd_with_copies_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(metrics, "PAIR_BLOCK", 300)
    monkeypatch.setattr(metrics, "FEW", 40)
    rng = np.random.default_rng(1)
    x, side = block(rng, 900, 5)
    x[100:180] = x[99]  # copies have no distance
    x[200:210] = x[300:310] + 1e-9
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    far = np.sort(d[np.triu_indices(900, 1)])
    far = far[far > 0]
    k = np.exp(-(d**2) / (2 * far[(len(far) - 1) // 2] ** 2))
    a, b = side == 0, side == 1
    want = k[np.ix_(a, a)].mean() + k[np.ix_(b, b)].mean() - 2 * k[np.ix_(a, b)].mean()
    df = spark.createDataFrame([(int(s), i, r.tolist()) for i, (s, r) in enumerate(zip(side, x))], "side long, id long, e array<double>")
    assert metrics.rbf_mmd(df) == pytest.approx(want, abs=1e-10)


def test_tiles_cost_less_than_plain_differences():
    rng = np.random.default_rng(2)
    (u, us), (v, vs) = block(rng, 2048, 64), block(rng, 2048, 64)

    def plain():
        d2 = np.zeros((len(u), len(v)))
        for k in range(64):
            d2 += (u[:, k][:, None] - v[:, k][None, :]) ** 2

    def best(fn):
        took = []
        for _ in range(3):
            start = time.process_time()
            fn()
            took.append(time.process_time() - start)
        return min(took)

    assert best(lambda: [0 for _ in metrics._distances([batch(u, us, v, vs)])]) < best(plain) / 2
