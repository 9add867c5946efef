"""Exact order statistics by refined histograms."""

import numpy as np
import pytest

from quillspark.operators import metrics, quantiles


@pytest.mark.parametrize("bins", [16, 256])
def test_order_statistics(spark, monkeypatch, bins):
    monkeypatch.setattr(quantiles, "BINS", bins)
    rng = np.random.default_rng(bins)
    x = np.stack([rng.normal(size=700), np.round(rng.normal(size=700), 1), np.full(700, 3.0), rng.choice([-1e308, 0.0, 1e308], 700), np.exp(30 * rng.normal(size=700)), np.where(rng.random(700) < 0.99, 0.0, rng.normal(size=700))], axis=1)
    df = spark.createDataFrame([(r.tolist(),) for r in x], "e array<double>").repartition(5)
    n, got = quantiles.order_statistics(df, "e", 6, lambda n: [0, 13, n // 2, n - 2, n - 1])
    want = np.sort(x, axis=0)[[0, 13, 350, 698, 699]].T
    assert (n == 700).all() and (got == want).all()


def test_odd_values(spark):
    rows = [([1.0, float("nan")],), ([2.0, float("inf")],), (None,), ([3.0, 5.0],)]
    n, got = quantiles.order_statistics(spark.createDataFrame(rows, "e array<double>"), "e", 2, lambda n: [0, max(0, n - 1)])
    assert n.tolist() == [3, 1] and got.tolist() == [[1.0, 3.0], [5.0, 5.0]]
    n, got = quantiles.order_statistics(spark.createDataFrame(rows, "e array<double>").limit(0), "e", 2, lambda n: [0])
    assert n.tolist() == [0, 0] and np.isnan(got).all()


def test_limits_are_numpys(spark):
    x = np.random.default_rng(3).normal(size=(300, 3))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "e array<double>")
    for n in (300, 10):
        a, b = (np.quantile(x[:n], p, axis=0) for p in (0.02, 0.98)) if n >= 20 else (x[:n].min(axis=0), x[:n].max(axis=0))
        some = df.limit(n) if n < 300 else df
        got = metrics.robust_limits(some, "e", 0.1).orderBy("pos").collect()
        assert [r["low"] for r in got] == pytest.approx((a - 0.1 * (b - a)).tolist()) and [r["high"] for r in got] == pytest.approx((b + 0.1 * (b - a)).tolist())
