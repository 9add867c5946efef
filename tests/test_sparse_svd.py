"""The truncated SVD of sparse matrices against NumPy."""

import os

import numpy as np
import pytest

from quillspark.operators import linear


def coo(spark, m):
    r, c = np.nonzero(m)
    return spark.createDataFrame([(int(a), int(b), float(m[a, b])) for a, b in zip(r, c)], "row long, col long, value double")


def same(spark, m, k, **more):
    got = linear.sparse_svd(coo(spark, m), k, **more)
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    n = len(got.values)
    assert got.values == pytest.approx(s[:n].tolist(), rel=1e-9, abs=1e-9)
    sign = np.sign(vt[np.arange(n), np.abs(vt[:n]).argmax(axis=1)])
    axes = {r["col"]: r["axis"] for r in got.right.collect()}
    assert np.abs(np.array([axes.get(c, [0.0] * n) for c in range(m.shape[1])]) - vt[:n].T * sign).max() < 1e-6
    left = {r["row"]: r["z"] for r in got.left.collect()}
    assert np.abs(np.array([left.get(r, [0.0] * n) for r in range(m.shape[0])]) - u[:, :n] * s[:n] * sign).max() < 1e-6 * max(1.0, s[0])
    return n


def sparse(rng, rows, columns, rank, share):
    m = rng.normal(size=(rows, rank)) * 3.0 ** -np.arange(rank) @ rng.normal(size=(rank, columns))
    return np.where(rng.random((rows, columns)) < share, m, 0.0)


@pytest.mark.parametrize("rows, columns", [(120, 40), (30, 90)])
def test_values_axes_and_latents(spark, rows, columns):
    assert same(spark, sparse(np.random.default_rng(rows), rows, columns, 12, 0.3), 5, oversample=6) == 5


def test_a_condition_number_that_squares_beyond_doubles(spark):
    """Small singular values keep their digits, which a Gram matrix would lose."""
    rng = np.random.default_rng(5)
    u, v = np.linalg.qr(rng.normal(size=(40, 6)))[0], np.linalg.qr(rng.normal(size=(12, 6)))[0]
    s = 10.0 ** -np.arange(0, 12, 2)
    got = linear.sparse_svd(coo(spark, u * s @ v.T), 6, oversample=2)
    assert got.values[:5] == pytest.approx(s[:5].tolist(), rel=1e-6)


def test_low_rank_and_small_sides(spark):
    m = np.outer(np.arange(1, 9.0), np.arange(1, 6.0))
    assert same(spark, m, 1) == 1
    got = linear.sparse_svd(coo(spark, m), 3)
    assert got.values[0] == pytest.approx(np.linalg.norm(m)) and max(got.values[1:], default=0) < 1e-9
    with pytest.raises(ValueError):
        linear.sparse_svd(coo(spark, np.ones((1, 4))), 2)
    with pytest.raises(ValueError):
        linear.sparse_svd(coo(spark, np.ones((2, 2))).limit(0), 2)


def test_entries_add_up_and_odd_ones_go(spark):
    m = sparse(np.random.default_rng(3), 25, 10, 6, 0.5)
    twice = coo(spark, m).selectExpr("row", "col", "value / 2 as value")
    odd = spark.createDataFrame([(None, 1, 1.0), (1, None, 1.0), (2, 2, float("nan")), (3, 3, None), (4, 4, float("inf")), (99, 99, 0.0)], "row long, col long, value double")
    got = linear.sparse_svd(twice.union(twice).union(odd), 3)
    assert got.values == pytest.approx(np.linalg.svd(m, compute_uv=False)[:3].tolist())


def test_r_factor_of_many_partitions(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 7))
    df = spark.createDataFrame([(r[:3].tolist(), r[3:].tolist()) for r in x], "a array<double>, b array<double>").repartition(70)
    r = linear.r_factor(df, ["a", "b"], 7)
    assert np.abs(r.T @ r - x.T @ x).max() < 1e-9


def test_orders_by_months(spark):
    import duckdb

    from quillspark.plans import measures

    data = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select l_orderkey, year(l_shipdate) * 12 + month(l_shipdate), ln(1 + sum(l_quantity)::double) from '{data}/lineitem.parquet' where l_orderkey is not null and l_shipdate is not null and l_quantity is not null group by 1, 2").fetchall()
    orders, months = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    m = np.zeros((len(orders), len(months)))
    for o, c, v in rows:
        m[orders.index(o), months.index(c)] = v
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    assert [r["value"] for r in measures.sparse_svd_values(spark, data).orderBy("component").collect()] == pytest.approx(s[:4].tolist(), abs=1e-6)
    z = np.zeros((len(orders), 4))
    for r in measures.sparse_svd_latents(spark, data).collect():
        z[orders.index(r["l_orderkey"]), r["component"]] = r["value"]
    sign = np.sign(vt[np.arange(4), np.abs(vt[:4]).argmax(axis=1)])
    assert np.abs(z - u[:, :4] * s[:4] * sign).max() < 2e-6


@pytest.mark.parametrize("rows, columns", [(300, 20), (20, 300)])
def test_a_narrow_side_stores_no_basis(spark, monkeypatch, rows, columns):
    """Only the cells are written, whatever the number of values."""
    staged = []
    monkeypatch.setattr(linear, "stage", lambda df, *a, to=linear.stage: staged.append(df.columns) or to(df, *a))
    monkeypatch.setattr(linear, "DENSE", 20, raising=False)
    assert same(spark, sparse(np.random.default_rng(rows), rows, columns, 15, 0.4), 4) == 4
    assert staged == [["row", "col", "value"]]


@pytest.mark.parametrize("rows, columns", [(120, 40), (30, 90)])
def test_wide_sides_keep_one_basis(spark, monkeypatch, rows, columns):
    """Without the dense way: the same result, and a round's tables go when the next has its own."""
    made = []
    monkeypatch.setattr(linear, "DENSE", 8, raising=False)
    monkeypatch.setattr(linear, "scratch", lambda *a, to=linear.scratch: made.append(to(*a)) or made[-1], raising=False)
    assert same(spark, sparse(np.random.default_rng(rows), rows, columns, 12, 0.3), 5, oversample=1) == 5
    assert len(made) > 9 and sum(os.path.exists(p.removeprefix("file:")) for p in made) <= 3
