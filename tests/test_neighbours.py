"""Exact nearest neighbours: equal to brute force, and most of clustered data is never shipped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import neighbours as N


def frames(spark, q, r):
    left = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, q array<double>")
    return left, spark.createDataFrame([(i * 2, x.tolist()) for i, x in enumerate(r)], "ref_id long, e array<double>")


def brute(q, r):
    d2 = ((q[:, None, :] - r[None, :, :]) ** 2).sum(axis=2)
    return {i: 2 * int(j) for i, j in enumerate(d2.argmin(axis=1))}


def clustered(rng, n, centres, dim, noise):
    c = rng.normal(size=(centres, dim)) * 10
    return c[rng.integers(0, centres, n)] + noise * rng.normal(size=(n, dim))


@pytest.mark.parametrize("noise", [0.1, 30.0])
def test_nearest_rows(spark, monkeypatch, noise):
    monkeypatch.setattr(N, "CELL_ROWS", 20)
    monkeypatch.setattr(N, "SHARD_ROWS", 40)
    monkeypatch.setattr(N, "QUERY_ROWS", 30)
    rng = np.random.default_rng(1)
    r = clustered(rng, 500, 12, 6, noise)
    r[100:160] = r[99]  # copies: ties go to the smallest id, and one cell is larger than a shard
    q = np.concatenate([clustered(rng, 150, 12, 6, noise), r[95:105]])
    got = {x["query_id"]: x["ref_id"] for x in N.nearest(*frames(spark, q, r)).collect()}
    assert got == brute(q, r)


def test_most_pairs_are_not_shipped(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_ROWS", 25)
    rng = np.random.default_rng(2)
    c = rng.normal(size=(20, 8)) * 10
    r, q = c[rng.integers(0, 20, 1000)] + 0.2 * rng.normal(size=(1000, 8)), c[rng.integers(0, 20, 300)] + 0.2 * rng.normal(size=(300, 8))
    left, right = frames(spark, q, r)
    cells = N.Cells(right)
    home = cells.home(left)
    best = spark.createDataFrame([(i, float(np.sqrt(((x - r) ** 2).sum(axis=1).min()))) for i, x in enumerate(q)], "query_id long, best double")
    shipped = cells.further(home.join(best, "query_id")).count()
    assert len(cells.cell) == 40 and shipped < 0.1 * 300 * 39


def test_odd_rows(spark):
    left, right = frames(spark, np.zeros((2, 3)), np.ones((3, 3)))
    assert N.nearest(left, right.limit(0)).count() == 0 and N.nearest(left.limit(0), right).count() == 0
    nulls = spark.createDataFrame([(None, [1.0, 1.0, 1.0]), (9, None)], "query_id long, q array<double>")
    odd = right.union(spark.createDataFrame([(None, [0.0, 0.0, 0.0]), (7, None)], right.schema))
    assert sorted((x["query_id"], x["ref_id"], x["d2"]) for x in N.nearest(left.union(nulls), odd).collect()) == [(0, 0, 3.0), (1, 0, 3.0)]
    assert N.nearest(left, right.withColumn("e", F.array(*[F.lit(0.0)] * 3))).filter("ref_id = 0").count() == 2


def test_queries_travel_once_a_bundle(spark, monkeypatch):
    """Where balls exclude nothing, copies of a query follow the shards, not the cells."""
    monkeypatch.setattr(N, "CELL_ROWS", 10)
    monkeypatch.setattr(N, "SHARD_ROWS", 150)
    rng = np.random.default_rng(3)
    r, q = rng.normal(size=(600, 32)), rng.normal(size=(50, 32))
    left, right = frames(spark, q, r)
    cells = N.Cells(right)
    shipped = cells.further(cells.home(left).withColumn("best", F.lit(1e9))).count()
    assert len(cells.cell) > 40 and shipped <= 50 * 9
    assert {x["query_id"]: x["ref_id"] for x in N.nearest(left, right).collect()} == brute(q, r)


def test_products_leave_near_ties_to_plain_differences():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    r = 1e6 + rng.normal(size=(3000, 5)) * 1e-5  # products of such rows hold no digit of the distance
    q = r[rng.integers(0, 3000, 300)] + rng.normal(size=(300, 5)) * 1e-6
    column = lambda x: pa.array(x.tolist(), pa.list_(pa.float64()))
    got = N._nearest(pa.table({"query_id": np.arange(300), "q": column(q)}), pa.table({"ref_id": np.arange(3000), "e": column(r)}))
    assert got.column("ref_id").to_pylist() == ((q[:, None, :] - r[None, :, :]) ** 2).sum(axis=2).argmin(axis=1).tolist()
    assert N.squares(r[:40], r[:40], 1e-3)[np.arange(40), np.arange(40)].max() == 0
