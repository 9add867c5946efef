"""op11 against brute force."""

import numpy as np
import pytest

from quillspark.llm import hard_negatives as H


def brute(rows, anchors, positives, negatives):
    """rows, anchors: (id, label, vector of whole numbers)."""
    out = []
    for a, y, q in anchors:
        scored = sorted((-sum(int(x) * int(z) for x, z in zip(q, v)), d, z) for d, z, v in rows if d != a and len(v) == len(q))
        for s, p, _ in [x for x in scored if x[2] == y][:positives]:
            wanted = [x for x in scored if x[2] != y and 30 * -s <= 100 * -x[0] <= 90 * -s]
            out += [(a, p, k + 1, d, -s, -t) for k, (t, d, _) in enumerate(wanted[:negatives])]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


@pytest.mark.parametrize("dim, span", [(1, 3), (3, 2), (8, 40), (16, 1000)])
def test_mined_rows(spark, monkeypatch, dim, span):
    monkeypatch.setattr(H, "SHARD_ROWS", 150)
    monkeypatch.setattr(H, "ANCHOR_BLOCK", 7)
    monkeypatch.setattr(H, "CELLS", 500)
    rng = np.random.default_rng(dim)
    rows = [(i, int(rng.integers(0, 3)) if i % 3 else 1, rng.integers(-span, span + 1, dim).astype(float).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<double>")
    anchors = [r for r in rows if r[0] % 20 == 0]
    want = brute(rows, anchors, 4, 6)
    assert want and got(H.mine(df, df.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "anchor_id"), 4, 6)) == want


def test_intervals_hold_the_scores():
    """Whatever the plane at which a candidate is dropped, each range's best stay, with exact scores."""
    rng = np.random.default_rng(1)
    for width in (1, 2, 9, 20):
        v = rng.integers(-(1 << width), 1 << width, (300, 6)).astype(float)
        q = rng.integers(-(1 << width), 1 << width, (9, 6)).astype(float)
        allowed = rng.random((9, 300)) < 0.7
        exact = q @ v.T
        low = np.stack([np.full(9, -np.inf), np.quantile(exact, 0.4, axis=1)], axis=1)
        high = np.stack([np.full(9, np.inf), np.quantile(exact, 0.8, axis=1)], axis=1)
        i, c, score = H.BitPlanes(v).search(q, allowed, low, high, 5)
        assert (score == exact[i, c]).all() and len(i) < allowed.sum()
        for a in range(9):
            for s in (0, 1):
                want = sorted((x for x, ok in zip(exact[a], allowed[a]) if ok and low[a, s] <= x <= high[a, s]), reverse=True)[:5]
                assert sorted((x for x in score[i == a] if low[a, s] <= x <= high[a, s]), reverse=True)[:5] == want


def test_odd_rows(spark):
    rows = [(0, 1, [1.0, 0.5], 9), (100, None, [1.0, 1.0], 9), (200, 1, None, 9), (300, 1, [None, 1.0], 9), (400, 1, [float("nan"), 1.0], 9), (500, 1, [], 9), (None, 1, [1.0, 1.0], 9)]
    rows += [(1, 1, [1.0, 0.5], 9), (2, 2, [0.5, 0.25], 9), (3, 2, [0.5, 0.25], 9), (3, 2, [0.5, 0.25], 9), (4, 3, [0.1], 9), (5, 7, [1e9, 1e9], 9), (600, 4, [-1.0, -1.0], 9), (601, 4, [1.0, 1.0], 9), (602, 2, [-1.0, 0.0], 9), (8, 1, [0.3, 0.2], 9)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, shard int")
    vectors = H.labelled(df)
    anchors = vectors.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "anchor_id")
    plain = [(r["vec_id"], r["label"], r["v"]) for r in vectors.collect()]
    assert {r[0] for r in plain} == {0, 1, 2, 3, 4, 5, 8, 600, 601, 602} and dict((d, y) for d, y, _ in plain)[0] == 2
    want = brute(plain, [r for r in plain if r[0] % 100 == 0], 5, 10)
    assert want and got(H.mine(vectors, anchors)) == want
    assert H.mine(vectors.limit(0), anchors.limit(0)).count() == 0


def test_products_beyond_doubles(spark):
    rows = [(i, i % 2, [float(i * 2**30 + i), float((7 - i) * 2**31)]) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<double>")
    assert got(H.mine(df, df.filter("vec_id < 3").withColumnRenamed("vec_id", "anchor_id"))) == brute(rows, rows[:3], 5, 10)


def test_query_of_repeated_anchors(spark, tmp_path):
    rows = [(0, [0.5, 1.0], 1), (0, [0.25, 2.0], 1), (1, [1.0, 0.5], 2), (2, [0.5, 0.5], 3), (100, [0.5, 0.5], 1), (101, None, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    plain = [(0, 2, (128, 256)), (0, 2, (64, 512)), (1, 2, (256, 128)), (2, 3, (128, 128)), (100, 1, (128, 128))]
    assert got(H.op11_hard_negatives(spark, str(tmp_path))) == brute(plain, [plain[1], plain[4]], 5, 10)
