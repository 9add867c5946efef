"""Closed-form goldens and properties."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import bridge, vec
from quillspark.operators import metrics, pairing, simulate, tokens


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("process", "a", "b", "want"),
    [
        (bridge.Periodic(), 0.25, 0.25, 0.017730847133),
        (bridge.Periodic(), 1.0, 1.0, 0.3884375),
        (bridge.cosine_decaying(), 0.25, 0.25, 0.227322232688),
        (bridge.cosine_decaying(), 1.0, 1.0, 0.3884375),
        (bridge.CosineDecay(), 0.25, 0.25, 0.056887640160),
        (bridge.CosineDecay(), 1.0, 1.0, 0.0978375),
        (bridge.Uniform(), 0.25, 1.0, 0.0625),
        (bridge.Uniform(drift=1.0), 0.25, 1.0, 0.023232719485),
    ],
)
def test_covariance(spark, process, a, b, want):
    assert value(spark, process.cov(0.0, a, b)) == pytest.approx(want, abs=1e-11)
    assert value(spark, process.cov(0.0, b, a)) == pytest.approx(want, abs=1e-11)


def test_energy_is_the_integral_of_sigma_squared(spark):
    t = (np.arange(20000) + 0.5) / 20000
    for p in (bridge.Periodic(), bridge.cosine_decaying(), bridge.CosineDecay()):
        s = np.array([r[0] for r in spark.range(20000).select(p.sigma((F.col("id") + 0.5) / 20000)).collect()])
        assert value(spark, p.cov(0.0, 1.0, 1.0)) == pytest.approx((s * s).mean(), abs=1e-8), t.size


def test_bridge_and_scores(spark):
    p = bridge.Uniform()
    w0, w1, var = bridge.conditional(p, 0.0, 0.25, 1.0)
    assert value(spark, w0 * 1 + w1 * 3) == pytest.approx(1.5)
    assert value(spark, var) == pytest.approx(0.046875)
    assert value(spark, bridge.forward_score(p, F.lit(1.5), F.lit(3.0), 0.25, 1.0)) == pytest.approx(8)
    assert value(spark, bridge.reverse_score(p, F.lit(1.5), F.lit(1.0), 0.25)) == pytest.approx(-8)
    assert [value(spark, c) for c in bridge.vp(0.6)] == pytest.approx([0.8, 0.6])
    f, r = bridge.edm(p, 0.25), bridge.edm(p, 0.25, forward=False)
    assert value(spark, f["c_in"]) == pytest.approx(1.219988562661)
    assert [value(spark, x[k]) for x in (f, r) for k in ("c_skip", "c_out")] == pytest.approx([0.372093023256, 0.952353266486, 1.116279069767, 0.403473292393])
    with pytest.raises(ValueError):
        bridge.edm(bridge.Uniform(drift=1.0), 0.25)


def test_slerp(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))
    assert value(spark, vec.slerp(a, b, 0.3)) == pytest.approx([0.891006524188, 0.453990499740])
    assert value(spark, vec.slerp(a, a, 0.3)) == [1.0, 0.0]


def test_packing(spark):
    flat = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda x: x.cast("double"))
    packed = value(spark, vec.packed(flat, 4, 4, 4, 2))
    assert packed[:16] == [0, 4, 16, 20, 8, 12, 24, 28, 32, 36, 48, 52, 40, 44, 56, 60]
    assert value(spark, vec.unpacked(vec.packed(flat, 4, 4, 4, 2), 4, 4, 4, 2)) == list(range(64))


@pytest.mark.parametrize(("n", "want"), [(1, (0, 0, 1)), (2, (0, 0, 2)), (3, (1, 1, 1)), (5, (1, 1, 3)), (25, (2, 2, 21)), (1243, (124, 124, 995))])
def test_split_sizes(n, want):
    assert pairing.split_sizes(n, 0.1, 0.1) == want


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 5000), st.floats(0, 0.6), st.floats(0, 0.6))
def test_split_always_trains(n, test, reserve):
    r, t, train = pairing.split_sizes(n, test, reserve)
    assert r + t + train == n and train >= 1 and min(r, t) >= 0


def test_first_number(spark):
    df = spark.createDataFrame([("Day 6.0d",), ("n/a",), (None,), ("-.5x",)], "t string")
    got = [r[0] for r in df.select(pairing.first_number(F.col("t"))).collect()]
    assert got[0] == 6.0 and math.isnan(got[1]) and math.isnan(got[2]) and got[3] == -0.5
    assert [r[0] for r in df.select(pairing.close(pairing.first_number(F.col("t")), 6)).collect()] == [True, False, False, False]


def test_pinned_euler_hits_the_end(spark):
    df = spark.createDataFrame([([0.0, 1.0], [2.0, -1.0])], "a array<double>, b array<double>")
    p = bridge.Uniform()
    out = df.select(simulate.euler(F.col("a"), p, lambda v, t, i: bridge.forward_score(p, v, F.get("b", i), t, 1.0), 100)).first()[0]
    assert out == pytest.approx([2.0, -1.0], abs=1e-9)
    back = df.select(simulate.euler(F.col("b"), p, lambda v, t, i: bridge.reverse_score(p, v, F.get("a", i), t), 100, reverse=True)).first()[0]
    assert back == pytest.approx([0.0, 1.0], abs=1e-9)
    with pytest.raises(ValueError):
        simulate.euler(F.col("a"), p, lambda v, t, i: v, 5, start=1.0, stop=0.0)


def test_numpy_sampler(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id long, x array<double>")
    out = simulate.simulate_numpy(df, "x", "y", lambda x: x * 2).orderBy("id").collect()
    assert [r["y"] for r in out] == [[2.0, 4.0], [6.0, 8.0]] and [r["id"] for r in out] == [1, 2]


def test_mmd_of_a_side_with_itself_is_zero(spark):
    rows = [(s, s * 10 + i, [float(i), float(i * i)]) for s in (0, 1) for i in range(6)]
    assert metrics.rbf_mmd(spark.createDataFrame(rows, "side long, id long, e array<double>")) == pytest.approx(0, abs=1e-12)


def test_best_attempt(spark):
    df = spark.createDataFrame([(1, 0, 2), (1, 1, 1), (1, 2, 1), (2, 0, 3), (2, 1, 0), (2, 2, 0)], "g int, trial int, score int")
    assert sorted(map(tuple, tokens.best_attempt(df, "g", "trial", "score").collect())) == [(1, 2, 1), (2, 1, 0)]


def test_strip_thinking(spark):
    df = spark.createDataFrame([('<think>a</think>b</think> "Hi." ',)], "t string")
    assert df.select(tokens.strip_thinking(F.col("t"))).first()[0] == "Hi."


def test_spectral_queries_match_numpy(spark):
    """Fréchet distance against its recorded value; singular values and principal axes (up to sign) against NumPy."""
    from quillspark.plans import measures

    data = "/root/testdata/sf0.01"
    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect())
    x = np.array([v for _, v in rows], float)
    assert measures.frechet_distance(spark, data).first()["distance"] == pytest.approx(0.136380198, abs=1e-6)
    got = [r["value"] for r in measures.svd_latents(spark, data).orderBy("component").collect()]
    assert got == pytest.approx(np.linalg.svd(x, compute_uv=False)[: len(got)], abs=1e-5)
    centred = x - x.mean(axis=0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:2]
    mine = {r["vec_id"]: (r["pc1"], r["pc2"]) for r in measures.pca_projection(spark, data).collect()}
    mine = np.array([mine[i] for i, _ in rows])
    assert np.abs(mine) == pytest.approx(np.abs(centred @ axes.T), abs=1e-5)


def test_probability_flow_and_layouts(spark):
    a, b = F.array(F.lit(0.0)), F.array(F.lit(3.0))
    p = bridge.Uniform(0.5)
    # the base process's own score leaves nothing but the first, stochastic step
    own = lambda v, t, i: bridge.reverse_score(p, v, F.lit(0.0), F.greatest(t, F.lit(1e-9)))
    out = value(spark, simulate.probability_flow(a, p, own, 4, a, lambda k, i: F.lit(1.0)))
    assert out == pytest.approx([0.25])
    with pytest.raises(ValueError):
        simulate.probability_flow(a, bridge.Uniform(drift=1.0), own, 4, a, lambda k, i: F.lit(0.0))
    assert value(spark, bridge.interpolant(a, b, 0.25)) == [0.75]
    assert value(spark, bridge.guided(F.lit(2.0), F.lit(1.0), 0.5)) == 2.5
    assert value(spark, vec.patch_positions(2, 3)) == [[0, 1, 2], [3, 4, 5]]
    with pytest.raises(ValueError):
        vec.patch_positions(2, 3, "local_2x2")
    ids = F.array(*map(F.lit, (5, 7, 0, 7)))
    assert [value(spark, vec.pad_id_stop(ids, pad)) for pad in (7, 9)] == [1, 4]


def test_order_cuts(spark, monkeypatch):
    from quillspark.functions import det
    from quillspark.operators import indexing

    monkeypatch.setattr(indexing, "SLICE_ROWS", 1)  # look into every slice
    df = spark.range(500).select(F.col("id").alias("k"))
    h = det.digest(1, "x", F.col("k"))
    order = [r["k"] for r in df.orderBy(h, "k").collect()]
    cuts = indexing.order_cuts(df, h, "k", lambda n: [0, 1, 37, n])
    rows = df.select("k", *[c.alias(f"c{i}") for i, c in enumerate(cuts)]).collect()
    assert [{r["k"] for r in rows if r[f"c{i}"]} for i in range(4)] == [set(order[:k]) for k in (0, 1, 37, 500)]


def test_ema(spark):
    df = spark.createDataFrame([(i, float(i * i % 7)) for i in range(9)], "s long, v double")
    want = 0.0
    for i in range(9):
        want = float(i * i % 7) if i == 0 else 0.9 * want + 0.1 * (i * i % 7)
    got = metrics.ema(df, "s", "v", 0.9).first()
    assert got["ema"] == pytest.approx(want) and got["n"] == 9


def test_permutation_is_one_to_one_and_even(spark):
    from quillspark.functions import det

    for n in (1, 2, 3, 7, 50, 99, 1000):
        df = spark.range(n).select(det.permuted(3, "p", F.lit("c"), F.col("id"), F.lit(n)).alias("at"))
        assert sorted(r["at"] for r in df.collect()) == list(range(n))
    # of 12 numbers 3 are drawn under 4000 keys: each number, and each set of three, about equally often
    rows = spark.range(4000).select("id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select("id", det.permuted(3, "p", F.col("id"), F.col("k"), F.lit(12)).alias("at")).collect()
    sets = {}
    for r in rows:
        sets.setdefault(r["id"], set()).add(r["at"])
    single = np.bincount([x for s in sets.values() for x in s], minlength=12)
    assert all(len(s) == 3 for s in sets.values()) and ((single - 1000) ** 2 / 1000).sum() < 40
    triples = np.unique([sum(1 << x for x in s) for s in sets.values()], return_counts=True)[1]
    expected = 4000 / 220
    assert ((triples - expected) ** 2 / expected).sum() + (220 - len(triples)) * expected < 300  # 219 degrees of freedom


def test_capped_pairs_are_drawn_without_replacement(spark):
    from quillspark.operators import pairing

    cells = [(c, f"{s}{c}{i}", s) for c, sizes in (("big", (40, 30)), ("small", (3, 4)), ("lone", (1, 200))) for s, n in zip("el", sizes) for i in range(n)]
    got = pairing.all_pairs(spark.createDataFrame(cells, "clone string, cell string, side string"), "clone", "cell", 60).collect()
    by = {}
    for r in got:
        by.setdefault(r["clone"], []).append((r["early_id"], r["late_id"]))
    assert {c: len(set(p)) for c, p in by.items()} == {c: len(p) for c, p in by.items()} == {"big": 60, "small": 12, "lone": 60}
    gaps = np.bincount([sum(a == e for a, _ in by["big"]) for e in {f"ebig{i}" for i in range(40)}])
    assert len(gaps) > 3  # an even stride would give every early cell one or two pairs
