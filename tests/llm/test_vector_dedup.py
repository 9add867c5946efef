"""op13 against brute force; the graph's recall."""

import numpy as np
import pytest

from quillspark.llm import hnsw
from quillspark.llm import vector_dedup as V


def brute(rows, cosine=0.95):
    """rows: (id, vector), ids distinct."""
    m = np.array([v for _, v in rows], float)
    unit = m / np.sqrt((m * m).sum(axis=1))[:, None]
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    comp = np.array([i for i, _ in rows])
    while True:
        new = np.minimum(comp, np.where(near, comp[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    return {i: (int(n), int(c), bool(i == c)) for (i, _), n, c in zip(rows, near.sum(axis=1), comp)}


def got(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def groups(rng, n, dim, sizes, spread):
    """Random directions, with groups of copies at a given noise around a centre, and a chain whose ends are not linked."""
    v = rng.normal(size=(n, dim))
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    at = 0
    for size, noise in zip(sizes, spread):
        v[at : at + size] = v[at] + noise * rng.normal(size=(size, dim)) / np.sqrt(dim)
        at += size
    a, b = np.linalg.qr(rng.normal(size=(dim, 2)))[0].T
    chain = np.array([np.cos(0.25 * k) * a + np.sin(0.25 * k) * b for k in range(12)])
    v[at : at + 12] = chain
    order = rng.permutation(n)
    return [(int(i), (v[k] * rng.uniform(0.1, 9)).tolist()) for i, k in enumerate(order)]


@pytest.mark.parametrize("dim, shard", [(24, 500), (8, 200), (64, 5000)])
def test_links_and_components(spark, monkeypatch, dim, shard):
    monkeypatch.setattr(V, "SHARD_ROWS", shard)
    rows = groups(np.random.default_rng(dim), 1500, dim, [400, 150, 60, 2, 2, 3], [0.02, 0.2, 0.33, 0.1, 0.2, 0.25])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, have = brute(rows), got(V.near_vectors(df))
    found, there = sum(n for n, _, _ in have.values()), sum(n for n, _, _ in want.values())
    assert have.keys() == want.keys() and all(have[i][0] <= want[i][0] for i in want) and found >= 0.99 * there
    assert sum(have[i] == want[i] for i in want) >= 0.99 * len(want)


def test_graph_recall():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(6000, 48))
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    graph = hnsw.Graph(v, 0.9999)
    assert graph.n == 6000 and all((x[x >= 0] < 6000).all() for x in graph.links)
    ids, _ = graph._descend(v[:300].astype(np.float32), 64)[0]
    exact = np.argsort(-(v[:300] @ v.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact.tolist(), ids.tolist())]) > 0.9
    probe = 0.95 * v[:300] + np.sqrt(1 - 0.95**2) * v[300:600]
    probe /= np.sqrt((probe * probe).sum(axis=1))[:, None]
    q, c = graph.within(probe, 0.85, 32)
    assert sum((i, i) in set(zip(q.tolist(), c.tolist())) for i in range(300)) >= 297


def test_full_beams_are_widened():
    rng = np.random.default_rng(4)
    v = rng.normal(size=16) + 0.2 * rng.normal(size=(3000, 16))  # all near each other
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    graph = hnsw.Graph(v, 0.99999)
    got_, want = graph.within(v[:40], 0.97, 16), graph.every(v[:40].astype(np.float32), 0.97)
    assert len(want[0]) > 40 * 200
    assert len(set(zip(*map(list, got_))) & set(zip(*map(list, want)))) >= 0.99 * len(want[0])


def test_a_failed_audit_widens_the_beam(monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 16))
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    shard = V.Shard(np.arange(3000), hnsw.Graph(v, 0.9999))
    shard.graph.links[0][:, 4:] = -1  # a poor graph
    q, c = V.find(shard, v, 0.3, np.random.default_rng(1))
    want = set(zip(*map(list, shard.graph.every(v.astype(np.float32), float(np.cos(0.6))))))
    assert len(set(zip(q.tolist(), c.tolist())) & want) >= 0.95 * len(want)


def test_copies_make_few_nodes():
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(size=20) + 0.01 * rng.normal(size=(900, 20)), rng.normal(size=(100, 20))])
    v = v[rng.permutation(1000)]
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    shard = V.Shard(np.arange(1000), hnsw.Graph(v, V._join(0.95)))
    assert shard.graph.n <= 105 and shard.size.sum() == 1000 and shard.size.max() >= 890
    n_left, n_right, links = V.meet(shard, shard, 0.95, True)
    assert sorted((n_left + n_right).tolist()) == sorted(n for n, _, _ in brute(list(enumerate(v.tolist()))).values()) and len(links) < 1000


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], 5), (2, [2.0, 0.1], 5), (3, None, 5), (4, [0.0, 0.0], 5), (5, [float("nan"), 1.0], 5), (6, [None, 1.0], 5), (7, [1.0], 5), (8, [3.0], 5), (9, [], 5), (None, [1.0, 0.0], 5), (10, [1e300, 1e299], 5), (11, [1e-300, 0.0], 5), (12, [float("inf"), 0.0], 5), (13, [-1.0, 0.0], 5)]
    rows += [(2, [2.0, 0.1], 5), (14, [0.0, 1.0], 5), (14, [0.1, 1.0], 5), (14, None, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard int")
    out = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in V.near_vectors(df).collect())
    want = {1: (3, 1), 2: (3, 1), 10: (3, 1), 11: (3, 1), 7: (1, 7), 8: (1, 7)}
    assert out == sorted((str(i), *(want.get(i, (0, i)) if i else (0, None)), i is None or want.get(i, (0, i))[1] == i) for i, _, _ in rows)
    assert V.near_vectors(df.limit(0)).count() == 0
