"""A box is opened once for all the queries that need it, not once a query or round."""

import numpy as np

from quillspark.llm import kd_search


def test_leaves_are_met_few_times(monkeypatch):
    rng = np.random.default_rng(1)
    ids, points = rng.permutation(2000).astype(np.int64), np.floor(256 * rng.normal(size=(2000, 16)))
    points[50:90] = points[49]  # ties
    queries, asked = points[:200], ids[:200]
    met = []
    monkeypatch.setattr(kd_search.KdTree, "_score", lambda self, node, *a, to=kd_search.KdTree._score: met.append(node) or to(self, node, *a))
    tree = kd_search.KdTree(ids, points, 64)
    best, who = tree.search(asked, queries, np.full(200, -np.inf), 5)
    for i in range(200):
        want = sorted((-float(queries[i] @ p), j) for p, j in zip(points, ids.tolist()) if j != asked[i])[:5]
        assert [(-s, j) for s, j in zip(best[i], who[i].tolist())] == want
    assert len(met) <= 2 * sum(c is None for c in tree.children)
