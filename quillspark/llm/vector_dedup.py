"""Near-duplicates of embeddings by cosine: a navigable small-world graph a shard, every shard asked, links verified.

1. Vectors are dealt to shards by a hash of their id; a shard holds about SHARD_ROWS rows and SHARD_BYTES. Every shard is asked
   by all rows, so few large shards mean less work. Each shard's graph is built once and staged. Rows within half the
   linking angle of a node are that node's members (a ball): any two of a ball are linked, so a group of copies is few
   nodes, and its links inside a ball need no look.
2. Every two shards meet (and each meets itself): the nodes of one ask the graph of the other for all nodes whose balls may hold a
   linked pair. A beam that is full of such nodes is doubled, at last all nodes are looked at. Each meeting audits its
   recall: up to AUDIT of its own queries against all nodes, and as many probes turned from nodes by just the linking
   angle, must be found at a rate of RECALL or more, otherwise it begins again with twice the beam.
3. Balls are compared by the angle of their mean directions: balls that must be linked throughout are counted as such, balls
   that can't be are left; of all others each pair's cosine is taken in double precision. Counts go to rows, not pairs.
   Components need one link for each two balls, and a meeting gives only those that join more of its balls.
4. Links join components by star contraction.

Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; so do vectors of different
lengths. Of rows that repeat an id the least vector that can be linked stands for the id, each row gets its result, and
n_links counts other ids. Rows with a null id are no vectors of anyone: no links, no component, kept.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import _common as C
from quillspark.llm.components import components
from quillspark.llm.hnsw import Graph
from quillspark.llm.kd_search import _matrix

SHARD_ROWS, SHARD_BYTES = 32768, 32 << 20
BEAM, AUDIT, RECALL = 32, 64, 0.99
#: Angles closer than this to a bound are not decided by it.
MARGIN = 1e-6
CELLS = 1 << 20


def angle(cosine):
    return np.arccos(np.clip(cosine, -1, 1))


class Shard:
    """A graph with its balls: members in order, mean directions, widest angles."""

    def __init__(self, ids: np.ndarray, graph: Graph):
        self.ids, self.graph = ids, graph
        self.order = np.argsort(graph.leader, kind="stable")
        self.size = np.bincount(graph.leader, minlength=graph.n)
        self.first = np.cumsum(self.size) - self.size
        unit = graph.rows[self.order]
        mean = np.add.reduceat(unit, self.first) if graph.n else unit
        norm = np.sqrt((mean * mean).sum(axis=1))
        self.mean = np.where(norm[:, None] > 1e-9, mean / np.maximum(norm, 1e-300)[:, None], graph.rows[graph.node_row])
        apart = angle(np.einsum("ij,ij->i", unit, np.repeat(self.mean, self.size, axis=0)))
        self.wide = np.maximum.reduceat(apart, self.first) if graph.n else apart

    def members(self, ball: int) -> np.ndarray:
        return self.order[self.first[ball] : self.first[ball] + self.size[ball]]


def find(shard: Shard, asked: np.ndarray, theta: float, rng) -> tuple[np.ndarray, np.ndarray]:
    """(query, node): the nodes of the shard whose balls may hold a row linked to one of the query's ball; audited."""
    graph = shard.graph
    least = float(np.cos(min(np.pi, 2 * theta + MARGIN)))  # half an angle for either ball
    some = rng.permutation(len(asked))[:AUDIT]
    want = set(zip(*(x.tolist() for x in graph.every(asked[some].astype(np.float32), least))))
    nodes = rng.permutation(graph.n)[:AUDIT]
    own = graph.rows[graph.node_row[nodes]]
    turn = rng.normal(size=own.shape)
    turn -= (turn * own).sum(axis=1)[:, None] * own
    norm = np.sqrt((turn * turn).sum(axis=1))[:, None]
    probes = np.cos(theta) * own + np.sin(theta) * turn / np.where(norm > 1e-9, norm, np.inf)
    probes /= np.sqrt((probes * probes).sum(axis=1))[:, None]
    beam = BEAM
    while 4 * beam <= graph.n:
        got = set(zip(*(x.tolist() for x in graph.within(asked[some], least, beam))))
        seen = set(zip(*(x.tolist() for x in graph.within(probes, least, beam))))
        if len(got & want) >= RECALL * len(want) and sum((i, x) in seen for i, x in enumerate(nodes.tolist())) >= RECALL * len(nodes):
            break
        beam *= 2
    return graph.within(asked, least, beam)


def meet(left: Shard, right: Shard, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links between two shards (or inside one): how many each row of either has, and links that join their balls."""
    theta = float(np.arccos(cosine))
    q, c = find(right, left.graph.rows[left.graph.node_row], theta, np.random.default_rng(7))
    if same:
        q, c = q[q < c], c[q < c]
    n_left, n_right = np.zeros(len(left.ids), np.int64), np.zeros(len(right.ids), np.int64)
    links: list[tuple[int, int]] = []
    if same:
        n_left += left.size[left.graph.leader] - 1
        root = left.ids[left.graph.node_row]
        mine = root[left.graph.leader]
        links += [(int(a), int(b)) for a, b in zip(left.ids[mine != left.ids], mine[mine != left.ids])]
    between = angle(np.einsum("ij,ij->i", left.mean[q], right.mean[c]))
    reach = left.wide[q] + right.wide[c]
    sure = between + reach <= theta - MARGIN
    open_ = ~sure & (between - reach <= theta + MARGIN)
    joined = sure.copy()
    np.add.at(n_left, left.order, np.repeat(np.bincount(q[sure], weights=right.size[c[sure]], minlength=left.graph.n).astype(np.int64), left.size))
    np.add.at(n_right, right.order, np.repeat(np.bincount(c[sure], weights=left.size[q[sure]], minlength=right.graph.n).astype(np.int64), right.size))
    lone = np.flatnonzero(open_ & (left.size[q] == 1) & (right.size[c] == 1))
    a, b = left.order[left.first[q[lone]]], right.order[right.first[c[lone]]]
    hit = np.einsum("ij,ij->i", left.graph.rows[a], right.graph.rows[b]) >= cosine
    joined[lone[hit]] = True
    np.add.at(n_left, a[hit], 1)
    np.add.at(n_right, b[hit], 1)
    for i in np.flatnonzero(open_ & ((left.size[q] > 1) | (right.size[c] > 1))).tolist():
        a, b = left.members(q[i]), right.members(c[i])
        step = max(1, CELLS // len(b))
        for at in range(0, len(a), step):
            hits = left.graph.rows[a[at : at + step]] @ right.graph.rows[b].T >= cosine
            n_left[a[at : at + step]] += hits.sum(axis=1)
            n_right[b] += hits.sum(axis=0)
            joined[i] |= bool(hits.any())
    links += _forest(left.ids[left.graph.node_row], right.ids[right.graph.node_row], q[joined], c[joined], left.graph.n * (not same))
    return n_left, n_right, links


def _forest(left_root, right_root, q, c, shift) -> list[tuple[int, int]]:
    """Of the links between balls those that join more of them."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = x = up.get(up[x], up[x])
        return x

    out = []
    for i, j in zip(q.tolist(), c.tolist()):
        a, b = top(i), top(j + shift)
        if a != b:
            up[a] = b
            out.append((int(left_root[i]), int(right_root[j])))
    return out


# ---------------------------------------------------------------- Spark


def _packed(shard_ids: np.ndarray, graph: Graph) -> bytes:
    sink = io.BytesIO()
    np.savez(sink, ids=shard_ids, **graph.state())
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue())


def _opened(body: bytes, join: float) -> Shard:
    with np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(body))) as held:
        state = {x: held[x] for x in held.files}
    return Shard(state.pop("ids"), Graph.of(state, join))


def _join(cosine: float) -> float:
    return float(np.cos(max(0.0, np.arccos(cosine) / 2 - MARGIN)))


def _build(cosine: float):
    schema = pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("body", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("vec_id").to_numpy())  # a shard is the same whichever way its rows came
        ids, v = table.column("vec_id").to_numpy()[order], _matrix(table, "v")[order]
        v = v / np.abs(v).max(axis=1)[:, None]
        body = _packed(ids, Graph(v / np.sqrt((v * v).sum(axis=1))[:, None], _join(cosine)))
        C.trim()
        return pa.table({"dim": pa.array([v.shape[1]], pa.int32()), "shard": table.column("shard")[:1], "body": [body]}, schema=schema)

    return run


def _met(cosine: float):
    schema = pa.schema([("vec_id", pa.int64()), ("n", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        which, bodies = table.column("shard").to_pylist(), table.column("body")
        same = table.column("p")[0].as_py() == table.column("q")[0].as_py()
        left = _opened(bodies[which.index(table.column("p")[0].as_py())].as_py(), _join(cosine))
        right = left if same else _opened(bodies[which.index(table.column("q")[0].as_py())].as_py(), _join(cosine))
        n_left, n_right, links = meet(left, right, cosine, same)
        counts = n_left + n_right if same else np.concatenate([n_left, n_right])
        ids = left.ids if same else np.concatenate([left.ids, right.ids])
        ids, counts = ids[counts > 0], counts[counts > 0]
        pad = len(links)
        out = {"vec_id": pa.array([*ids.tolist(), *[None] * pad], pa.int64()), "n": pa.array([*counts.tolist(), *[None] * pad], pa.int64())}
        out |= {x: pa.array([*[None] * len(ids), *(e[i] for e in links)], pa.int64()) for i, x in enumerate("uv")}
        C.trim()
        return pa.table(out, schema=schema)

    return run


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v): a row for each id that has a vector which can be linked."""
    wide = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return wide.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(fine).groupBy("vec_id").agg(F.min("v").alias("v"))


def near_vectors(rows: DataFrame, cosine: float = 0.95) -> DataFrame:
    """rows: vec_id, embedding. vec_id, n_links, component_id (smallest linked vec_id), kept, for every row."""
    C.tune(rows.sparkSession)
    vectors = C.stage(usable(rows).withColumn("dim", F.size("v")))
    per = vectors.groupBy("dim").agg(F.count("*").alias("n"))
    fit = F.greatest(F.lit(1), F.least(F.lit(SHARD_ROWS), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim")))))
    per = C.stage(per.select("dim", F.ceil(F.col("n") / fit).cast("bigint").alias("shards")))
    dealt = vectors.join(per, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")))
    graphs = C.stage(dealt.select("dim", "shard", "vec_id", "v").groupBy("dim", "shard").applyInArrow(_build(cosine), "dim int, shard bigint, body binary"))
    other = F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)
    meets = graphs.join(per, "dim").withColumn("other", F.explode(other)).select("dim", F.least("shard", "other").alias("p"), F.greatest("shard", "other").alias("q"), "shard", "body")
    found = C.stage(meets.groupBy("dim", "p", "q").applyInArrow(_met(cosine), "vec_id bigint, n bigint, u bigint, v bigint"))
    counts = found.filter("n is not null").groupBy("vec_id").agg(F.sum("n").alias("n"))
    forest = components(found.filter("u is not null").select("u", "v"))
    known = counts.join(forest.select(F.col("u").alias("vec_id"), F.col("v").alias("root")), "vec_id", "left")
    ids = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("root", "vec_id"))
    out = ids.join(known, "vec_id", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"))
    result = out.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    C.drop(vectors, graphs)
    return result


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
