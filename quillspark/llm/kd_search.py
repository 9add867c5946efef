"""Exact top-k search by inner product over KD-trees, one tree a shard.

Vectors are dealt to shards by a hash of their id. A shard's tree splits at the median of the widest dimension; each
node keeps its tight bounding box. For a query q the best any vector of a box can score is
sum(max(q_i * low_i, q_i * high_i)). Each query first goes down to the leaf of the best bounds; then the boxes are met one
by one, better bounds first, by all queries whose kth score they may still reach. Each query first searches one home shard; its kth score there travels with it to all other shards, whose boxes
below it stay closed. Queries travel in blocks of at most QUERY_BLOCK, so no task holds more than a shard and a block.

Vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows with a null id. Vectors
of different lengths never match. Rows that repeat an id count as the query's own; of a query's the least vector is asked. Fewer than k candidates: all of them.
Ties go to the smaller id. Scores that exceed a 64-bit integer raise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import _common as C

SHARD_ROWS, QUERY_BLOCK, LEAF = 8192, 4096, 128
EXACT = float(1 << 52)  # below this, sums of doubles are exact


class KdTree:
    """Median splits with tight boxes over integer vectors held as doubles."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.order = np.argsort(ids, kind="stable")
        self.low, self.high, self.children, self.span = [], [], [], []
        self.points = vectors
        self._build(0, len(ids), leaf)
        self.ids, self.points = ids[self.order], vectors[self.order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _build(self, first: int, last: int, leaf: int) -> int:
        mine = self.points[self.order[first:last]]
        node = len(self.span)
        self.low.append(mine.min(axis=0))
        self.high.append(mine.max(axis=0))
        self.span.append((first, last))
        self.children.append(None)
        width = self.high[node] - self.low[node]
        if last - first > leaf and len(width) and width.max() > 0:
            middle = (last - first) // 2
            cut = np.argpartition(mine[:, int(width.argmax())], middle)
            self.order[first:last] = self.order[first:last][cut]
            self.children[node] = (self._build(first, first + middle, leaf), self._build(first + middle, last, leaf))
        return node

    def bounds(self, queries: np.ndarray, nodes) -> np.ndarray:
        """The most that any vector in each node's box can score."""
        return np.maximum(queries, 0) @ self.high[nodes].T + np.minimum(queries, 0) @ self.low[nodes].T

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int):
        """(scores, ids) of each query's k best, -inf where there are fewer; nothing below floor need be found."""
        n = len(queries)
        best, who = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        first = np.zeros(n, np.int64)
        ways = [(0, np.arange(n))]
        while ways:  # down to the leaf of the best bounds: a good kth score before anything else is opened
            node, rows = ways.pop()
            if self.children[node] is None:
                first[rows] = node
                self._score(node, rows, query_ids, queries, best, who, k)
                continue
            pair = list(self.children[node])
            left = np.subtract(*self.bounds(queries[rows], pair).T) >= 0
            ways += [(child, rows[side]) for child, side in zip(pair, (left, ~left)) if side.any()]
        ways = [(0, np.arange(n), self.bounds(queries, [0])[:, 0])]
        while ways:  # every box is met once, with all queries that still may gain by it
            node, rows, ub = ways.pop()
            live = ub >= np.maximum(floor[rows], best[rows, k - 1])
            rows = rows[live]
            if self.children[node] is None:
                rows = rows[first[rows] != node]
                if len(rows):
                    self._score(node, rows, query_ids, queries, best, who, k)
            elif len(rows):
                pair = list(self.children[node])
                bounds = self.bounds(queries[rows], pair)
                ways += [(pair[c], rows, bounds[:, c]) for c in np.argsort(bounds.sum(axis=0), kind="stable")]  # the better one is met first
        return best, who

    def _score(self, node, rows, query_ids, queries, best, who, k) -> None:
        first, last = self.span[node]
        for a in range(first, last, 4 * LEAF):  # equal vectors can make a large leaf
            b = min(last, a + 4 * LEAF)
            score = queries[rows] @ self.points[a:b].T
            ids = np.broadcast_to(self.ids[a:b], score.shape)
            score = np.where(ids == query_ids[rows][:, None], -np.inf, score)
            gain = np.flatnonzero(score.max(axis=1) >= best[rows, k - 1])  # the others keep what they have
            if not len(gain):
                continue
            at, score, ids = rows[gain], score[gain], ids[gain]
            ids = np.where(score == -np.inf, np.iinfo(np.int64).max, ids)
            all_s, all_i = np.concatenate([best[at], score], axis=1), np.concatenate([who[at], ids], axis=1)
            pick = np.lexsort((all_i, -all_s), axis=1)[:, :k]
            best[at], who[at] = np.take_along_axis(all_s, pick, 1), np.take_along_axis(all_i, pick, 1)


def _plain(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """The same by whole numbers of any size, where doubles would not be exact."""
    for q, v in zip(query_ids.tolist(), queries):
        exact = [int(x) for x in v]
        scored = sorted((-sum(a * int(b) for a, b in zip(exact, row)), i) for i, row in zip(ids.tolist(), vectors) if i != q)
        for s, i in scored[:k]:
            yield q, i, -s


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    flat = column.flatten() if isinstance(column, pa.Array) else pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _search(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        if not vectors.num_rows or not asked.num_rows:
            return schema.empty_table()
        ids, points = vectors.column("vec_id").to_numpy(), _matrix(vectors, "v")
        query_ids, queries = asked.column("query_id").to_numpy(), _matrix(asked, "q")
        floor = asked.column("floor").to_numpy(zero_copy_only=False).astype(float)
        size = float(np.abs(points).max()) * float(np.abs(queries).max()) * points.shape[1]
        if not size < EXACT:
            rows = list(_plain(ids, points, query_ids, queries, k))
            return pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(schema.names)}, schema=schema)
        best, who = KdTree(ids, points).search(query_ids, queries, np.where(np.isnan(floor), -np.inf, floor), k)
        there = (best > -np.inf) & (best >= np.where(np.isnan(floor), -np.inf, floor)[:, None])
        q = np.broadcast_to(query_ids[:, None], best.shape)[there]
        return pa.table({"query_id": q, "vec_id": who[there], "score": best[there].astype(np.int64)}, schema=schema)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """vectors: (vec_id bigint, v array<double> of whole numbers); queries: (query_id, v). query_id, rank, vec_id, score."""
    spark = C.tune(vectors.sparkSession)
    n, asked = vectors.count(), queries.count()
    shards = max(1, -(-n // SHARD_ROWS), min(C.parts(spark), -(-n // 256)))
    query_blocks = max(1, -(-asked // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query_id", F.lit(3)), F.lit(query_blocks))
    placed = vectors.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    held = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(query_blocks - 1).cast("bigint"))))
    asked_in = queries.select("query_id", F.col("v").alias("q")).withColumn("dim", F.size("q")).withColumn("block", block)
    keys = ["dim", "shard", "block"]
    out_schema = "query_id bigint, vec_id bigint, score bigint"

    def search(frame: DataFrame) -> DataFrame:
        return held.groupBy(*keys).cogroup(frame.select(*keys, "query_id", "q", "floor").groupBy(*keys)).applyInArrow(lambda a, b: _search(k)(a, b), out_schema)

    home = asked_in.withColumn("shard", F.pmod(F.xxhash64("query_id"), F.lit(shards))).withColumn("floor", F.lit(None).cast("double"))
    kth = C.stage(search(home).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor")))
    every = asked_in.join(kth, "query_id", "left").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))))
    found = search(every)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(rows: DataFrame, scale: float = 256.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(vec_id, columns to keep, v) of the rows that take part; components become floor(scale * x)."""
    wide = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), *keep, F.col("embedding").cast("array<double>").alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.col("vec_id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & fine
    return wide.filter(ok).select("vec_id", *keep, F.transform("e", lambda x: F.expr("0D") + F.rint(x * scale) - (F.rint(x * scale) > x * scale).cast("double")).alias("v"))


def op3_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    queries = vectors.filter(F.col("vec_id") % 50 == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    return top_k(vectors, queries)
