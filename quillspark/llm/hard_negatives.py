"""Hard-negative mining by bit-sliced integer products.

Vectors are whole numbers, scores are inner products. A shard keeps its vectors as bit-planes (offset binary, so that all
planes count upwards). For an anchor q the planes are multiplied in from the most significant one; what the planes below
can still add lies between (2^p - 1) times the sum of q's negative and that of its positive components. So each
candidate has an interval for its score that shrinks to a point with the last plane. A candidate is dropped as soon as
its interval lies outside all wanted score ranges, or below k candidates that surely are inside one. Once few are left,
only their planes are read.

An anchor's positives are its best k rows of its own label. Each positive's score gives a range of scores in which the
best rows of other labels are its hard negatives. Each search asks one home shard first; the kth score found there travels
with the anchor to the other shards, which answer only above it. Anchors travel in blocks; labels play no part in where
rows go, so a hot label is spread like any other.

Rows with a null id, a null label, a null or empty vector, or a null or non-finite component take no part. Vectors of
different lengths never meet. Rows that repeat an id are candidates of their own but never of an anchor of that id; of an
anchor's the least (label, vector) asks. Ties go to the smaller id. An anchor without a positive, and a positive without a
negative, give no row. Products that doubles can't hold are taken by whole numbers of any size; where a 64-bit integer may
not hold them either, scores are decimals of 38 digits (a longer one raises).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import _common as C
from quillspark.llm.kd_search import EXACT, _matrix, quantised

SHARD_ROWS, ANCHOR_BLOCK = 8192, 4096
#: Types of scores.
LONG, WIDE = "bigint", "decimal(38,0)"
#: Intervals held at once by a dense search.
CELLS = 1 << 21
#: Share of candidates below which the search goes on by lists.
SPARSE = 1 / 8


class BitPlanes:
    """Vectors of whole numbers in offset binary: v = sum of 2^p * plane p, less 2^(width-1)."""

    def __init__(self, vectors: np.ndarray):
        whole = vectors.astype(np.int64)
        self.width = max(1, int(max(int(whole.max(initial=0)), -int(whole.min(initial=0)) - 1)).bit_length() + 1)
        lifted = whole + (1 << (self.width - 1))
        self.planes = [(lifted >> p & 1).astype(np.float32) for p in range(self.width)]
        self.rows = len(vectors)

    def _interval(self, queries: np.ndarray, plane: int):
        """What is to be added to the planes read so far: least and most."""
        rest = float((1 << plane) - 1)
        base = -float(1 << (self.width - 1)) * queries.sum(axis=1)
        return base + rest * np.minimum(queries, 0).sum(axis=1), base + rest * np.maximum(queries, 0).sum(axis=1)

    def search(self, queries: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        """(query, candidate, score) of all that can be among a range's k best; low and high: bounds, a column a range.

        What is returned holds every range's k best allowed candidates, and their exact scores.
        """
        kind = np.float32 if np.abs(queries).sum(axis=1).max(initial=0) < 1 << 24 else np.float64  # products with a plane are exact
        asked = queries.astype(kind)
        partial, alive, pairs = np.zeros(allowed.shape), allowed, None
        for p in range(self.width - 1, -1, -1):
            less, more = self._interval(queries, p)
            plane = self.planes[p].astype(kind, copy=False)
            if pairs is None:
                partial += float(1 << p) * (asked @ plane.T)
                alive = self._wanted(partial + less[:, None], partial + more[:, None], alive, low, high, k)
                if alive.mean() < SPARSE or p == 0:
                    q, c = np.nonzero(alive)
                    pairs, partial = (q, c), partial[q, c]
            else:
                q, c = pairs
                partial = partial + float(1 << p) * np.einsum("ij,ij->i", asked[q], plane[c])
                keep = self._wanted_pairs(q, partial + less[q], partial + more[q], low, high, k)
                pairs, partial = (q[keep], c[keep]), partial[keep]
        q, c = pairs
        return q, c, partial - float(1 << (self.width - 1)) * queries.sum(axis=1)[q]

    @staticmethod
    def _wanted(least, most, alive, low, high, k):
        out = np.zeros(alive.shape, bool)
        for s in range(low.shape[1]):
            lo, hi = low[:, s : s + 1], high[:, s : s + 1]
            can = alive & (most >= lo) & (least <= hi)
            sure = can & (least >= lo) & (most <= hi)
            rich = np.flatnonzero(sure.sum(axis=1) >= k)
            if len(rich):
                floor = np.full(len(alive), -np.inf)
                floor[rich] = -np.partition(np.where(sure[rich], -least[rich], np.inf), k - 1, axis=1)[:, k - 1]
                can &= most >= floor[:, None]
            out |= can
        return out

    @staticmethod
    def _wanted_pairs(q, least, most, low, high, k):
        out = np.zeros(len(q), bool)
        for s in range(low.shape[1]):
            lo, hi = low[q, s], high[q, s]
            can = (most >= lo) & (least <= hi)
            sure = np.flatnonzero(can & (least >= lo) & (most <= hi))
            sure = sure[np.lexsort((-least[sure], q[sure]))]
            floor = np.full(len(low), -np.inf)
            first = np.searchsorted(q[sure], np.arange(len(low)))
            rich = np.flatnonzero(np.searchsorted(q[sure], np.arange(len(low)), side="right") - first >= k)
            floor[rich] = least[sure[first[rich] + k - 1]]
            out |= can & (most >= floor[q])
        return out


def _ranges(anchors: pa.Table) -> tuple[list[list], list[list]]:
    """Each anchor's lower and upper bounds, a pair for each positive (one open pair where positives are looked for)."""
    share = anchors.column("positives").to_pylist()
    low = [[-(-3 * int(s) // 10) for s in row] if row is not None else [-np.inf] for row in share]
    high = [[9 * int(s) // 10 for s in row] if row is not None else [np.inf] for row in share]
    for bounds, floor in zip(low, anchors.column("floor").to_pylist()):
        for i, f in enumerate(floor or []):
            if f is not None:
                bounds[i] = max(bounds[i], int(f))
    return low, high


def _plain(ids, labels, vectors, anchor_ids, anchor_labels, queries, low, high, same, k):
    """The same by whole numbers of any size."""
    for i, q in enumerate(queries):
        exact = [int(x) for x in q]
        rows = [(-sum(a * int(b) for a, b in zip(exact, v)), d) for d, y, v in zip(ids.tolist(), labels.tolist(), vectors) if d != anchor_ids[i] and (y == anchor_labels[i]) == same]
        for s, (lo, hi) in enumerate(zip(low[i], high[i])):
            for x, d in sorted((x, d) for x, d in rows if lo <= -x <= hi)[:k]:
                yield int(anchor_ids[i]), s, d, -x


def _found(k: int, same: bool, kind: str):
    schema = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64() if kind == LONG else pa.decimal128(38, 0))])

    def run(vectors: pa.Table, anchors: pa.Table) -> pa.Table:
        if not vectors.num_rows or not anchors.num_rows:
            return schema.empty_table()
        ids, labels, points = vectors.column("vec_id").to_numpy(), vectors.column("label").to_numpy(), _matrix(vectors, "v")
        anchor_ids, anchor_labels, queries = anchors.column("anchor_id").to_numpy(), anchors.column("label").to_numpy(), _matrix(anchors, "q")
        low, high = _ranges(anchors)
        if not float(np.abs(points).max()) * float(np.abs(queries).max()) * 4 * points.shape[1] < EXACT:
            rows = list(_plain(ids, labels, points, anchor_ids, anchor_labels, queries, low, high, same, k))
            return pa.table({f.name: pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)}, schema=schema)
        slots = max(map(len, low))
        low = np.array([[*map(float, x), *[np.inf] * (slots - len(x))] for x in low])  # a missing range is empty
        high = np.array([[*map(float, x), *[-np.inf] * (slots - len(x))] for x in high])
        held, out = BitPlanes(points), []
        step = max(1, CELLS // len(ids))
        for i in range(0, len(queries), step):
            part = slice(i, i + step)
            allowed = (labels == anchor_labels[part, None]) == same
            allowed &= ids != anchor_ids[part, None]
            q, c, score = held.search(queries[part], allowed, low[part], high[part], k)
            for s in range(slots):
                mine = np.flatnonzero((score >= low[part][q, s]) & (score <= high[part][q, s]))
                mine = mine[np.lexsort((ids[c[mine]], -score[mine], q[mine]))]
                first = np.searchsorted(q[mine], q[mine])
                mine = mine[np.arange(len(mine)) - first < k]
                out.append(pa.table({"anchor_id": anchor_ids[part][q[mine]], "slot": np.full(len(mine), s, np.int32), "vec_id": ids[c[mine]], "score": pa.array(score[mine].astype(np.int64)).cast(schema.field("score").type)}, schema=schema))
        return pa.concat_tables(out)

    return run


def _search(held: DataFrame, asked: DataFrame, shards: int, k: int, same: bool, kind: str) -> DataFrame:
    """asked: dim, block, anchor_id, label, q, positives. Each range's k best: anchor_id, slot, vec_id, score, rank."""
    keys = ["dim", "shard", "block"]

    def search(frame: DataFrame) -> DataFrame:
        side = frame.select(*keys, "anchor_id", "label", "q", "positives", "floor")
        return held.groupBy(*keys).cogroup(side.groupBy(*keys)).applyInArrow(lambda a, b: _found(k, same, kind)(a, b), f"anchor_id bigint, slot int, vec_id bigint, score {kind}")

    home = asked.withColumn("shard", F.pmod(F.xxhash64("anchor_id"), F.lit(shards))).withColumn("floor", F.lit(None).cast(f"array<{kind}>"))
    kth = search(home).groupBy("anchor_id", "slot").agg(F.when(F.count("*") >= k, F.min("score")).alias("f"))
    floors = C.stage(kth.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "f"))).alias("m")))  # a range is an entry
    ranges = F.sequence(F.lit(0), F.greatest(F.lit(1), F.coalesce(F.size("positives"), F.lit(1))) - 1)
    every = asked.join(floors, "anchor_id", "left").withColumn("floor", F.when(F.col("m").isNotNull(), F.transform(ranges, lambda i: F.try_element_at("m", i)))).drop("m")
    every = every.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))))
    best = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return search(every).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _largest(rows: DataFrame) -> tuple[int, int, float]:
    """Number of rows, their most components, and the largest component's size."""
    n, dim, top = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    return n, dim or 0, top or 0.0


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10) -> DataFrame:
    """vectors: (vec_id bigint, label, v array<double> of whole numbers); anchors: (anchor_id, label, v), ids distinct.

    anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = C.tune(vectors.sparkSession)
    (n, dim, top), (asked, _, top_asked) = _largest(vectors), _largest(anchors)
    kind = LONG if top * top_asked * dim < 2.0**62 else WIDE
    shards = max(1, -(-n // SHARD_ROWS), min(C.parts(spark), -(-n // 256)))
    blocks = max(1, -(-asked // ANCHOR_BLOCK))
    placed = vectors.select("vec_id", F.col("label").cast("bigint").alias("label"), "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"))
    held = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    block = F.pmod(F.xxhash64("anchor_id", F.lit(3)), F.lit(blocks))
    base = anchors.select("anchor_id", F.col("label").cast("bigint").alias("label"), F.col("v").alias("q"), F.size("v").alias("dim"), block.alias("block"))
    near = C.stage(_search(held, base.withColumn("positives", F.lit(None).cast(f"array<{kind}>")), shards, positives, True, kind))
    scores = near.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("positives"))
    far = _search(held, base.join(scores, "anchor_id"), shards, negatives, False, kind)
    pairs = near.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(pairs, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def labelled(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows of embeddings that take part; every seventh id's label is moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return quantised(rows.filter("label is not null").select("vec_id", "embedding", moved.alias("label")), keep=("label",))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = labelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    anchors = vectors.filter(F.col("vec_id") % 100 == 0).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "v")).alias("least")).select("anchor_id", "least.label", "least.v")
    return mine(vectors, anchors).withColumns({c: F.col(c).cast("bigint") for c in ("positive_score", "negative_score")})
