"""Exact nearest neighbours with pruning by balls.

Reference rows are dealt to the cell of their nearest pivot; a cell is known by its pivot, and its least and greatest distance
from it. No row of a cell is nearer to a query than the triangle inequality allows: d - greatest, or least - d. A query
first meets its home cell, whose best distance travels with it; it is shipped on only to the cells whose bound does not
exceed that distance, once a bundle of neighbouring cells of about a shard's rows: where balls exclude little, a query's
copies follow the shards, not the cells. Bundles that nobody asks are not shipped at all. Large ones are cut into shards, and
their queries into blocks, so no task holds more than a shard and a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import stage

#: Rows that a pivot stands for, and the most pivots, which the driver holds.
CELL_ROWS, MAX_PIVOTS = 2048, 4096
SHARD_ROWS, QUERY_ROWS = 16384, 16384
#: Relative slack of distances that come from products.
SLACK = 1e-6


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(rows, -1)


def plain_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows that face each other, by plain differences: no cancellation."""
    d2 = np.zeros(len(a))
    for k in range(a.shape[1]):
        d2 += (a[:, k] - b[:, k]) ** 2
    return d2


def squares(a: np.ndarray, b: np.ndarray, near: float = 0.0) -> np.ndarray:
    """Squared distances by products; those below the share near of the squared lengths are taken by plain differences."""
    a2, b2 = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    d2 = a @ b.T
    d2 *= -2
    d2 += a2[:, None]
    d2 += b2[None, :]
    if near:
        i, j = np.nonzero(d2 <= near * (a2 + b2.max(initial=0))[:, None])
        for k in range(0, len(i), 1 << 16):
            d2[i[k : k + (1 << 16)], j[k : k + (1 << 16)]] = plain_squares(a[i[k : k + (1 << 16)]], b[j[k : k + (1 << 16)]])
    return d2


def _rough(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances by products."""
    return np.sqrt(np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T))


class Cells:
    """Reference rows by cell, staged, and what the driver knows of the cells."""

    def __init__(self, reference: DataFrame):
        rows = reference.select("ref_id", "e").filter("ref_id is not null and e is not null")
        n = rows.count()
        first = rows.withColumn("_h", F.xxhash64("ref_id")).orderBy("_h", "ref_id").limit(min(MAX_PIVOTS, max(1, -(-n // CELL_ROWS))))
        self.pivots = np.array([r["e"] for r in first.collect()], float)
        pivots, schema = self.pivots, pa.schema([("ref_id", pa.int64()), ("e", pa.list_(pa.float64())), ("cell", pa.int32()), ("d", pa.float64())])

        def deal(batches):
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column("e"), b.num_rows)
                    cell = _rough(x, pivots).argmin(axis=1).astype(np.int32)
                    d = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
                    yield pa.RecordBatch.from_arrays([b.column("ref_id"), b.column("e"), pa.array(cell), pa.array(d)], schema=schema)

        self.rows = stage(rows.mapInArrow(deal, "ref_id bigint, e array<double>, cell int, d double"))
        known = self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))
        self.sizes = stage(known.withColumn("shards", F.ceil(F.col("n") / SHARD_ROWS).cast("int")))  # a row a pivot
        found = sorted((r["cell"], r["low"], r["high"], r["n"]) for r in self.sizes.collect())
        self.cell = np.array([c for c, _, _, _ in found], np.int32)
        self.low, self.high = np.array([x for _, x, _, _ in found]), np.array([x for _, _, x, _ in found])
        self.bundle = self._bundles(np.array([n for _, _, _, n in found], np.int64))

    def _bundles(self, sizes: np.ndarray) -> np.ndarray:
        """Bundle of each cell: the nearest free cells join the first free one while a shard holds them."""
        bundle = np.full(len(sizes), -1, np.int32)
        for i in range(len(sizes)):
            if bundle[i] < 0:
                free = np.flatnonzero(bundle < 0)
                free = free[np.argsort(_rough(self.pivots[self.cell[[i]]], self.pivots[self.cell[free]])[0], kind="stable")]
                free = np.r_[i, free[free != i]]
                bundle[free[: max(1, int(np.searchsorted(np.cumsum(sizes[free]), SHARD_ROWS, side="right")))]] = i
        return bundle

    def bundled(self) -> tuple[DataFrame, DataFrame]:
        """(rows, sizes) by bundle."""
        spark = self.rows.sparkSession
        of = F.broadcast(spark.createDataFrame(list(zip(self.cell.tolist(), self.bundle.tolist())), "cell int, bundle int"))  # a row a pivot
        put = lambda df: df.join(of, "cell").drop("cell").withColumnRenamed("bundle", "cell")
        sizes = put(self.sizes.select("cell", "n")).groupBy("cell").agg(F.ceil(F.sum("n") / SHARD_ROWS).cast("int").alias("shards"))
        return put(self.rows), sizes

    def home(self, queries: DataFrame) -> DataFrame:
        """(query_id, q, cell): the cell of the nearest pivot."""
        cell, pivots = self.cell, self.pivots[self.cell]
        schema = pa.schema([("query_id", pa.int64()), ("q", pa.list_(pa.float64())), ("cell", pa.int32())])

        def run(batches):
            for b in batches:
                if b.num_rows:
                    near = _rough(_matrix(b.column("q"), b.num_rows), pivots).argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("q"), pa.array(cell[near])], schema=schema)

        return queries.select("query_id", "q").filter("query_id is not null and q is not null").mapInArrow(run, "query_id bigint, q array<double>, cell int")

    def further(self, asked: DataFrame) -> DataFrame:
        """(query_id, q, cell) of the bundles with other cells that may hold a row as near as best; asked: query_id, q, cell (its home), best."""
        cell, pivots, low, high = self.cell, self.pivots[self.cell], self.low, self.high
        names, number = np.unique(self.bundle, return_inverse=True)
        order = np.argsort(number, kind="stable")
        starts = np.searchsorted(number[order], np.arange(len(names)))
        schema = pa.schema([("query_id", pa.int64()), ("q", pa.list_(pa.float64())), ("cell", pa.int32())])

        def run(batches):
            for b in batches:
                for i in range(0, b.num_rows, 1024):
                    part = b.slice(i, 1024)
                    x = _matrix(part.column("q"), part.num_rows)
                    d = _rough(x, pivots)
                    slack = SLACK * (1e-300 + np.sqrt((x * x).sum(axis=1))[:, None] + np.sqrt((pivots * pivots).sum(axis=1))[None, :])
                    bound = np.maximum(d - high, low - d) - slack
                    go = (bound <= part.column("best").to_numpy()[:, None]) & (cell[None, :] != part.column("cell").to_numpy()[:, None])
                    who, where = np.nonzero(np.logical_or.reduceat(go[:, order], starts, axis=1))
                    for k in range(0, len(who), 4096):
                        few = pa.array(who[k : k + 4096])
                        yield pa.RecordBatch.from_arrays([part.column("query_id").take(few), part.column("q").take(few), pa.array(names[where[k : k + 4096]])], schema=schema)

        return asked.select("query_id", "q", "cell", "best").mapInArrow(run, "query_id bigint, q array<double>, cell int")

    def meet(self, asked: DataFrame, bundles: bool = False) -> DataFrame:
        """(query_id, ref_id, d2): the nearest row of each shard of the cells (or bundles) asked. asked (staged): query_id, q, cell."""
        rows, sizes = self.bundled() if bundles else (self.rows, self.sizes)
        blocks = stage(asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks")).join(F.broadcast(sizes.select("cell", "shards")), "cell"))  # a row a pivot at most
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = asked.join(F.broadcast(blocks), "cell").withColumn("b", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("s", every("shards")).select("cell", "b", "s", "query_id", "q")
        right = rows.join(F.broadcast(blocks), "cell").withColumn("s", F.pmod(F.xxhash64("ref_id"), F.col("shards")).cast("int")).withColumn("b", every("blocks")).select("cell", "b", "s", "ref_id", "e")
        keys = ["cell", "b", "s"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: _nearest(a, b), "query_id bigint, ref_id bigint, d2 double")


def _nearest(a: pa.Table, b: pa.Table) -> pa.Table:
    schema = pa.schema([("query_id", pa.int64()), ("ref_id", pa.int64()), ("d2", pa.float64())])
    if not a.num_rows or not b.num_rows:
        return schema.empty_table()
    b = b.sort_by("ref_id")
    q, r = _matrix(a.column("q"), a.num_rows), _matrix(b.column("e"), b.num_rows)
    best, at = np.full(len(q), np.inf), np.zeros(len(q), np.int64)
    slack = 8 * (q.shape[1] + 8) * np.finfo(float).eps * ((q * q).sum(axis=1) + (r * r).sum(axis=1).max())
    for i in range(0, len(r), 1024):
        for k in range(0, len(q), 256):
            rough = squares(q[k : k + 256], r[i : i + 1024])
            mine, loose = slice(k, k + len(rough)), slack[k : k + len(rough)]
            # what products leave open is decided by plain differences
            who, where = np.nonzero(rough <= (np.minimum(best[mine], np.fmin.reduce(rough, axis=1) + loose) + loose)[:, None])
            for j in range(0, len(who), 1 << 16):
                w, x = who[j : j + (1 << 16)], where[j : j + (1 << 16)]
                d2 = plain_squares(q[k + w], r[i + x])
                order = np.lexsort((x, d2, w))
                order = order[np.r_[True, np.diff(w[order]) > 0]]
                order = order[d2[order] < best[k + w[order]]]  # rows come by id: the first of ties stays
                best[k + w[order]], at[k + w[order]] = d2[order], i + x[order]
    return pa.table({"query_id": a.column("query_id").to_numpy(), "ref_id": b.column("ref_id").to_numpy()[at], "d2": best}, schema=schema)


def nearest(queries: DataFrame, reference: DataFrame) -> DataFrame:
    """(query_id, ref_id, d2) of the nearest reference row, ties to the smaller id. queries (query_id, q), reference (ref_id, e).

    Ids of queries are distinct. Rows with a null id or vector take no part; with no reference row there is no result.
    """
    cells = Cells(reference)
    if not len(cells.cell):
        return queries.sparkSession.createDataFrame([], "query_id bigint, ref_id bigint, d2 double")
    home = stage(cells.home(queries))
    first = stage(cells.meet(home).groupBy("query_id").agg(F.min(F.struct("d2", "ref_id")).alias("m")))
    asked = home.join(first.select("query_id", F.sqrt("m.d2").alias("best")), "query_id")
    more = cells.meet(stage(cells.further(asked)), bundles=True)
    every = first.select("query_id", "m.ref_id", "m.d2").union(more)
    return every.groupBy("query_id").agg(F.min(F.struct("d2", "ref_id")).alias("m")).select("query_id", "m.ref_id", "m.d2")
