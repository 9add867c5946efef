"""Spectral operators.

Dense rows of a small dimension: only the moments, whose size is the dimension squared, reach the driver. Sparse matrices
with a side of at most DENSE: one tree-wise QR decomposition of the other side's rows, whose R factor has all values and
axes. Of other shapes: a randomised block Krylov method whose bases stay distributed on either side; the driver sees the R
factors of tree-wise QR decompositions, whose side is the number of basis vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import det
from quillspark.operators.metrics import second_moments
from quillspark.session import remove, scratch, stage

#: R factors that one task stacks; a small side is broadcast up to this many bytes; a dense block of sparse rows has so many.
FAN, BROADCAST_BYTES, BLOCK_BYTES = 32, 32 << 20, 16 << 20
#: A side of at most so many rows or columns needs no basis: its R factor (8 MB at most) goes to the driver.
DENSE = 1024


def _gram(df: DataFrame, column: str, dim: int) -> np.ndarray:
    m = np.zeros((dim + 1, dim + 1))
    for r in second_moments(df.select(F.lit(0).cast("bigint").alias("side"), column), column, dim).collect():
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["v"]
    return m


def singular_values(df: DataFrame, column: str, dim: int, k: int) -> list[float]:
    """The k greatest singular values of the matrix of rows."""
    return np.sqrt(np.clip(np.linalg.eigvalsh(_gram(df, column, dim)[:dim, :dim])[::-1][:k], 0, None)).tolist()


def right_basis(df: DataFrame, column: str, dim: int, k: int, centred: bool) -> tuple[np.ndarray, np.ndarray]:
    """(mean, k x dim basis); each axis points where its largest component is positive."""
    m = _gram(df, column, dim)
    n = max(1.0, m[dim, dim])
    mean = m[:dim, dim] / n if centred else np.zeros(dim)
    _, vectors = np.linalg.eigh(m[:dim, :dim] - n * np.outer(mean, mean))
    basis = vectors[:, ::-1][:, :k].T
    signs = np.sign(basis[np.arange(len(basis)), np.abs(basis).argmax(axis=1)])
    return mean, basis * np.where(signs == 0, 1, signs)[:, None]


def principal(df: DataFrame, key: str, column: str, dim: int, k: int) -> DataFrame:
    """(key, z): centred rows on the first k principal axes."""
    mean, basis = right_basis(df, column, dim, k, True)
    axes = [F.aggregate(F.zip_with(F.col(column), F.array(*map(F.lit, b.tolist())), lambda x, y: x * y), F.lit(float(-mean @ b)), lambda s, x: s + x) for b in basis]
    return df.select(key, F.array(*axes).alias("z"))


# ---------------------------------------------------------------- sparse matrices


def _matrix(batch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _stacked(blocks) -> np.ndarray | None:
    """R of rows that come in blocks."""
    r = None
    for block in blocks:
        if len(block):
            r = np.linalg.qr(block if r is None else np.concatenate([r, block]), mode="r")
    return r


_R = pa.schema([("part", pa.int64()), ("r", pa.binary())])


def _r_row(part: int, r: np.ndarray) -> dict:
    return {"part": pa.array([part], pa.int64()), "r": pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())}


def _r_of(df: DataFrame, blocks, width: int) -> np.ndarray:
    """R (width x width) of the QR decomposition of the rows that blocks makes of a partition's batches.

    A factor a partition, then two rounds of stacking FAN of them; the driver stacks what is left.
    """

    def leaf(batches):
        from pyspark import TaskContext

        r = _stacked(blocks(batches))
        if r is not None:
            yield pa.RecordBatch.from_pydict(_r_row(TaskContext.get().partitionId(), r), schema=_R)

    def join(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("part").to_numpy())
        r = _stacked(np.frombuffer(table.column("r")[int(i)].as_py()).reshape(-1, width) for i in order)
        return pa.table(_r_row(table.column("part")[int(order[0])].as_py() // FAN, r), schema=_R)

    held = df.mapInArrow(leaf, "part bigint, r binary")
    for _ in range(2):
        held = held.groupBy(F.expr(f"part div {FAN}")).applyInArrow(join, "part bigint, r binary")
    rest = sorted((r["part"], r["r"]) for r in held.collect())
    r = _stacked(np.frombuffer(b).reshape(-1, width) for _, b in rest)
    out = np.zeros((width, width))
    if r is not None:
        out[: len(r)] = r
    return out


def r_factor(df: DataFrame, columns: list[str], width: int) -> np.ndarray:
    """R of the rows whose entries lie in the array columns, one behind the other."""
    return _r_of(df.select(*columns), lambda batches: (np.concatenate([_matrix(b, c) for c in columns], axis=1) for b in batches if b.num_rows), width)


def _times(coo: DataFrame, side: DataFrame, by: str, to: str, width: int) -> DataFrame:
    """(to, y): the sparse matrix, or its transpose, times a block (by, z) of width columns."""
    small = F.broadcast(side) if side.count() * width * 8 <= BROADCAST_BYTES else side
    joined = coo.join(small, by)
    return joined.groupBy(to).agg(*[F.sum(F.col("value") * F.get("z", F.lit(i))).alias(f"_{i}") for i in range(width)]).select(to, F.array(*[f"_{i}" for i in range(width)]).alias("y"))


def _mapped(df: DataFrame, key: str, columns: dict[str, str], fn) -> DataFrame:
    """(key, columns): rows as matrices through fn, which takes and returns dicts of them."""
    schema = pa.schema([(key, pa.int64()), *((c, pa.list_(pa.float64())) for c in columns)])

    def run(batches):
        for b in batches:
            if b.num_rows:
                out = fn({c: _matrix(b, c) for c in b.schema.names if c != key})
                lists = [pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32) if x.shape[1] else np.zeros(b.num_rows + 1, np.int32), x.reshape(-1)) for x in (out[c] for c in columns)]
                yield pa.RecordBatch.from_arrays([b.column(key), *lists], schema=schema)

    return df.mapInArrow(run, f"{key} bigint, " + ", ".join(f"{c} array<double>" for c in columns))


def _orthogonal(state: DataFrame, held: int, width: int) -> tuple[DataFrame, int]:
    """(row, q, z) from (row, q, y): z spans what y adds to the orthonormal q; its number of columns. Done twice, as rounding asks."""
    for turn in range(2):
        r = r_factor(state, ["q", "y"], held + width)
        along, across = np.linalg.solve(r[:held, :held], r[:held, held:]), r[held:, held:]  # the basis is orthonormal up to signs
        _, s, vt = np.linalg.svd(across)
        scale = np.sqrt((r[:, held:] ** 2).sum(axis=0)).max(initial=0)
        keep = s > 1e-11 * scale if turn == 0 else s > 0.1
        turned = vt[keep].T / s[keep]
        state = _mapped(state, "row", {"q": "", "y": ""}, lambda m, a=along, t=turned: {"q": m["q"], "y": (m["y"] - m["q"] @ a) @ t})
        width = int(keep.sum())
        if not width:
            break
    return state.withColumnRenamed("y", "z"), width


class SparseSvd:
    """values: the k greatest singular values; left (row, z): rows times the right axes; right (col, axis)."""

    def __init__(self, values: list[float], left: DataFrame, right: DataFrame):
        self.values, self.left, self.right = values, left, right


def _dense(batches, columns: np.ndarray):
    """(rows, matrix over the sorted columns) of rows that come as (row, cells), in blocks of at most BLOCK_BYTES or one row a column."""
    most = max(len(columns), BLOCK_BYTES // (8 * len(columns)))
    for b in batches:
        for i in range(0, b.num_rows, most):
            part = b.slice(i, most)
            cells = part.column("cells")
            flat = cells.flatten()
            x = np.zeros((part.num_rows, len(columns)))
            x[np.repeat(np.arange(part.num_rows), cells.value_lengths().to_numpy()), np.searchsorted(columns, flat.field("col").to_numpy())] = flat.field("value").to_numpy()
            yield part.column("row"), x


def _narrow(coo: DataFrame, columns: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """(values, axes as columns, (row, z)) of a matrix (row, col, value) whose few columns are known; z: rows times the axes.

    A row has no more cells than there are columns. Each axis points where its first largest component is positive.
    """
    rows = coo.groupBy("row").agg(F.collect_list(F.struct("col", "value")).alias("cells"))
    _, s, turn = np.linalg.svd(_r_of(rows, lambda batches: (x for _, x in _dense(batches, columns)), len(columns)))
    s = s[: min(k, int((s > 0).sum()))]
    axes = turn[: len(s)].T
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(s))] >= 0, 1.0, -1.0)
    schema = pa.schema([("row", pa.int64()), ("z", pa.list_(pa.float64()))])

    def project(batches):
        for key, x in _dense(batches, columns):
            z = x @ axes
            yield pa.RecordBatch.from_arrays([key, pa.ListArray.from_arrays(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1], z.reshape(-1))], schema=schema)

    return s, axes, rows.mapInArrow(project, "row bigint, z array<double>")


def _axis_signs(right: DataFrame, n: int) -> np.ndarray:
    tops = right.agg(*[F.max(F.struct(F.abs(F.get("axis", F.lit(i))).alias("a"), (-F.col("col")).alias("c"), F.get("axis", F.lit(i)).alias("v"))).alias(f"_{i}") for i in range(n)]).first()
    return np.array([1.0 if t["v"] >= 0 else -1.0 for t in tops])


def _pairs(spark, keys: np.ndarray, name: str, rows: np.ndarray, value: str) -> DataFrame:
    """At most DENSE rows that the driver holds."""
    return spark.createDataFrame([(int(a), x.tolist()) for a, x in zip(keys, rows)], f"{name} bigint, {value} array<double>")


def sparse_svd(coo: DataFrame, k: int, oversample: int = 8, seed: int = 0, tolerance: float = 1e-13, most: int = 64) -> SparseSvd:
    """Truncated SVD of a sparse matrix given as (row, col, value); entries of one place add up.

    k is cut to one less than either side, as the smaller side allows. Where a side has at most DENSE rows or columns the cells
    are all that is stored. Else a random block (a function of seed and column) is
    multiplied by the matrix and its transpose in turn; each product's new directions join the basis. It ends once the
    values stand still within the tolerance, or nothing new comes; after `most` blocks without that it raises. Each axis points where
    its largest component (of ties the one of the smallest column) is positive. Null, non-finite and zero entries count as not there.
    """
    cells = coo.select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.col("value").cast("double").alias("value"))
    coo = stage(cells.filter("row is not null and col is not null and abs(value) < double('inf')").groupBy("row", "col").agg(F.sum("value").alias("value")).filter("value <> 0"))
    few = {side: np.array(sorted(r[side] for r in coo.select(side).distinct().limit(max(DENSE, k) + 1).collect()), np.int64) for side in ("row", "col")}
    k = min(k, *(len(x) - 1 for x in few.values()))
    if k < 1:
        raise ValueError(f"a matrix of {len(few['row'])} x {len(few['col'])} has no truncated decomposition")
    spark = coo.sparkSession
    if len(few["col"]) <= DENSE:
        s, axes, left = _narrow(coo, few["col"], k)
        return SparseSvd(s.tolist(), left, _pairs(spark, few["col"], "col", axes, "axis"))
    if len(few["row"]) <= DENSE:
        s, axes, across = _narrow(coo.select(F.col("col").alias("row"), F.col("row").alias("col"), "value"), few["row"], k)
        right = _mapped(across.withColumnRenamed("row", "col"), "col", {"axis": ""}, lambda m: {"axis": m["z"] / s})
        signs = _axis_signs(right, len(s))
        right = _mapped(right, "col", {"axis": ""}, lambda m: {"axis": m["axis"] * signs})
        return SparseSvd(s.tolist(), _pairs(spark, few["row"], "row", axes * (s * signs), "z"), right)
    rows, columns = stage(coo.select("row").distinct()), stage(coo.select("col").distinct())
    sides = (rows.count(), columns.count())
    width = min(k + oversample, *sides)
    block = columns.select("col", F.array(*[det.gauss(det.digest(seed, "omega", F.col("col"), F.lit(i))) for i in range(width)]).alias("z"))
    basis = rows.withColumn("q", F.array().cast("array<double>"))
    image = columns.withColumn("q", F.array().cast("array<double>"))  # the transpose times the basis
    held, before, old = 0, None, []  # old: tables of the last round, which nothing reads once this one's are there
    for _ in range(most):
        first, second, third = (scratch(spark, "stage") for _ in range(3))
        state = stage(basis.join(_times(coo, block, "col", "row", width), "row"), first)
        state, new = _orthogonal(state, held, width)
        if new:
            state = stage(state, second)
            remove(spark, first)
            pushed = _times(coo, state.select("row", "z"), "row", "col", new)
            image = stage(image.join(pushed.withColumnRenamed("y", "z"), "col").select("col", F.concat("q", "z").alias("q"), "z"), third)
            for path in old:
                remove(spark, path)
            old = [second, third]
            basis = state.select("row", F.concat("q", "z").alias("q"))
            block, image = image.select("col", "z"), image.select("col", "q")
            held, width = held + new, new
            _, s, turn = np.linalg.svd(r_factor(image, ["q"], held))
            still = before is not None and len(before) >= k and np.abs(s[:k] - before[:k]).max() <= tolerance * s[0]
            before = s
        if not new or still or held == min(sides):
            break
    else:
        raise ArithmeticError(f"the singular values still move after {most} blocks")
    turn = turn[: min(k, int((s > 0).sum()))].T
    s = s[: turn.shape[1]]
    right = _mapped(image, "col", {"axis": ""}, lambda m: {"axis": m["q"] @ turn / s})
    signs = _axis_signs(right, len(s))
    right = _mapped(right, "col", {"axis": ""}, lambda m: {"axis": m["axis"] * signs})
    left = _mapped(basis, "row", {"z": ""}, lambda m: {"z": m["q"] @ turn * (s * signs)})
    return SparseSvd(s.tolist(), left, right)
