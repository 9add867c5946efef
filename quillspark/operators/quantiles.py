"""Exact order statistics of all components of vectors at once, by histograms that are refined.

A task keeps, for each component and wanted rank, BINS counts with the least and greatest value of each bin: its state is bounded
by components x ranks x BINS whatever the rows. The tables of tasks are added up in two rounds of FAN. The bin that holds a
rank is cut into BINS bins in the next pass; the rank is found once all values of its bin are equal, or it is the first or last of it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS, FAN = 256, 32
_SCHEMA = pa.schema([("part", pa.int64()), ("n", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])
_DDL = "part bigint, n binary, low binary, high binary"


def _row(part: int, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> dict:
    return {"part": pa.array([part], pa.int64()), "n": pa.array([n.tobytes()], pa.binary()), "low": pa.array([low.tobytes()], pa.binary()), "high": pa.array([high.tobytes()], pa.binary())}


def _merge(table: pa.Table) -> pa.Table:
    rows = [[np.frombuffer(x, kind) for x in table.column(c).to_pylist()] for c, kind in (("n", np.int64), ("low", float), ("high", float))]
    return pa.table(_row(table.column("part")[0].as_py() // FAN, np.sum(rows[0], axis=0), np.min(rows[1], axis=0), np.max(rows[2], axis=0)), schema=_SCHEMA)


def _counted(df: DataFrame, column: str, low: np.ndarray, high: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each component and interval [low, high] the bins' counts, least and greatest values: arrays dim x intervals x bins."""
    dim, slots = low.shape

    def count(batches):
        from pyspark import TaskContext

        n = np.zeros((slots, dim * bins), np.int64)
        least, most = np.full((slots, dim * bins), np.inf), np.full((slots, dim * bins), -np.inf)
        base = np.arange(dim) * bins
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            for s in range(slots):
                lo, hi = low[:, s], high[:, s]
                with np.errstate(invalid="ignore", over="ignore"):
                    inside = np.isfinite(x) & (x >= lo) & (x <= hi)
                    half = hi / 2 - lo / 2  # the width of an interval may exceed the largest double
                    at = np.floor((x / 2 - lo / 2) / np.where((half > 0) & np.isfinite(half), half, 1) * bins)
                i, j = np.nonzero(inside)
                flat, v = base[j] + np.clip(np.nan_to_num(at[i, j]), 0, bins - 1).astype(np.int64), x[i, j]
                n[s] += np.bincount(flat, minlength=dim * bins)
                np.minimum.at(least[s], flat, v)
                np.maximum.at(most[s], flat, v)
        yield pa.RecordBatch.from_pydict(_row(TaskContext.get().partitionId(), n, least, most), schema=_SCHEMA)

    held = df.select(column).filter(F.col(column).isNotNull()).mapInArrow(count, _DDL)
    for _ in range(2):
        held = held.groupBy(F.expr(f"part div {FAN}")).applyInArrow(_merge, _DDL)
    rows = pa.table({f.name: pa.array([r[f.name] for r in got], f.type) for f in _SCHEMA}, schema=_SCHEMA) if (got := held.collect()) else None
    if rows is None:
        return np.zeros((dim, slots, bins), np.int64), np.full((dim, slots, bins), np.inf), np.full((dim, slots, bins), -np.inf)
    one = _merge(rows)
    shape = lambda c, kind: np.frombuffer(one.column(c)[0].as_py(), kind).reshape(slots, dim, bins).transpose(1, 0, 2)
    return shape("n", np.int64), shape("low", float), shape("high", float)


def order_statistics(df: DataFrame, column: str, dim: int, ranks: Callable[[int], list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(n, values): each component's number of finite values, and those of the 0-based ranks that `ranks` gives for that number (NaN without values)."""
    n, low, high = _counted(df, column, np.full((dim, 1), -np.inf), np.full((dim, 1), np.inf), 1)
    n, low, high = n[:, 0, 0], low[:, :, 0], high[:, :, 0]
    left = np.array([ranks(int(k)) for k in n], np.int64).reshape(dim, -1)
    low, high = np.repeat(low, left.shape[1], axis=1), np.repeat(high, left.shape[1], axis=1)
    values = np.where(low == high, low, np.nan)
    values = np.where(left == 0, low, np.where(left == n[:, None] - 1, high, values))
    values[n == 0] = np.nan
    open_ = np.isnan(values) & (n > 0)[:, None]
    while open_.any():
        counts, least, most = _counted(df, column, np.where(open_, low, np.inf), np.where(open_, high, -np.inf), BINS)
        for i, j in zip(*np.nonzero(open_)):
            ends = np.cumsum(counts[i, j])
            at = int(np.searchsorted(ends, left[i, j], side="right"))
            left[i, j] -= ends[at] - counts[i, j, at]
            low[i, j], high[i, j] = least[i, j, at], most[i, j, at]
            if low[i, j] == high[i, j] or left[i, j] == 0 or left[i, j] == counts[i, j, at] - 1:
                values[i, j] = low[i, j] if left[i, j] == 0 else high[i, j]
        open_ = np.isnan(values) & (n > 0)[:, None]
    return n, values
