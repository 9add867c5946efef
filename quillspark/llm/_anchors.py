"""Content anchors: for every window of bytes the least hash of the grams inside it, so equal windows have equal anchors."""

from __future__ import annotations

import numpy as np

from quillspark.llm import _text as X

POSITION_BITS = 31


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i : i + w] for every i up to len(x) - w."""
    n = len(x)
    rows = -(-n // w)
    grid = np.full(rows * w, np.iinfo(x.dtype).max, x.dtype)
    grid[:n] = x
    grid = grid.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def runs(buf: np.ndarray, off: np.ndarray, length: int, gram: int):
    """Runs of window starts that share an anchor: (document, first start, last start, anchor hash, anchor position), in buf's positions.

    Documents shorter than length have no window.
    """
    z = np.zeros(0, np.int64)
    if len(buf) < length:
        return z, z, z, z.astype(np.uint64), z
    sums = X.prefix(buf)
    at = np.arange(len(buf) - gram + 1)
    g = X.span_hashes(sums, at, at + gram)
    low = X.U((1 << POSITION_BITS) - 1)
    best = sliding_min((g & ~low) | at.astype(np.uint64), length - gram + 1) & low
    doc = np.flatnonzero(np.diff(off) >= length)
    count = np.diff(off)[doc] - length + 1
    start = X.ragged(off[doc], count)
    owner = np.repeat(doc, count)
    anchor = best[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    place = anchor[first].astype(np.int64)
    return owner[first], start[first], start[last], X.mix(g[place]), place  # least hashes crowd near 0: spread them
