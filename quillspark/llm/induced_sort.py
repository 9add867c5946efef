"""External induced sorting of suffixes with common-prefix values (after Bingmann, Fischer and Osipov 2013).

The suffixes at local minima (LMS) are sorted by recursion on the string of their ranked substrings; all others follow
by two sweeps: an ascending one induces the L-type suffixes, a descending one the S-type ones. Suffix tuples (position,
common prefix with the tuple before) wait in a monotone priority queue keyed by first symbol and arrival; the queue
keeps its tuples in memory up to a budget and in a file of the task's own folder beyond it, and hands a bucket back in
blocks. The common prefix of an induced tuple is 1 + the least common prefix between its source and the source before
it in that bucket, answered by a sparse table over the block and one carried minimum a bucket.

Order and common prefixes are exact up to CAP symbols, all that a match of CAP needs. The recursion's string is sorted by
doubling once CAP symbols are covered by at most nine rounds.
"""

from __future__ import annotations

import tempfile

import numpy as np

from quillspark.llm import _text as X

SYMBOLS = 257  # 0 separates, byte b is b + 1
BATCH = 1 << 18
TUPLE = np.dtype([("pos", np.int32), ("lcp", np.int16)])


class BucketQueue:
    """Tuples by bucket in order of arrival; beyond the budget they go to disk."""

    def __init__(self, budget: int):
        self.budget, self.held, self.file, self.size = budget, 0, None, 0
        self.buckets: list[list] = [[] for _ in range(SYMBOLS)]

    def push(self, bucket: int, tuples: np.ndarray) -> None:
        if not len(tuples):
            return
        if self.held + tuples.nbytes > self.budget:
            if self.file is None:
                self.file = tempfile.TemporaryFile(prefix="induce-")
            self.file.seek(self.size)
            self.file.write(tuples.tobytes())
            self.buckets[bucket].append((self.size, len(tuples)))
            self.size += tuples.nbytes
        else:
            self.held += tuples.nbytes
            self.buckets[bucket].append(tuples)

    def blocks(self, bucket: int, backwards: bool = False, keep: bool = False):
        """The bucket's tuples in blocks, in order of arrival or in reverse; tuples pushed meanwhile follow."""
        entries, i = self.buckets[bucket], 0
        while i < len(entries):
            group, size = [], 0
            while i < len(entries) and size < BATCH:
                e = entries[-1 - i if backwards else i]
                i += 1
                if isinstance(e, tuple):
                    self.file.seek(e[0])
                    group.append(np.frombuffer(self.file.read(e[1] * TUPLE.itemsize), TUPLE))
                else:
                    group.append(e)
                    if not keep:
                        self.held -= e.nbytes
                size += len(group[-1])
            got = np.concatenate(group[::-1] if backwards else group) if len(group) > 1 else group[0]
            for a in range(0, len(got), BATCH):
                yield got[max(0, len(got) - a - BATCH) : len(got) - a] if backwards else got[a : a + BATCH]
        if not keep:
            self.buckets[bucket] = []

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Carry:
    """Least common prefix since the last push to each bucket; -1: nothing was pushed."""

    def __init__(self, cap: int):
        self.since, self.cap = np.full(SYMBOLS, -1, np.int32), cap

    def induce(self, bucket: np.ndarray, source: np.ndarray, lcp: np.ndarray):
        """For sources (indices into lcp, ascending) and their buckets: order by bucket and the induced common prefixes."""
        order = np.argsort(bucket, kind="stable")
        b, k = bucket[order], source[order]
        first = np.concatenate([[True], b[1:] != b[:-1]]) if len(b) else np.zeros(0, bool)
        since = self.since[b]
        left = np.where(first, 0, np.concatenate([[0], k[:-1] + 1]) if len(k) else 0)
        low = _range_min(lcp, left, k)
        low = np.where(first, np.where(since < 0, -1, np.minimum(since, low)), low)
        out = np.minimum(low + 1, self.cap).astype(np.int16)
        whole = int(lcp.min()) if len(lcp) else self.cap
        pushed = self.since >= 0
        self.since[pushed] = np.minimum(self.since[pushed], whole)
        if len(b):
            last = np.concatenate([b[1:] != b[:-1], [True]])
            at = k[last] + 1
            rest = np.full(len(at), self.cap, np.int32)
            inside = at < len(lcp)
            if inside.any():
                tail = np.minimum.accumulate(lcp[::-1])[::-1]
                rest[inside] = tail[at[inside]]
            self.since[b[last]] = rest
        return order, out


def _range_min(x: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """min(x[left..right]) inclusive, by a sparse table."""
    out = np.empty(len(left), np.int32)
    if not len(left):
        return out
    span = right - left + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    table, step = x, 1
    for k in range(int(level.max()) + 1):
        mine = level == k
        if mine.any():
            out[mine] = np.minimum(table[left[mine]], table[right[mine] - step + 1])
        if len(table) > step:
            table = np.minimum(table[:-step], table[step:])
        step *= 2
    return out


def text_of(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the parts, each closed by a separator, and where each part begins."""
    lengths = np.array([len(p) for p in parts], np.int64)
    begins = np.cumsum(lengths + 1) - lengths - 1
    text = np.zeros(int(lengths.sum()) + len(parts), np.uint16)
    text[X.ragged(begins, lengths)] = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint16) + 1
    return text, begins


def _types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """S-type flags and the length of the run of equal symbols from each position; the end counts as least."""
    n = len(text)
    change = np.flatnonzero(np.concatenate([text[1:] != text[:-1], [True]]))
    stop = change[np.searchsorted(change, np.arange(n))]  # last position of the run
    after = np.where(stop + 1 < n, text[np.minimum(stop + 1, n - 1)].astype(np.int32), -1)
    return after > text, np.minimum(stop - np.arange(n) + 1, 30000).astype(np.int16)


def _sums(text: np.ndarray) -> np.ndarray:
    table = X.mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * X.U(X.RADIX))
    out = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(table[text] * X.powers(len(text) + 1)[0][: len(text)], out=out[1:])
    return out


def _common(sums: np.ndarray, a: np.ndarray, b: np.ndarray, n: int, cap: int) -> np.ndarray:
    """Common prefixes of suffixes a and b, up to cap, by halving on hashes."""
    out = np.zeros(len(a), np.int64)
    step = 1 << (cap.bit_length() - 1)
    while step:
        more = np.minimum(out + step, cap)
        fits = (np.maximum(a, b) + more <= n) & (more > out)
        i = np.flatnonzero(fits)
        equal = X.span_hashes(sums, a[i], a[i] + more[i]) == X.span_hashes(sums, b[i], b[i] + more[i])
        out[i[equal]] = more[i[equal]]
        step >>= 1
    return out


def _sort_minima(text: np.ndarray, lms: np.ndarray, sums: np.ndarray, cap: int) -> np.ndarray:
    """LMS positions in suffix order: names their substrings, then sorts the string of names."""
    n = len(text)
    end = np.minimum(np.append(lms[1:] + 1, n), n)
    h = X.span_hashes(sums, lms, end)
    h[-1] = X.mix(h[-1:] + X.U(1))[0]  # the last substring ends with the text
    _, at, name = np.unique(h, return_index=True, return_inverse=True)
    wide = text.astype(">u2").tobytes()
    # of two substrings, one a prefix of the other, the longer is less: its symbol there is of type L
    keys = [wide[2 * int(lms[i]) : 2 * int(end[i])] + (b"\xff\xff" if i != len(lms) - 1 else b"") for i in at]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    rank_of = np.empty(len(keys), np.int64)
    rank_of[order] = np.arange(len(keys))
    rank = rank_of[name]
    width, m = 1, len(lms)
    while width < cap and int(rank.max(initial=0)) + 1 < m:
        follow = np.zeros(m, np.int64)
        follow[:-width] = rank[width:] + 1
        _, rank = np.unique(rank * (m + 2) + follow, return_inverse=True)
        width *= 2
    return lms[np.argsort(rank, kind="stable")]


def repeated(text: np.ndarray, cap: int, budget: int = 64 << 20) -> np.ndarray:
    """Flags of the suffixes whose first cap symbols start another suffix too. text ends with a separator."""
    n = len(text)
    flags = np.zeros(n, bool)
    if n == 0:
        return flags
    if n > np.iinfo(np.int32).max:
        raise ValueError("a shard holds at most 2^31 - 1 symbols; use more shards")
    stype, run = _types(text)
    run = np.minimum(run, cap)  # int16, as the tuples
    lms = np.flatnonzero(stype[1:] & ~stype[:-1]) + 1
    sums = _sums(text)
    large, small, minima = BucketQueue(budget // 2), BucketQueue(budget // 2), [np.zeros(0, TUPLE)] * SYMBOLS
    try:
        if len(lms):
            order = _sort_minima(text, lms, sums, cap)
            common = np.concatenate([[0], _common(sums, order[:-1], order[1:], n, cap)])
            symbol = text[order]
            cut = np.searchsorted(symbol, np.arange(SYMBOLS + 1))
            for c in range(SYMBOLS):
                minima[c] = np.empty(cut[c + 1] - cut[c], TUPLE)
                minima[c]["pos"], minima[c]["lcp"] = order[cut[c] : cut[c + 1]], common[cut[c] : cut[c + 1]]
        del sums
        _ascend(text, stype, run, cap, large, minima)
        del minima
        _descend(text, stype, run, cap, large, small, flags)
    finally:
        large.close()
        small.close()
    return flags


def _ascend(text, stype, run, cap, large, minima) -> None:
    """Induces the L-type suffixes into their buckets, least first."""
    carry, start = Carry(cap), np.zeros(1, TUPLE)
    start["pos"] = len(text) - 1
    large.push(int(text[-1]), start)  # induced by the end of the text
    carry.since[text[-1]] = 0
    for c in range(SYMBOLS):
        last, first = -1, True  # position scanned last in this bucket
        for kind in (0, 1):
            for block in large.blocks(c, keep=True) if kind == 0 else (minima[c][a : a + BATCH] for a in range(0, len(minima[c]), BATCH)):
                lcp = block["lcp"].astype(np.int16)
                if first:
                    lcp[0] = 0
                elif kind == 1 and last_kind == 0:
                    lcp[0] = min(run[last], run[block["pos"][0]])
                first, last, last_kind = False, int(block["pos"][-1]), kind
                _push(text, ~stype, block["pos"], lcp, carry, large)


def _descend(text, stype, run, cap, large, small, flags) -> None:
    """Induces the S-type suffixes from the greatest down and flags neighbours that share cap symbols."""
    carry = Carry(cap)
    for c in range(SYMBOLS - 1, -1, -1):
        last, edge = -1, 0
        for kind in (0, 1):
            for block in small.blocks(c) if kind == 0 else large.blocks(c, backwards=True):
                pos = block["pos"] if kind == 0 else block["pos"][::-1]
                if kind == 0:
                    lcp = block["lcp"].astype(np.int16)  # with the tuple pushed before, which is greater
                    if last < 0:
                        lcp[0] = 0
                else:
                    own = block["lcp"][::-1]  # with the lesser neighbour
                    lcp = np.empty(len(own), np.int16)
                    lcp[1:] = own[:-1]
                    lcp[0] = edge if last >= 0 and last_kind == 1 else min(run[last], run[pos[0]]) if last >= 0 else 0
                    edge = own[-1]
                same = np.flatnonzero(lcp >= cap)
                flags[pos[same]] = True
                flags[np.where(same > 0, pos[same - 1], last)] = True
                last, last_kind = int(pos[-1]), kind
                _push(text, stype, pos, lcp, carry, small)


def _push(text, wanted, pos, lcp, carry, queue) -> None:
    """Sends the suffixes one position to the left, if of the wanted type, to their buckets."""
    left = pos.astype(np.int64) - 1
    source = np.flatnonzero((left >= 0) & wanted[np.maximum(left, 0)])
    order, common = carry.induce(text[left[source]], source, lcp)
    source = source[order]
    tuples = np.empty(len(source), TUPLE)
    tuples["pos"], tuples["lcp"] = left[source], common
    bucket = text[left[source]]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else []
    for a, b in zip(cut[:-1], cut[1:]):
        queue.push(int(bucket[a]), tuples[a:b])


