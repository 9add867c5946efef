"""A bounded memory of what a unit of text encodes to, by its bytes, in flat arrays."""

from __future__ import annotations

import numpy as np

from quillspark.llm import _text as X

#: A longer unit is encoded each time that it comes.
LONGEST = 4096


def unlike(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers of the spans whose bytes differ: a[a_start : a_start + size] against b."""
    odd = np.flatnonzero(a[X.ragged(a_start, size)] != b[X.ragged(b_start, size)])
    return np.unique(np.searchsorted(np.cumsum(size), odd, side="right")) if len(odd) else odd


class UnitTable:
    """Ids (any whole numbers) of units seen before. Each hash has two slots; a newcomer pushes the older of the two out.

    A slot is found by a unit's hash and taken only if the unit's bytes are the same; units whose hashes are equal and
    whose bytes differ are encoded without being kept. All ids lie in one array, which is emptied, with the slots, once
    it holds limit ids or as many bytes times eight.
    """

    def __init__(self, slots: int = 1 << 21, limit: int = 4 << 20):
        self.bits, self.limit = int(slots).bit_length() - 1, limit
        self.key = np.zeros(slots, np.uint64)
        self.start, self.size = np.zeros(slots, np.int32), np.full(slots, -1, np.int32)
        self.text_start, self.text_size = np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self._empty()

    def _empty(self) -> None:
        self.size[:] = -1
        self.ids, self.used = np.empty(1 << 16, np.int32), 0
        self.text, self.text_used = np.empty(1 << 16, np.uint8), 0

    def _hashes(self, buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return X.exact_hashes(buf, begin, end)

    def _unlike(self, a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return unlike(a, a_start, b, b_start, size)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> X.U(64 - self.bits)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Slots of hashes; -1: not there."""
        at = self._slot(h)
        out = np.where((self.key[at] == h) & (self.size[at] >= 0), at, -1)
        lost = np.flatnonzero(out < 0)
        if len(lost):
            other = at[lost] ^ 1
            out[lost] = np.where((self.key[other] == h[lost]) & (self.size[other] >= 0), other, -1)
        return out

    @staticmethod
    def _append(held: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
        if used + len(new) > len(held):
            held = np.concatenate([held[:used], np.empty(max(used + len(new), 2 * len(held)) - used, held.dtype)])
        held[used : used + len(new)] = new
        return held

    def _store(self, h: np.ndarray, buf: np.ndarray, begin: np.ndarray, length: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Takes distinct new units; where their ids begin."""
        start = self.used + np.cumsum(counts) - counts
        self.ids = self._append(self.ids, self.used, flat)
        self.used += len(flat)
        kept = np.flatnonzero(length <= LONGEST)
        length = length[kept]
        text_start = self.text_used + np.cumsum(length) - length
        body = buf[X.ragged(begin[kept], length)]
        self.text = self._append(self.text, self.text_used, body)
        self.text_used += len(body)
        at = self._slot(h[kept])
        other = at ^ 1
        for field in (self.key, self.start, self.size, self.text_start, self.text_size):
            field[other] = field[at]
        # of newcomers to one slot the last stays: written one field after another, so the fields must agree on it
        last = np.zeros(0, np.int64)
        if len(at):
            order = np.argsort(at, kind="stable")
            last = order[np.concatenate([at[order][1:] != at[order][:-1], [True]])]
        self.key[at[last]], self.start[at[last]], self.size[at[last]] = h[kept][last], start[kept][last], counts[kept][last]
        self.text_start[at[last]], self.text_size[at[last]] = text_start[last], length[last]
        return start

    def __call__(self, buf: np.ndarray, begin: np.ndarray, end: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units one after another, how many each has) of the units buf[begin : end]. encode(i) gives (ids, counts) of those numbered i."""
        if self.used > self.limit or self.text_used > 8 * self.limit:
            self._empty()
        h, length = self._hashes(buf, begin, end), end - begin
        at = self._find(h)
        hit = np.flatnonzero(at >= 0)
        same = self.text_size[at[hit]] == length[hit]
        differ = [hit[~same]]
        hit = hit[same]
        differ.append(hit[self._unlike(buf, begin[hit], self.text, self.text_start[at[hit]].astype(np.int64), length[hit])])
        start, size = self.start[at].astype(np.int64), self.size[at].astype(np.int64)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            new, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            head = miss[first][inverse]
            same = length[miss] == length[head]
            differ.append(miss[~same])
            rest = np.flatnonzero(same & (miss != head))
            differ.append(miss[rest][self._unlike(buf, begin[miss[rest]], buf, begin[head[rest]], length[miss[rest]])])
            flat, counts = encode(miss[first])
            begins = self._store(new, buf, begin[miss[first]], length[miss[first]], flat, counts)
            start[miss], size[miss] = begins[inverse], counts[inverse]
        odd, held = np.concatenate(differ), self.ids
        if len(odd):
            flat, counts = encode(odd)
            held = np.concatenate([held[: self.used], flat])
            start[odd], size[odd] = self.used + np.cumsum(counts) - counts, counts
        return held[X.ragged(start, size)], size


#: Units up to so many bytes are hashed and compared as two words.
SHORT = 16
#: What a word keeps of spans of 0 to SHORT bytes.
LOWER_BYTES = np.array([(1 << 8 * min(i, 8)) - 1 for i in range(SHORT + 1)], np.uint64)


def words_at(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the second 8 bytes of short spans as little-endian words, zeros behind their ends. buf holds SHORT bytes more than the spans."""
    at = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    size = np.minimum(size, SHORT)
    one, two, more = at[start] & LOWER_BYTES[size], np.zeros(len(start), np.uint64), np.flatnonzero(size > 8)
    two[more] = at[start[more] + 8] & LOWER_BYTES[size[more] - 8]
    return one, two


class ShortUnitTable(UnitTable):
    """A UnitTable for units that are mostly short: these are hashed and compared as words, longer ones as in UnitTable.

    Buffers that it is called with end in SHORT bytes that belong to no unit.
    """

    def _hashes(self, buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - begin
        one, two = words_at(buf, begin, size)
        h = one * X.U(X.RADIX)
        h ^= h >> X.U(32)
        h = (h + two) * X.U(0xD6E8FEB86659FD93)
        h ^= h >> X.U(29)
        h = (h + size.astype(np.uint64)) * X.U(0xA0761D6478BD642F)
        long = np.flatnonzero(size > SHORT)
        if len(long):
            size = size[long]
            last = np.cumsum(size)
            h[long] = X.exact_hashes(buf[X.ragged(begin[long], size)], last - size, last)
        return h

    def _unlike(self, a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
        (a1, a2), (b1, b2) = words_at(a, a_start, size), words_at(b, b_start, size)
        odd = (a1 != b1) | (a2 != b2)
        long = np.flatnonzero((size > SHORT) & ~odd)
        odd[long[unlike(a, a_start[long], b, b_start[long], size[long])]] = True
        return np.flatnonzero(odd)

    def _store(self, h, buf, begin, length, flat, counts):
        out = super()._store(h, buf, begin, length, flat, counts)
        self.text = self._append(self.text, self.text_used, np.zeros(SHORT, np.uint8))  # words are read beyond the last unit's end
        return out
