"""Vectorised text kernels: words, units and hashes over blocks of UTF-8 bytes.

`exact_hashes` is polynomial modulo the prime 2^61-1 and fit for strings of any length. `prefix` and `span_hashes` work
modulo 2^64, where some strings of 1024 bytes and more have equal hashes whatever the radix: they are for grams and
segments below that length, and for features of a model.
"""

from __future__ import annotations

import functools

import numpy as np

U = np.uint64
#: Odd multiplier of the polynomial hash; the rest is derived from it.
RADIX = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (two rounds of multiply and fold)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(RADIX))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


@functools.lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def chain(r: int) -> np.ndarray:
        out = np.ones(size, np.uint64)
        done, step = 1, r
        while done < size:  # doubling: out[done:2 done] = out[:done] * r^done
            more = min(done, size - done)
            out[done : done + more] = out[:more] * U(step)
            step, done = step * step & MASK, done + more
        return out

    return chain(RADIX), chain(pow(RADIX, -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^i and r^-i modulo 2^64 for i up to n."""
    return _powers(max(1 << 20, 1 << int(n).bit_length()))


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash; n+1 values."""
    out = np.empty(len(buf) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE[buf] * powers(len(buf) + 1)[0][: len(buf)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end)."""
    raw = (sums[end] - sums[start]) * powers(len(sums))[1][start]
    return mix(raw + (end - start).astype(np.uint64) * U(0xA0761D6478BD642F))


#: The modulus of exact_hashes, a prime; and the longest span whose sums don't overflow.
PRIME, LONG = U((1 << 61) - 1), 1 << 22


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> U(61))
    return np.where(x >= PRIME, x - PRIME, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, by halves of 31 bits."""
    low = U((1 << 31) - 1)
    ah, al, bh, bl = a >> U(31), a & low, b >> U(31), b & low
    middle = ah * bl + al * bh
    return _reduce(_reduce(ah * bh * U(2) + (middle >> U(30)) + ((middle & U((1 << 30) - 1)) << U(31))) + _reduce(al * bl))


@functools.lru_cache(1)
def _prime_powers(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper and lower 31 bits of r^i, and r^-i, modulo the prime."""
    p = int(PRIME)

    def chain(r: int) -> np.ndarray:
        out = np.ones(size, np.uint64)
        done, step = 1, r
        while done < size:
            more = min(done, size - done)
            out[done : done + more] = _times(out[:more], np.full(1, step, np.uint64))
            step, done = step * step % p, done + more
        return out

    up = chain(RADIX % p)
    return up >> U(31), up & U((1 << 31) - 1), chain(pow(RADIX % p, -1, p))


def exact_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end), polynomial modulo 2^61-1, mixed with the length."""
    high, low, back = _prime_powers(max(1 << 20, 1 << int(len(buf) + 1).bit_length()))
    value = buf.astype(np.uint64) + U(1)
    tops, bottoms = np.zeros(len(buf) + 1, np.uint64), np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(value * high[: len(buf)], out=tops[1:])
    np.cumsum(value * low[: len(buf)], out=bottoms[1:])

    def sums(a, b):
        top = _reduce(tops[b] - tops[a])  # exact: differences of sums that may have wrapped
        return _reduce(((top & U((1 << 30) - 1)) << U(31)) + (top >> U(30)) + _reduce(bottoms[b] - bottoms[a]))

    raw = sums(start, np.minimum(end, start + LONG))
    for i in np.flatnonzero(end - start > LONG).tolist():
        for a in range(int(start[i]) + LONG, int(end[i]), LONG):
            raw[i] = _reduce(raw[i : i + 1] + sums(np.array([a]), np.array([min(a + LONG, int(end[i]))])))[0]
    return mix(_times(raw, back[start]) + (end - start).astype(np.uint64) * U(0xA0761D6478BD642F))


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document index of the words [^\\x20\\x09-\\x0D]+; words never cross documents."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~SPACE[buf]
    first = np.zeros(n + 1, bool)
    first[off] = True
    begin = solid & first[:-1]
    begin[1:] |= solid[1:] & ~solid[:-1]
    stop = solid & first[1:]
    stop[-1] |= solid[-1]
    stop[:-1] |= solid[:-1] & ~solid[1:]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(stop) + 1, np.searchsorted(off, start, side="right") - 1


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z lower-cased, and each document's number of words."""
    low = LOWER[buf]
    start, end, doc = words(low, off)
    return exact_hashes(low, start, end), np.bincount(doc, minlength=len(off) - 1)


def chain_hash(parts: list[np.ndarray]) -> np.ndarray:
    """Order-sensitive hash of equally long columns of hashes."""
    out = parts[0]
    for p in parts[1:]:
        out = mix(out * U(RADIX) + p)
    return mix(out + U(len(parts)))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, ... for counts[i] of each i, one after another."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(total, dtype=np.int64) + shift
