"""Deterministic randomness: every draw is a function of md5(seed:stream:key[:i]), so plans can be recomputed anywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int, stream: str, *keys) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(stream), *[k.cast("string") if isinstance(k, Column) else F.col(k).cast("string") for k in keys]))


def unit(h: Column, part: int = 0) -> Column:
    """Uniform in (0, 1) from the part-th 32 bits of a digest."""
    return (F.conv(F.substring(h, 1 + 8 * part, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def gauss(h: Column) -> Column:
    """Standard normal by Box and Muller."""
    return F.sqrt(F.lit(-2.0) * F.log(unit(h, 0))) * F.cos(F.lit(6.283185307179586) * unit(h, 1))


def below(h: Column, n: Column) -> Column:
    """Whole number in [0, n)."""
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), n)


#: Rounds of a permutation; turns that a walk may take outside the range before it is an error.
ROUNDS, TURNS = 6, 64


def permuted(seed: int, stream: str, key: Column, k: Column, n: Column) -> Column:
    """The place of k in a keyed permutation of [0, n): distinct for distinct k below n, drawn evenly.

    A Feistel network over the pairs (x, y) of [0, a) x [0, b), a = ceil(sqrt(n)), b = ceil(n/a): its rounds add a hash of
    one half to the other. Of the a*b pairs fewer than a lie outside the range; such a place goes through the
    network again until it is inside, so walks are short, and one of more than TURNS turns raises. n up to 2^31.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("bigint")
    start = F.struct(k.cast("bigint").alias("at"), a.alias("a"), F.ceil(n / a).cast("bigint").alias("b"), n.cast("bigint").alias("n"), key.cast("string").alias("key"))

    def turn(p: Column) -> Column:
        x, y = F.floor(p["at"] / p["b"]).cast("bigint"), F.pmod(p["at"], p["b"])
        half = F.struct(x.alias("x"), y.alias("y"))

        def step(h: Column, r: Column) -> Column:
            even = F.pmod(r, F.lit(2)) == 0
            known, side = F.when(even, h["x"]).otherwise(h["y"]), F.when(even, p["b"]).otherwise(p["a"])
            moved = F.pmod(F.when(even, h["y"]).otherwise(h["x"]) + below(digest(seed, stream, p["key"], r, known), side), side)
            return F.struct(F.when(even, h["x"]).otherwise(moved).alias("x"), F.when(even, moved).otherwise(h["y"]).alias("y"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), half, step, lambda h: h["x"] * p["b"] + h["y"])

    def walk(p: Column, i: Column) -> Column:
        at = F.when((i == 0) | (p["at"] >= p["n"]), turn(p)).otherwise(p["at"])
        return F.struct(at.alias("at"), p["a"].alias("a"), p["b"].alias("b"), p["n"].alias("n"), p["key"].alias("key"))

    inside = F.aggregate(F.sequence(F.lit(0), F.lit(TURNS)), start, walk, lambda p: F.when(p["at"] < p["n"], p["at"]))
    return F.coalesce(inside, F.raise_error(F.lit("a walk of the permutation is too long")).cast("bigint"))
