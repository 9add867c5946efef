"""Vector columns (array<double>): higher-order functions only, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: what a lambda captures is evaluated again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def dist(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def scale(v: Column, s) -> Column:
    return F.transform(v, lambda x: x * s)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def axpy(s, a: Column, t, b: Column) -> Column:
    """s a + t b."""
    return F.zip_with(a, b, lambda x, y: x * s + y * t)


def normalise(v: Column, eps: float = 1e-12) -> Column:
    """v / (|v| + eps), the reader's convention."""
    return let(norm(v) + F.lit(eps), lambda n: F.transform(v, lambda x: x / n))


def normalise_clamped(v: Column, eps: float = 1e-12) -> Column:
    """v / max(|v|, eps), the losses' convention."""
    return let(F.greatest(norm(v), F.lit(eps)), lambda n: F.transform(v, lambda x: x / n))


def truncate(v: Column, d: int) -> Column:
    """The first d components, normalised again."""
    return normalise(F.slice(v, 1, d))


def posterior(mean: Column, logvar: Column, noise: Column) -> Column:
    """A draw: mean + exp(logvar / 2) noise."""
    return F.transform(F.arrays_zip(mean.alias("m"), logvar.alias("l"), noise.alias("g")), lambda z: z["m"] + F.exp(F.lit(0.5) * z["l"]) * z["g"])


def finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def slerp(a: Column, b: Column, s) -> Column:
    """Spherical interpolation of unit vectors; a where they are (anti)parallel."""
    s = F.lit(s) if not isinstance(s, Column) else s

    def weights(omega: Column) -> Column:
        flat = F.abs(F.sin(omega)) < F.lit(1e-6)
        wa = F.when(flat, F.lit(1.0)).otherwise(F.sin((F.lit(1.0) - s) * omega) / F.sin(omega))
        wb = F.when(flat, F.lit(0.0)).otherwise(F.sin(s * omega) / F.sin(omega))
        return F.struct(wa.alias("a"), wb.alias("b"))

    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))
    return let(let(angle, weights), lambda w: axpy(w["a"], a, w["b"], b))


def packed(v: Column, channels: int, height: int, width: int, patch: int) -> Column:
    """Rows of tokens to a (channels, height, width) tensor: an index permutation."""
    n, p = channels * height * width, patch

    def source(o: Column) -> Column:
        c, y, x = F.floor(o / (height * width)), F.floor(F.pmod(o, F.lit(height * width)) / width), F.pmod(o, F.lit(width))
        return (F.floor(y / p) * (width // p) + F.floor(x / p)) * (p * p * channels) + (F.pmod(y, F.lit(p)) * p + F.pmod(x, F.lit(p))) * channels + c

    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")), lambda o: F.get(v, source(o).cast("int")))


def unpacked(v: Column, channels: int, height: int, width: int, patch: int) -> Column:
    """The inverse permutation."""
    n, p = channels * height * width, patch

    def source(t: Column) -> Column:
        token, inside = F.floor(t / (p * p * channels)), F.pmod(t, F.lit(p * p * channels))
        y = F.floor(token / (width // p)) * p + F.floor(F.floor(inside / channels) / p)
        x = F.pmod(token, F.lit(width // p)) * p + F.pmod(F.floor(inside / channels), F.lit(p))
        return F.pmod(inside, F.lit(channels)) * (height * width) + y * width + x

    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")), lambda t: F.get(v, source(t).cast("int")))


def patch_positions(tokens: int, patches: int, layout: str = "row_major") -> Column:
    """Patches that each token owns, in order; row_major is the only layout."""
    if layout != "row_major":
        raise ValueError(f"unknown token layout {layout}")
    return F.transform(F.sequence(F.lit(0), F.lit(tokens - 1)), lambda t: F.sequence(t * patches, t * patches + (patches - 1)))


def token_norms(v: Column, dim: int, unit_scale: float = 1.0) -> Column:
    """Norm of each dim-sized token of a flat vector, after division by unit_scale."""
    count = F.floor(F.size(v) / dim).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: norm(F.slice(v, i * dim + 1, dim)) / unit_scale)


def first_true(flags: Column) -> Column:
    """Position of the first true, or the length."""
    at = F.array_position(flags, True).cast("bigint") - 1
    return F.when(at < 0, F.size(flags).cast("bigint")).otherwise(at)


def pad_id_stop(ids: Column, pad: int) -> Column:
    """Position of the first pad id, or the length."""
    return first_true(F.transform(ids, lambda x: x == pad))


def argmax(v: Column) -> Column:
    return F.array_position(v, F.array_max(v)) - 1
