"""Closed forms of the bridge processes as column expressions: volatility, transition and covariance, scores, EDM and VP."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


class Process:
    """sigma(t), phi(start, end) and covariance(start, a, b) of a base process with linear drift -drift * x."""

    drift = 0.0

    def phi(self, start, end) -> Column:
        return F.lit(1.0)

    def energy(self, u) -> Column:
        """Integral of sigma squared from 0 to u."""
        raise NotImplementedError

    def cov(self, start, a, b) -> Column:
        return self.energy(F.least(col(a), col(b))) - self.energy(start)


@dataclass(frozen=True)
class Uniform(Process):
    k: float = 0.5
    drift: float = 0.0

    def sigma(self, t) -> Column:
        return F.lit(self.k) + col(t) * 0

    def phi(self, start, end) -> Column:
        return F.exp(F.lit(-self.drift) * (col(end) - col(start)))

    def cov(self, start, a, b) -> Column:
        low, k2 = F.least(col(a), col(b)), self.k * self.k
        if self.drift == 0:
            return F.lit(k2) * (low - col(start))
        d = self.drift
        return F.lit(k2) * F.exp(F.lit(-d) * (col(a) + col(b))) * (F.exp(F.lit(2 * d) * low) - F.exp(F.lit(2 * d) * col(start))) / F.lit(2 * d)


@dataclass(frozen=True)
class Periodic(Process):
    alpha: float = 0.95
    cycles: float = 1.0
    eps: float = 0.05
    shift: float = 0.0

    def sigma(self, t) -> Column:
        return F.lit(self.alpha / 2) * (F.lit(1.0) - F.cos(F.lit(2 * math.pi * self.cycles) * (col(t) + F.lit(self.shift)))) + F.lit(self.eps)

    def energy(self, u) -> Column:
        a, e, w = self.alpha, self.eps, 2 * math.pi * self.cycles
        u = col(u) + F.lit(self.shift)
        return F.lit(3 * a * a / 8 + a * e + e * e) * u - F.lit(a * (a + 2 * e) / (2 * w)) * F.sin(F.lit(w) * u) + F.lit(a * a / (16 * w)) * F.sin(F.lit(2 * w) * u)


def cosine_decaying(alpha: float = 0.95, eps: float = 0.05) -> Periodic:
    """Half a cycle, evaluated at t - 1."""
    return Periodic(alpha, 0.5, eps, -1.0)


@dataclass(frozen=True)
class CosineDecay(Process):
    """The single-cell parametrisation: sigma falls from k to eps."""

    k: float = 0.5
    eps: float = 0.03

    def __post_init__(self):
        if self.k <= 0 or self.eps < 0:
            raise ValueError("k must be positive and eps not negative")

    def sigma(self, t) -> Column:
        return F.lit(self.eps) + F.lit(0.5 * (self.k - self.eps)) * (F.lit(1.0) + F.cos(F.lit(math.pi) * col(t)))

    def energy(self, u) -> Column:
        c, d = 0.5 * (self.k + self.eps), 0.5 * (self.k - self.eps)
        u = col(u)
        return F.lit(c * c + 0.5 * d * d) * u + F.lit(2 * c * d / math.pi) * F.sin(F.lit(math.pi) * u) + F.lit(d * d / (4 * math.pi)) * F.sin(F.lit(2 * math.pi) * u)


def conditional(p: Process, tp, t, tn) -> tuple[Column, Column, Column]:
    """(weight of x_prev, weight of x_next, variance) of the bridge pinned at tp and tn."""
    gain = p.cov(tp, t, tn) / p.cov(tp, tn, tn)
    return p.phi(tp, t) - gain * p.phi(tp, tn), gain, p.cov(tp, t, t) - p.cov(tp, t, tn) * gain


def interpolant(x0: Column, x1: Column, t) -> Column:
    """Straight line between vectors."""
    return F.zip_with(x0, x1, lambda a, b: (F.lit(1.0) - col(t)) * a + col(t) * b)


def forward_score(p: Process, x: Column, x_next: Column, t, tn) -> Column:
    """Of one component."""
    f = p.phi(t, tn)
    return f / p.cov(t, tn, tn) * (x_next - f * x)


def reverse_score(p: Process, x: Column, x_start: Column, t) -> Column:
    return F.lit(-1.0) / p.cov(0.0, t, t) * (x - p.phi(0.0, t) * x_start)


def dsm_weight(p: Process, t, forward: bool) -> Column:
    return p.cov(t, 1.0, 1.0) / p.phi(t, 1.0) if forward else p.cov(0.0, t, t)


def vp(t) -> tuple[Column, Column]:
    """(alpha, sigma) of the noise-to-data interpolation."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(0.999), col(t)))
    return F.sqrt(F.greatest(F.lit(1.0) - s * s, F.lit(1e-6))), s


def edm(p: Process, t, s0: float = 1.0, s1: float = 1.0, s01: float = 0.0, forward: bool = True) -> dict[str, Column]:
    """Input, skip and output coefficients of the preconditioned score; the process must have no drift."""
    if p.drift:
        raise ValueError("preconditioning needs a process without drift")
    c0t, ct1, c01 = p.cov(0.0, t, t), p.cov(t, 1.0, 1.0), p.cov(0.0, 1.0, 1.0)
    a, b, c = c0t / c01, ct1 / c01, c0t * ct1 / c01
    var = b * b * F.lit(s0) + a * a * F.lit(s1) + F.lit(2.0) * a * b * F.lit(s01) + c
    if forward:
        skip = (a * F.lit(s1) + b * F.lit(s01)) / var
        out = F.sqrt(F.greatest(F.lit(s1) - skip * skip * var, F.lit(0.0)))
        denom = ct1
    else:
        skip = (b * F.lit(s0) + a * F.lit(s01)) / var
        out = F.sqrt(F.greatest(F.lit(s0) - skip * skip * var, F.lit(0.0)))
        denom = c0t
    return {"c_in": F.lit(1.0) / F.sqrt(var), "c_skip": skip, "c_out": out, "denom": denom}


def repa_weights(t, mode: str) -> tuple[Column, Column]:
    """(text, image) weights of the alignment losses by phase."""
    t = col(t)
    if mode == "equal":
        return F.lit(0.5) + t * 0, F.lit(0.5) + t * 0
    if mode == "image_up":
        return F.lit(1.0) - t, t
    if mode == "text_up":
        return t, F.lit(1.0) - t
    raise ValueError(f"unknown mode {mode}")


def guided(conditional_value: Column, unconditional: Column, s: float) -> Column:
    """Away from the unconditional value by s times the difference; s = 0 keeps the conditional one."""
    return conditional_value + F.lit(s) * (conditional_value - unconditional)


def nfe(base: int, fraction) -> Column:
    """Steps for a fraction of the way: at least 1, halves to even."""
    return F.greatest(F.lit(1), F.bround(F.lit(float(base)) * col(fraction), 0).cast("int"))
