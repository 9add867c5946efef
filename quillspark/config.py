"""Settings with their checks: bridge geometry, presets, run modes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latent shapes by preset (fixed values: channels, height, width).
PRESETS = {"sd": (4, 32, 32), "flux": (16, 32, 32)}


@dataclass(frozen=True)
class BridgeGeometry:
    """How rows of tokens fold into a (channels, height, width) tensor by square patches."""

    channels: int
    height: int
    width: int
    patch: int
    tokens: int
    dim: int

    def __post_init__(self):
        if min(self.channels, self.height, self.width, self.patch, self.tokens, self.dim) < 1:
            raise ValueError("sizes must be positive")
        if self.height % self.patch or self.width % self.patch:
            raise ValueError("the patch must divide height and width")
        if self.tokens * self.dim != self.channels * self.height * self.width:
            raise ValueError("tokens and tensor must have equal volume")
        if (self.patch * self.patch * self.channels) % self.dim and self.dim % (self.patch * self.patch * self.channels):
            raise ValueError("tokens must fill whole patches")


def geometry_fits(channels: str, height: str, width: str, patch: str, tokens: str, dim: str) -> Column:
    """Whether sizes in columns make a BridgeGeometry; null sizes don't."""
    c, h, w, p, t, d = map(F.col, (channels, height, width, patch, tokens, dim))
    cell = p * p * c
    positive = F.least(c, h, w, p, t, d) >= 1
    none_null = c.isNotNull() & h.isNotNull() & w.isNotNull() & p.isNotNull() & t.isNotNull() & d.isNotNull()
    rest = lambda a, b: F.try_mod(a, b) == 0
    return F.coalesce(none_null & positive & rest(h, p) & rest(w, p) & (t * d == c * h * w) & (rest(cell, d) | rest(d, cell)), F.lit(False))


def latent_shape(explicit: str | None = None, manifest: dict | None = None) -> tuple[int, int, int]:
    """Preset order: the explicit one, the manifest's bridge preset, its autoencoder's kind, sd."""
    m = manifest or {}
    name = explicit or m.get("bridge_preset") or m.get("vae_kind") or "sd"
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name}")
    return PRESETS[name]


def run_mode(process: str, models: int, text_to_image: bool = True, image_to_text: bool = True) -> str:
    """data2data or noise2data with one shared or two models; two directions need models for both."""
    if process not in ("data2data", "noise2data") or models not in (1, 2):
        raise ValueError("unknown process or number of models")
    if models == 2 and not (text_to_image and image_to_text):
        raise ValueError("two models are one a direction")
    return {"data2data": "d2d", "noise2data": "n2d"}[process] + ("_single" if models == 1 else "_two")
