"""Queries of the engine's own operators with their SQL."""

from __future__ import annotations

from quillspark.plans import etl, ingest, measures, process, samplers, sweeps, vectors  # noqa: F401  they register their queries
from quillspark.plans.base import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
