"""Registered queries: every operator applied to the driver's tables."""

from __future__ import annotations

from importlib import import_module

from .base import ORACLES, QUERIES

MODULES = (
    "ingest", "sinks", "rules", "lookups", "spatial", "raster", "weather", "tail", "scores",
    "distributions", "rating", "reports", "streams",
)


def load() -> tuple[dict, dict]:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return QUERIES, ORACLES
