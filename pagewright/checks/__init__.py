"""Every operator run over the registered tables, with an independent DuckDB query beside it."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES

MODULES = ("retrieval", "answers", "catalog", "store", "boxes", "raster", "regions", "keying", "gates", "corpora", "copies", "logs", "streams")


def load() -> tuple[dict, dict]:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return QUERIES, ORACLES
