"""Verification queries over the supplied tables, grouped by area."""

from __future__ import annotations

import importlib

AREAS = ("q_search", "q_compile", "q_graph", "q_serving", "q_quality", "q_catalog", "q_eval", "q_sources")


def _registries():
    return [importlib.import_module(f"{__name__}.{area}").R for area in AREAS]


def all_queries():
    merged = {}
    for r in _registries():
        for name, fn in r.builders.items():
            if name in merged:
                raise ValueError(f"duplicate query {name}")
            merged[name] = fn
    return merged


def all_sql():
    return {name: sql for r in _registries() for name, sql in r.sql.items()}
