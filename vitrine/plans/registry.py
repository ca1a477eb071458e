"""All registered queries and their DuckDB oracles, gathered by area."""

from __future__ import annotations

import importlib

_MODULES = [
    "vitrine.plans.catalog_queries",
    "vitrine.plans.scalar_queries",
    "vitrine.plans.page_queries",
    "vitrine.plans.search_queries",
    "vitrine.plans.stream_queries",
    "vitrine.plans.job_queries",
    "vitrine.plans.branch_queries",
]


def _load():
    mods = []
    for name in _MODULES:
        try:
            mods.append(importlib.import_module(name))
        except ModuleNotFoundError as e:  # an area not built yet
            if e.name != name:
                raise
    return mods


def queries():
    out = {}
    for m in _load():
        out.update(m.QUERIES)
    return out


def oracle_sql():
    out = {}
    for m in _load():
        out.update(m.ORACLES)
    return out
