"""All queries of the library, gathered from the modules in plans/."""

from __future__ import annotations

from .plans import buildings, functions, layers, places, roads, surfaces

_MODULES = (layers, functions, places, buildings, roads, surfaces)


def queries() -> dict:
    return {name: run for m in _MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
