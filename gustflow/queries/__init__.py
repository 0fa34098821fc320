"""Registered queries: each applies operators to the star-schema tables, with its DuckDB equivalent."""

from __future__ import annotations

from importlib import import_module

MODULES = ("aggregates", "windows", "relations", "spatial", "inference", "learning", "study", "reports")


def registered() -> tuple[dict, dict]:
    """All queries by name, and the SQL of those that have one."""
    queries, sql = {}, {}
    for name in MODULES:
        found = import_module(f".{name}", __name__).REGISTRY
        for key, (query, text) in found.items():
            if key in queries:
                raise ValueError(f"two queries are named {key}")
            queries[key] = query
            if text:
                sql[key] = text
    return queries, sql
