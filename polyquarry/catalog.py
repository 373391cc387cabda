"""Registry of the queries outside ``llm``: name -> (function, SQL or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = ("relational", "documents", "geometries", "graphs", "sqltexts", "versions")


def _gather(kind: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"polyquarry.plans.{name}"), kind)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")
