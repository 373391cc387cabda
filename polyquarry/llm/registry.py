"""The subpackage's queries and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from importlib import import_module

MODULES = ("sharding", "mixing", "urlfilter", "simhash", "packing", "knn", "langid", "licenses", "lm", "gif")


def _gather(kind: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"polyquarry.llm.{name}"), kind)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")
