"""A module's queries and their SQL."""

from __future__ import annotations


def registry():
    """``QUERIES``, ``ORACLES`` and the decorator ``query(name, sql)`` that fills them."""
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(name: str, sql: str | None = None):
        def register(function):
            queries[name] = function
            if sql:
                oracles[name] = sql
            return function

        return register

    return queries, oracles, query
