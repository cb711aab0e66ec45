"""Collects queries and their DuckDB twins as they are defined."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        if f.__name__ in QUERIES:
            raise ValueError(f"query {f.__name__} is defined twice")
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
