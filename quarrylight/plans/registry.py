"""Queries that stand beside their SQL: a function with the decorator is registered under its name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Query = Callable[..., DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with the DuckDB SQL that gives the same rows if there is any."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register
