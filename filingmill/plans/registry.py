"""Queries over the given tables and their plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, where SQL can say the same, its oracle."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


from . import backtests, filings, scores, stored  # noqa: E402, F401  they register their queries
