"""Queries over the test tables by name, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with equivalent DuckDB SQL if there is any."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is there already")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    from brindle.plans import queries  # noqa: F401  (registers on import)


def queries() -> dict[str, Query]:
    """Every query outside the optional subpackages."""
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    _load()
    return dict(_SQL)
