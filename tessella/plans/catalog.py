"""Query names, their callables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with the DuckDB SQL that gives the same rows."""

    def put(f):
        key = name or f.__name__
        if key in _QUERIES:
            raise ValueError(f"two queries are named {key}")
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return put


def _load() -> None:
    from . import aggregates, edits, library, media, relational, rules, similar  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
