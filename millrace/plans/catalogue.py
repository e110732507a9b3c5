"""Every registered query with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return add


def _load_all() -> None:
    from . import extra, learn, more, relational, scalar, tpch  # noqa: F401


def queries() -> dict[str, Query]:
    _load_all()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load_all()
    return _ORACLES
