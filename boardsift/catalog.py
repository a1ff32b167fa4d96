"""All queries of the engine, and the SQL that checks them.

A query is registered with the operators of the inventory that it covers.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from boardsift.views import oracle

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(covers: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a function under its own name."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        COVERS[f.__name__] = covers
        if sql:
            _ORACLES[f.__name__] = oracle(sql, *views)
        return f

    return add


def _load() -> None:
    from boardsift.plans import MODULES

    for m in MODULES:
        import_module(f"boardsift.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
