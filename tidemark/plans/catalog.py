"""All queries over the driver's tables by name, each with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.testdata import Market, with_views

FLAGSHIP = "j08_materialization"
MODULES = ("rows", "joined", "grouped", "models", "orders", "details", "upkeep", "scalars", "reports", "history", "formats", "feeds", "known")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a function of a Market under its own name; sql may name the views given."""

    def add(f: Callable[[Market], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Market(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = with_views(sql, *views)
        return f

    return add


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tidemark.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
