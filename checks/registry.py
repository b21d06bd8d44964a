"""Every registered query with its oracle. Modules below add to one table."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from logloom.session import tune

MODULES = ["usage", "trace", "jobs", "reports", "corpus", "streams"]

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    """Register fn(spark, sf_dir) under key, with the SQL DuckDB runs beside it."""
    def wrap(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(tune(spark), sf)

        _QUERIES[key] = run
        if oracle is not None:
            _ORACLES[key] = oracle
        return fn
    return wrap


def _load() -> None:
    for name in MODULES:
        import_module(f"checks.queries_{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
