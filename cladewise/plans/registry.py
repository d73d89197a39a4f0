"""Name -> (DataFrame query, equivalent SQL); the plan modules fill it on import."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under `name`; `oracle` is SQL that DuckDB can run on the same tables."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return add


def _load() -> None:
    from importlib import import_module

    for name in MODULES:
        import_module(f"cladewise.plans.{name}")


MODULES = ["likelihoods", "trees", "splits", "states", "texts", "growth"]


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracles() -> dict[str, str]:
    _load()
    return _ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["l13_tree_loglik"](spark, sf_dir)
