"""The registered queries of the library's own operators and the SQL that checks them."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with SQL for the same rows where there is any."""

    def register(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    import caseworks.plans as plans

    for m in pkgutil.iter_modules(plans.__path__):
        if m.name.endswith("_queries"):
            importlib.import_module(f"caseworks.plans.{m.name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["flow_review_verdicts"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
