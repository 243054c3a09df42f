"""Every query of the engine with its independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query under a name, with the SQL that must give the same rows."""

    def add(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = sql
        return function

    return add


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["route_topk"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL


from lodestone.plans import function_queries  # noqa: E402, F401
from lodestone.plans import ingest_queries  # noqa: E402, F401
from lodestone.plans import relational_queries  # noqa: E402, F401
from lodestone.plans import selection_queries  # noqa: E402, F401
from lodestone.plans import scoring_queries  # noqa: E402, F401
from lodestone.plans import cluster_queries  # noqa: E402, F401
from lodestone.plans import io_queries  # noqa: E402, F401
from lodestone.plans import stream_queries  # noqa: E402, F401
