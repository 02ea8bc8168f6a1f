"""The registry of the queries over the driver's tables, with an oracle for each where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under ``name``; ``oracle`` is the DuckDB SQL that gives the same rows."""

    def add(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = query
        if oracle:
            _ORACLE[name] = oracle
        return query

    return add


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["dead_reckon_gated_be"](spark, sf_dir)


def queries() -> dict[str, Query]:
    from tidewake.plans import estimate_queries, io_queries, series_queries, stats_queries, systems_queries, text_queries  # noqa: F401  they register themselves

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_ORACLE)
