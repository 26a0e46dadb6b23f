"""All core queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import curation_queries, skew_queries, trace_queries

_MODULES = [curation_queries, skew_queries, trace_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _MODULES for name, q in m.SQL.items()}


def entry(spark: SparkSession, folder: str) -> DataFrame:
    return curation_queries.whole_decontaminated_split(spark, folder)
