"""The registered queries of the core and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _modules() -> list:
    from wordloom.plans import file_queries, line_queries, model_queries

    return [line_queries, model_queries, file_queries]


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in _modules():
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _modules():
        found |= module.SQL
    return found
