"""Queries of the engine by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from motorfisc.plans import corpus_queries, function_queries, more_queries, page_queries, sheet_queries, table_queries, tax_queries

_MODULES = [tax_queries, function_queries, table_queries, sheet_queries, corpus_queries, page_queries, more_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in (m.QUERIES.items() if isinstance(m.QUERIES, dict) else ((f.__name__, f) for f in m.QUERIES))}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
