"""All queries of the engine by name, with equivalent SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from certloom.plans import diagnostic_queries, extract_queries, ledger_queries, rule_queries, store_queries, vector_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (rule_queries, extract_queries, vector_queries, store_queries, diagnostic_queries, ledger_queries)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
