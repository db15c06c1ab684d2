"""All queries of the core by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import evaluation_queries, gate_queries, quality_queries, report_queries, search_queries, source_queries, structure, text_queries

Query = Callable[[SparkSession, str], DataFrame]
#: Modules with QUERIES: name -> (query, SQL or None).
MODULES = (structure, text_queries, search_queries, quality_queries, evaluation_queries, source_queries, report_queries, gate_queries)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, (query, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
