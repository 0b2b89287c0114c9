"""Queries by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import analysis_queries, clone_queries, feature_queries, kept_queries, result_queries, source_queries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (analysis_queries, clone_queries, result_queries, source_queries, feature_queries, kept_queries):
    for _name, (_query, _sql) in _module.QUERIES.items():
        QUERIES[_name] = _query
        if _sql is not None:
            ORACLE_SQL[_name] = _sql
