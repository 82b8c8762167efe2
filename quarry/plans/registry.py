"""Every query of the engine by name, with SQL that gives the same rows elsewhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import function_queries, more_queries, operator_queries, source_queries, sql_queries, tpch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _m in (tpch, operator_queries, function_queries, source_queries, sql_queries, more_queries):
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.ORACLE_SQL
