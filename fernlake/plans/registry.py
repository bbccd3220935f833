"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fernlake.plans import lake_queries, relational

flagship = lake_queries.flagship


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return relational.queries() | lake_queries.queries()


def oracle_sql() -> dict[str, str]:
    return relational.oracle_sql() | lake_queries.oracle_sql()
