"""Named queries over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sourcegrain.plans import record_queries, table_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return table_queries.QUERIES | record_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return table_queries.SQL | record_queries.SQL
