"""All queries of the library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import audit_queries, base_queries, field_queries, file_queries, geometry_queries, grid_queries, report_queries, shape_queries, table_queries
from .plans.base_queries import flagship
from .queries import QUERIES, SQL

__all__ = ["audit_queries", "base_queries", "field_queries", "file_queries", "geometry_queries", "grid_queries", "report_queries", "shape_queries", "table_queries", "flagship", "oracle_sql", "queries"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
