"""Every registered query with, where SQL can express it, the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import audit_queries, filter_queries, join_queries, report_queries, sink_queries, state_queries, summary_queries, text_queries  # noqa: F401  they register themselves
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["p01_filtered_page"](spark, sf_dir)
