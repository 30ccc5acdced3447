"""Registers queries under their inventory keys, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, dates: str = ""):
    """Days named in ``dates`` are given as text, on both sides."""

    def register(build: Callable[[Tables], DataFrame]):
        days = dates.split()
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder)).withColumns({c: F.col(c).cast("string") for c in days})
        if sql:
            whole = with_views(sql)
            ORACLE_SQL[name] = f"select * replace ({', '.join(f'{c}::varchar as {c}' for c in days)}) from ({whole})" if days else whole
        return build

    return register
