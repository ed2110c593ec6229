"""Query registry: one entry per operator, with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.suite.views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
SHARED: dict[str, str] = {}
"""Intermediate results that several check queries start from, by name."""


def settled(df: DataFrame) -> DataFrame:
    """Floats to 9 digits: sums depend on task order beyond that."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.round(column.cast("double"), 9).alias(field.name)
        out.append(column)
    return df.select(out)


def case(name: str, check: str | None = None):
    """Register `fn(tables) -> DataFrame` as query `name`."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: settled(fn(Tables(spark, sf_dir)))
        if check is not None:
            CHECKS[name] = check
        return fn

    return register


def check_sql() -> dict[str, str]:
    return {name: with_views(sql, SHARED) for name, sql in CHECKS.items()}
