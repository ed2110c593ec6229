"""Checks that fail the job they belong to, as part of its plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guarded(df: DataFrame, checks: list[tuple[DataFrame, Column, str]]) -> DataFrame:
    """Rows of `df`, provided every check holds.

    A check is (frame, aggregate that must be true, message). It runs as a scalar
    subquery of the same job, so nothing is read when the plan is only built.
    """
    for frame, condition, message in checks:
        verdict = frame.agg(condition.alias("ok")).scalar()
        df = df.where(F.assert_true(verdict, message).isNull())
    return df


def holding(df: DataFrame, *rules: tuple[Column, str]) -> DataFrame:
    """Rows of `df`; a row that breaks a rule (condition, message) fails the job. No other pass over the data is needed."""
    for condition, message in rules:
        df = df.where(F.assert_true(F.coalesce(condition, F.lit(False)), message).isNull())
    return df


def by_key(df: DataFrame, key: str, row: str, count: str) -> DataFrame:
    """One row per key: its other columns as the struct `row` (any one of them if they are several) and how many there are."""
    others = [F.col(c) for c in df.columns if c != key] or [F.lit(True).alias("there")]
    return df.groupBy(key).agg(F.first(F.struct(*others)).alias(row), F.count(F.lit(1)).alias(count))


def unique_on(df: DataFrame, *keys: str) -> tuple[DataFrame, Column, str]:
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups, F.coalesce(F.max("n") <= 1, F.lit(True)), f"duplicate keys on {', '.join(keys)}"


def same_labels(joined: DataFrame, left: str, right: str) -> tuple[DataFrame, Column, str]:
    return (
        joined,
        F.count_if(~F.col(left).eqNullSafe(F.col(right))) == 0,
        f"labels disagree: {left} and {right}",
    )


def no_nulls(df: DataFrame, column: str) -> tuple[DataFrame, Column, str]:
    return df, F.count_if(F.col(column).isNull()) == 0, f"missing values in {column}"


def not_empty(df: DataFrame, what: str) -> tuple[DataFrame, Column, str]:
    return df, F.count(F.lit(1)) > 0, f"no rows: {what}"


def both_classes(df: DataFrame, label: str) -> tuple[DataFrame, Column, str]:
    return (
        df,
        (F.count_if(F.col(label) == 0) > 0) & (F.count_if(F.col(label) == 1) > 0),
        "both label classes are needed",
    )
