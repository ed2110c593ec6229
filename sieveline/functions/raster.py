"""Array statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often and wherever the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return let(a, lambda v: total(v) / F.size(v))


def std(a: Column) -> Column:
    """Population deviation from sums and squares around the first value."""

    def body(v):
        first, n = F.get(v, 0), F.size(v)
        return F.aggregate(
            v,
            F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
            lambda acc, x: F.struct(
                (acc["s"] + (x - first)).alias("s"), (acc["q"] + (x - first) * (x - first)).alias("q")
            ),
            lambda acc: F.sqrt(F.greatest(acc["q"] / n - (acc["s"] / n) * (acc["s"] / n), F.lit(0.0))),
        )

    return let(a, body)
