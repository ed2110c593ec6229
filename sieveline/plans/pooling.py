"""Monotone pooling of a score order, as lower hulls that merge.

Pooling adjacent violators finds the slopes of the lower convex hull of the running
counts (neg, pos). A hull keeps few of its points (of n rows at most about
n^(2/3), as they are whole numbers), and the hull of several stretches is the hull
of their hulls. So every bucket is reduced where it lies, stretches of buckets are
merged next, and one step per group ends it. Counts stay whole numbers: pools are
exact, and the same for any weights of the two labels.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sieveline.plans.ordered import running_sums, with_bucket

SPAN = 64
"""Buckets merged at once; the square of it covers the most buckets an order has."""


def lower_hull(points: Sequence[tuple[int, int]]) -> list[int]:
    """Places of the corners of the lower hull of (neg, pos) points given in running order."""
    kept: list[int] = []
    for i, (x, y) in enumerate(points):
        while len(kept) > 1:
            (ax, ay), (bx, by) = points[kept[-2]], points[kept[-1]]
            if (bx - ax) * (y - by) > (x - bx) * (by - ay):  # the share of positives rises here
                break
            kept.pop()
        kept.append(i)
    return kept


def _step(df: DataFrame, keys: list[str], group: Sequence[str], work: Callable, fields: str) -> DataFrame:
    """Run `work(table sorted by score) -> columns` per group; the group's columns go along."""
    schema = T.StructType([df.schema[k] for k in keys])
    for field in fields.split(", "):
        schema = schema.add(*field.split())

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("score")
        columns = work(table.to_pydict())
        n = len(next(iter(columns.values())))
        same = [pa.chunked_array([pa.repeat(table.column(k)[0], n)]) for k in keys]
        made = [pa.array(columns[f.name], f.type) for f in list(kinds)[len(keys) :]]
        return pa.table([*same, *made], schema=kinds)

    kinds = to_arrow_schema(schema)
    return df.groupBy(*group).applyInArrow(run, schema)


def _corners(rows: dict[str, list]) -> dict[str, list]:
    at = lower_hull(list(zip(rows["neg_upto"], rows["pos_upto"])))
    return {c: [rows[c][i] for i in at] for c in ("bucket", "score", "after", "first", "neg_upto", "pos_upto")}


def _of_bucket(rows: dict[str, list]) -> dict[str, list]:
    rows["after"] = [*rows["score"][1:], None]
    rows["first"] = [rows["score"][0]] * len(rows["score"])
    return _corners(rows)


def _joined(rows: dict[str, list]) -> dict[str, list]:
    """The last row of a stretch is followed by the first score of the next stretch."""
    following = [*rows["first"][1:], None]
    rows["after"] = [f if a is None else a for a, f in zip(rows["after"], following)]
    rows["first"] = [rows["first"][0]] * len(rows["first"])
    return rows


def _pools(rows: dict[str, list]) -> dict[str, list]:
    rows = _joined(rows)
    neg, pos = [0, *rows["neg_upto"]], [0, *rows["pos_upto"]]
    high, after = [None, *rows["score"]], [rows["first"][0], *rows["after"]]
    at = lower_hull(list(zip(neg, pos)))
    pairs = list(zip(at, at[1:]))
    return {
        "pool": list(range(len(pairs))),
        "low": [after[a] for a, _ in pairs],
        "high": [high[b] for _, b in pairs],
        "neg": [neg[b] - neg[a] for a, b in pairs],
        "pos": [pos[b] - pos[a] for a, b in pairs],
    }


_CORNER = "bucket integer, score double, after double, first double, neg_upto long, pos_upto long"


def monotone_pools(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pools of a histogram `(keys, score, pos, neg)`: `keys, pool, low, high, neg, pos`.

    From pool to pool the share of positives rises strictly; `low` and `high` are
    scores that occur.
    """
    keys = list(keys)
    upto = running_sums(counts, keys, "score", ["pos", "neg"]).select(
        *keys,
        F.col("bucket").cast("int").alias("bucket"),
        "score",
        (F.col("neg_below") + F.col("neg")).alias("neg_upto"),
        (F.col("pos_below") + F.col("pos")).alias("pos_upto"),
    )
    corners = _step(upto, keys, [*keys, "bucket"], _of_bucket, _CORNER)
    span = F.floor(F.col("bucket") / SPAN)
    corners = _step(corners, keys, [*keys, span], lambda rows: _corners(_joined(rows)), _CORNER)
    return _step(corners, keys, keys or [F.lit("all")], _pools, "pool long, low double, high double, neg long, pos long")


def surrounding(rows: DataFrame, edges: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Add `before` and `after` to every row: the edges next to `value` at either side, or at it; null where none.

    `edges` has the keys, a double `x` and others; an edge is the struct of all but the
    keys. Both tables are cut into the same buckets, so no key is one task's work.
    """
    keys = list(keys)
    own = rows.withColumn("_x", F.col(value).cast("double")).withColumn("_edge", F.lit(None))
    parts = [c for c in edges.columns if c not in keys and c != "x"]
    marks = edges.select(*keys, F.col("x").alias("_x"), F.struct("x", *parts).alias("_edge"))
    both = with_bucket(own.drop("_edge").unionByName(marks, allowMissingColumns=True), F.col("_x"))
    low, high = F.min("_edge"), F.max("_edge")
    ends = both.groupBy(*keys, "bucket").agg(low.alias("_low"), high.alias("_high"))
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("bucket").alias("_bucket"),
        F.max("_high").over(earlier).alias("_before"),
        F.min("_low").over(later).alias("_after"),
    )
    on = F.col("bucket") == F.col("_bucket")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = both.join(ends, on).drop("_bucket", *[f"_k_{k}" for k in keys])
    here = Window.partitionBy(*keys, "bucket")
    up = here.orderBy("_x").rangeBetween(Window.unboundedPreceding, 0)
    down = here.orderBy(F.desc("_x")).rangeBetween(Window.unboundedPreceding, 0)
    out = joined.withColumns({"before": F.coalesce(high.over(up), "_before"), "after": F.coalesce(low.over(down), "_after")})
    return out.where(F.col("_edge").isNull()).drop("_x", "_edge", "_before", "_after", "bucket")
