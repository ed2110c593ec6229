"""Ordered work without a single-task window.

A window over a whole table, or over one huge group, runs in one task. The
functions here cut the order into value buckets first. Bucket limits are
approximate quantiles of the data (a fixed number of doubles, read back as a
scalar subquery), so buckets stay balanced for any score distribution. Counts
per bucket are small; their running sums give each bucket its offset, and the
only full-size window runs inside `(keys, bucket)`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.session import shuffle_partitions

MAX_BUCKETS = 4096


def bucket_total(df: DataFrame) -> int:
    """Buckets per order: eight per shuffle partition, a power of two, bounded."""
    wanted = 8 * shuffle_partitions(df.sparkSession)
    return min(MAX_BUCKETS, max(64, 1 << (wanted - 1).bit_length()))


def with_bucket(
    df: DataFrame, value: Column, tie: Column | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Add `bucket`, non-decreasing in `value`.

    `keep` names columns the limits' own scan must not prune, so that it reads the
    very exchange the main plan reads.

    A value that owns several quantile limits holds a large share of the rows.
    When `tie` (a number in [0, 1), increasing in the tie order) is given, such
    a value is spread over as many buckets as it owns limits.
    """
    total = bucket_total(df)
    points = [i / total for i in range(1, total)]
    source = df
    for name in keep:
        source = source.where(F.col(name) >= 0)
    limits = (
        source.select(value.cast("double").alias("v"))
        .agg(F.percentile_approx("v", points, 8 * total).alias("limits"))
        .scalar()
    )
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(total.bit_length() - 1))])

    def position(passes):
        return F.aggregate(
            steps,
            F.lit(0),
            lambda at, step: at + F.when(passes(F.get(F.col("_limits"), at + step - 1)), step).otherwise(0),
        )

    out = df.withColumn("_limits", limits).withColumn("_value", value.cast("double"))
    if tie is None:
        return out.withColumn("bucket", position(lambda limit: limit <= F.col("_value"))).drop("_limits", "_value")
    out = out.withColumn("_lower", position(lambda limit: limit < F.col("_value")))
    # only a value that is itself a limit can own several
    upper = F.when(
        F.get("_limits", F.col("_lower")) == F.col("_value"), position(lambda limit: limit <= F.col("_value"))
    ).otherwise(F.col("_lower"))
    out = out.withColumn("_upper", upper)
    owned = F.col("_upper") - F.col("_lower")
    spread = F.col("_lower") + F.floor(tie * owned).cast("int")
    return out.withColumn("bucket", F.when(owned > 1, spread).otherwise(F.col("_upper"))).drop(
        "_limits", "_value", "_upper", "_lower"
    )


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: Sequence[str],
) -> DataFrame:
    """For rows that are distinct in `(keys, value)` add, per column in `sums`,
    `<c>_below` (sum over smaller values of the same keys) and `<c>_all`."""
    keys = list(keys)
    rows = with_bucket(df, F.col(value), keep=sums)
    per_bucket = rows.groupBy(*keys, "bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = per_bucket.select(
        *keys,
        "bucket",
        *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums],
        *[F.sum(f"_t_{c}").over(whole).alias(f"{c}_all") for c in sums],
    )
    inside = (
        Window.partitionBy(*keys, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = _join_offsets(rows, offsets, [*keys, "bucket"])
    return joined.select(
        "*",
        *[
            (F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_below")
            for c in sums
        ],
    ).drop(*[f"_o_{c}" for c in sums])


def _join_offsets(rows: DataFrame, offsets: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join on the bucket keys, keeping the left names."""
    if not on:
        return rows.withColumn("_one", offsets.select(F.struct("*")).scalar()).select("*", "_one.*").drop("_one")
    right = offsets
    condition = F.lit(True)
    for name in on:
        right = right.withColumnRenamed(name, f"_k_{name}")
        condition = condition & F.col(name).eqNullSafe(F.col(f"_k_{name}"))
    return rows.join(right, condition, how).drop(*[f"_k_{name}" for name in on])


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    before: dict[str, str] | None = None,
    after: dict[str, str] | None = None,
) -> DataFrame:
    """Add the previous / next row's column in `value` order; `df` carries `bucket`.

    `before` and `after` map a new column name to the source column. Bucket edges
    are filled from the nearest non-empty bucket.
    """
    keys, before, after = list(keys), before or {}, after or {}
    per_bucket = df.groupBy(*keys, "bucket").agg(
        *[F.max_by(src, value).alias(f"_b_{new}") for new, src in before.items()],
        *[F.min_by(src, value).alias(f"_a_{new}") for new, src in after.items()],
    )
    order = Window.partitionBy(*keys).orderBy("bucket")
    edges = per_bucket.select(
        *keys,
        "bucket",
        *[F.lag(f"_b_{new}").over(order).alias(f"_eb_{new}") for new in before],
        *[F.lead(f"_a_{new}").over(order).alias(f"_ea_{new}") for new in after],
    )
    inside = Window.partitionBy(*keys, "bucket").orderBy(value)
    joined = _join_offsets(df, edges, [*keys, "bucket"])
    return joined.select(
        "*",
        *[F.coalesce(F.lag(src).over(inside), F.col(f"_eb_{new}")).alias(new) for new, src in before.items()],
        *[F.coalesce(F.lead(src).over(inside), F.col(f"_ea_{new}")).alias(new) for new, src in after.items()],
    ).drop(*[f"_eb_{n}" for n in before], *[f"_ea_{n}" for n in after])


def hash_unit(hex_hash: Column) -> Column:
    """First 13 hex digits as a number in [0, 1): exact in a double and in hex order."""
    return F.conv(F.substring(hex_hash, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: str,
    name: str = "position",
    value: Column | None = None,
) -> DataFrame:
    """1-based position per `keys` in the order (`order`, hash of `tie`, `tie`).

    `order` is a hex hash, or any column when `value` gives a number that never
    decreases along it.
    """
    keys = list(keys)
    rows = _order_buckets(df, order, tie, value)
    offsets = _bucket_counts(rows, keys)
    inside = Window.partitionBy(*keys, "bucket").orderBy(order, "_tie_hash", tie)
    return (
        _join_offsets(rows, offsets, [*keys, "bucket"])
        .withColumn(name, F.col("_before") + F.row_number().over(inside))
        .drop("bucket", "_before", "_upto", "_tie_hash", "group_size")
    )


def mark_first(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: str,
    quota: Column | DataFrame,
    name: str = "chosen",
    value: Column | None = None,
) -> DataFrame:
    """Flag the first `quota` rows per `keys` in the order (`order`, hash of `tie`, `tie`).

    `quota` is an expression over `group_size`, or a table `(keys, quota)`. Bucket
    counts tell where the quota ends; only that one bucket per group is ranked, to
    find its last row. All rows are then compared with that row, which is looked up
    per group and bucket: a group may hold most rows, a bucket never does.
    """
    keys = list(keys)
    rows = _order_buckets(df, order, tie, value)
    offsets = _bucket_counts(rows, keys)
    if isinstance(quota, DataFrame):
        offsets = _join_offsets(offsets, quota.select(*keys, F.col("quota").alias("_quota")), keys)
    else:
        offsets = offsets.withColumn("_quota", quota)
    groups = offsets.groupBy(*keys).agg(F.max("group_size").alias("group_size"), F.max("_quota").alias("_quota"))
    ends_here = (F.col("_before") < F.col("_quota")) & (F.col("_quota") <= F.col("_upto"))
    needed = ends_here & (F.col("_quota") < F.col("group_size"))
    border = _join_offsets(rows, offsets.where(needed), [*keys, "bucket"])
    inside = Window.partitionBy(*keys, "bucket").orderBy(order, "_tie_hash", tie)
    last = border.withColumn("_rank", F.col("_before") + F.row_number().over(inside)).where(
        F.col("_rank") == F.col("_quota")
    )
    cut = last.select(*keys, F.struct(order, "_tie_hash", tie).alias("_cut"))
    if keys:
        groups = _join_offsets(groups, cut, keys, "left")
        spread = _join_offsets(offsets.select(*keys, "bucket"), groups, keys)
        joined = _join_offsets(rows, spread, [*keys, "bucket"])
    else:
        joined = _join_offsets(rows, groups.withColumn("_cut", cut.scalar()), [])
    placed = F.struct(order, "_tie_hash", tie)
    chosen = (
        F.when(F.col("_quota") <= 0, False)
        .when(F.col("_quota") >= F.col("group_size"), True)
        .otherwise(placed <= F.col("_cut"))
    )
    return joined.withColumn(name, chosen).drop("group_size", "_quota", "_cut", "bucket", "_tie_hash")


def take_first(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: str,
    quota: Column | DataFrame,
    value: Column | None = None,
) -> DataFrame:
    """The rows `mark_first` flags."""
    return mark_first(df, keys, order, tie, quota, "_chosen", value).where("_chosen").drop("_chosen")


def _order_buckets(df: DataFrame, order: str, tie: str, value: Column | None) -> DataFrame:
    """Copies share one order value; the hash of the tie spreads them over buckets."""
    rows = df.withColumn("_tie_hash", F.sha2(F.col(tie).cast("string"), 256))
    return with_bucket(
        rows, hash_unit(F.col(order)) if value is None else value, hash_unit(F.col("_tie_hash"))
    )


def _bucket_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    counts = rows.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(
        *keys,
        "bucket",
        (F.sum("_n").over(upto) - F.col("_n")).alias("_before"),
        F.sum("_n").over(upto).alias("_upto"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("group_size"),
    )
