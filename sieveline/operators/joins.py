"""Joins with the checks that make them safe to rely on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.plans.guards import by_key, holding
from sieveline.plans.ordered import positions


def align_scores(df: DataFrame, key: str, methods: Sequence[str]) -> DataFrame:
    """One row per key that every method scored: `key, y_true, <method>...`.

    One shuffle in place of one join per method. A key whose labels disagree, or
    that a method scored twice, fails.
    """
    methods = list(methods)
    if len(set(methods)) != len(methods):
        raise ValueError(f"duplicate method names: {methods}")
    rows = df.where(F.col("method").isin(*methods))
    pick = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    wide = rows.groupBy(key).agg(
        F.min("y_true").alias("y_true"),
        F.max("y_true").alias("_y"),
        F.count(F.lit(1)).alias("_n"),
        F.count_distinct("method").alias("_m"),
        *[pick(m, "score").alias(m) for m in methods],
    )
    sound = (
        F.when(F.col("_y") != F.col("y_true"), F.raise_error(F.lit("label mismatch while aligning")))
        .when(F.col("_n") != F.col("_m"), F.raise_error(F.lit("a method scored one key twice")))
        .otherwise(F.col("_m") == len(methods))
    )
    return wide.where(sound).select(key, "y_true", *methods)


def strict_one_to_one(left: DataFrame, right: DataFrame, key: str, label: str | None = None) -> DataFrame:
    """Join where both sides are unique on the key and neither loses a row; each side is read once."""
    other = right if label is None else right.withColumnRenamed(label, f"_{label}")
    sides = by_key(left, key, "_left", "_n_left").join(by_key(other, key, "_right", "_n_right"), key, "full_outer")
    once = lambda c: F.coalesce(F.col(c), F.lit(1)) == 1
    sound = holding(
        sides,
        (once("_n_left") & once("_n_right"), f"duplicate keys on {key}"),
        (F.col("_n_left").isNotNull() & F.col("_n_right").isNotNull(), f"rows without a partner on {key}"),
    )
    fields = [f"_left.{c}" for c in left.columns if c != key] + [f"_right.{c}" for c in other.columns if c != key]
    joined = sound.select(key, *fields)
    if label is None:
        return joined
    agree = F.col(label).eqNullSafe(F.col(f"_{label}"))
    return holding(joined, (agree, f"labels disagree: {label}")).drop(f"_{label}")


def _with_partner(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Left join of the struct `_row`; a row whose key the lookup holds more than once fails."""
    joined = df.join(by_key(lookup, key, "_row", "_n"), key, "left")
    return holding(joined, (F.coalesce("_n", F.lit(1)) == 1, f"duplicate keys on {key}")).drop("_n")


def metadata_join(predictions: DataFrame, metadata: DataFrame, key: str, label: str = "y_true", meta_label: str = "label") -> DataFrame:
    """Predictions with their metadata; every prediction must match one row of it, and labels must agree."""
    matched = holding(
        _with_partner(predictions, metadata, key), (F.col("_row").isNotNull(), "predictions without metadata")
    )
    joined = matched.select(*matched.columns[:-1], *[f"_row.{c}" for c in metadata.columns if c != key])
    agree = F.col(label).eqNullSafe(F.col(meta_label))
    return holding(joined, (agree, f"labels disagree: {label} and {meta_label}"))


def enrich(df: DataFrame, lookup: DataFrame, key: str, column: str) -> DataFrame:
    """Left join of one lookup column; a row without a value fails."""
    joined = _with_partner(df, lookup.select(key, column), key).withColumn(column, F.col(f"_row.{column}")).drop("_row")
    return holding(joined, (F.col(column).isNotNull(), f"missing values in {column}"))


def paired_deltas(
    df: DataFrame, by: str, candidate: str, baseline: str, on: Sequence[str], metrics: Sequence[str]
) -> DataFrame:
    """Candidate minus baseline per pairing key (seed, slice...)."""
    side = lambda name, tag: df.where(F.col(by) == name).select(
        *on, *[F.col(m).alias(f"{tag}_{m}") for m in metrics]
    )
    joined = side(candidate, "candidate").join(side(baseline, "baseline"), list(on))
    return joined.withColumns(
        {f"delta_{m}": F.col(f"candidate_{m}") - F.col(f"baseline_{m}") for m in metrics}
    )


def baseline_deltas(
    df: DataFrame,
    groups: Sequence[str],
    is_baseline: Column,
    metrics: Sequence[str],
    lower_is_better: Sequence[str] = (),
    tag: str = "baseline",
) -> DataFrame:
    """Every row minus the one baseline row of its group; exactly one baseline per group is required."""
    groups = list(groups)
    pick = lambda m: F.max(F.when(is_baseline, F.col(m))).alias(f"_base_{m}")
    base = df.groupBy(*groups).agg(F.count_if(is_baseline).alias("_n"), *[pick(m) for m in metrics])
    one = F.when(F.col("_n") == 1, F.lit(True)).otherwise(
        F.raise_error(F.lit("expected exactly one baseline row per group"))
    )
    base = base.where(one).drop("_n")
    joined = df.join(base, groups) if groups else df.withColumn(
        "_b", base.select(F.struct("*")).scalar()
    ).select("*", "_b.*").drop("_b")
    out = {}
    for m in metrics:
        delta = F.col(m) - F.col(f"_base_{m}")
        out[f"{m}_delta_vs_{tag}"] = delta
        out[f"{m}_improved_vs_{tag}"] = delta < 0 if m in lower_is_better else delta > 0
    return joined.withColumns(out).drop(*[f"_base_{m}" for m in metrics])


def replace_by_key(target: DataFrame, detail: DataFrame, key: str, branch: str, score: str, label: str = "y_true") -> DataFrame:
    """Swap one score column for the detail table's score; keys and labels must agree."""
    other = detail.select(key, F.col(label).alias("_label"), F.col(score).alias("_score"))
    joined = strict_one_to_one(target, other, key)
    agree = F.col(label).eqNullSafe(F.col("_label"))
    return holding(joined, (agree, f"labels disagree on {key}")).withColumn(branch, F.col("_score")).drop("_label", "_score")


def replace_by_position(
    target: DataFrame, detail: DataFrame, order: str, branch: str, score: str, reference: str, tolerance: float = 1e-5
) -> DataFrame:
    """Swap one score by row order when paths differ: labels must agree and the unchanged score must match."""
    number = F.col(order).cast("double")
    left = positions(target, [], order, order, "_at", number)
    right = positions(detail, [], order, order, "_at", number).select(
        "_at", F.col("y_true").alias("_label"), F.col(score).alias("_score"), F.col(reference).alias("_reference")
    )
    joined = strict_one_to_one(left, right, "_at")
    agree = F.col("y_true").eqNullSafe(F.col("_label"))
    near = F.abs(F.col("_reference") - F.col(branch)) <= tolerance
    checked = holding(
        joined, (agree, "labels disagree by position"), (near, "row order does not match: the unchanged score differs")
    )
    return checked.withColumn(branch, F.col("_score")).drop("_at", "_label", "_score", "_reference")


def coverage(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, tagged 'missing' or 'extra'."""
    want, have = expected.select(key).distinct(), actual.select(key).distinct()
    missing = want.join(have, key, "left_anti").withColumn("status", F.lit("missing"))
    extra = have.join(want, key, "left_anti").withColumn("status", F.lit("extra"))
    return missing.unionByName(extra)


def membership(df: DataFrame, chosen: DataFrame, key: str, keep: bool = True) -> DataFrame:
    """Rows whose key is (or is not) in the chosen set."""
    return df.join(chosen.select(key).distinct(), key, "left_semi" if keep else "left_anti")


def fallback_override(
    sample: DataFrame, scores: DataFrame, fallback: DataFrame, key: str, score: str, order: str
) -> DataFrame:
    """Sample rows with the predicted score where there is one, else the fallback, clipped to [0, 1]."""
    joined = sample.select(key, order)
    for source, name in ((scores, "_first"), (fallback, "_second")):
        one = source.select(key, F.col(score).alias(name))
        joined = _with_partner(joined, one, key).withColumn(name, F.col(f"_row.{name}")).drop("_row")
    value = F.coalesce("_first", "_second")
    return holding(joined, (value.isNotNull(), "sample ids without any score")).select(
        key,
        order,
        F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)).alias(score),
        F.col("_first").isNotNull().alias("from_prediction"),
    )


def with_grid(df: DataFrame, **axes: Sequence) -> DataFrame:
    """Every row with every point of a literal grid; meant for histograms, whose rows are distinct scores."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def policy_folds(folds: DataFrame, selected: DataFrame, on: Sequence[str], policy: str) -> DataFrame:
    """Fold rows of the candidates a policy selected."""
    return folds.join(selected.select(policy, *on).distinct(), list(on))
