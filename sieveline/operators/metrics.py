"""Binary detector metrics per group. Label 1 is fake/attack; a row is called fake when score >= threshold.

Everything starts from the score histogram `(keys, score) -> pos, neg`, which
combines on the map side, so a hot group or a hot score costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.plans.ordered import neighbours, running_sums


def ratio(top: Column, bottom: Column, empty=0.0) -> Column:
    """top/bottom as double; `empty` where the bottom is zero."""
    return F.when(bottom == 0, F.lit(empty).cast("double")).otherwise(
        top.cast("double") / bottom.cast("double")
    )


def clipped(score: Column) -> Column:
    return F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0))


def histogram(df: DataFrame, keys: Sequence[str], score="score", label="y_true") -> DataFrame:
    """Counts of both labels per distinct score; refuses scores and labels that cannot be used."""
    value, truth = F.col(score).cast("double"), F.col(label)
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    checked = F.when(bad, F.raise_error(F.lit("scores must be finite"))).otherwise(value)
    checked_label = F.when(truth.isin(0, 1), truth).otherwise(
        F.raise_error(F.lit("labels must be 0 or 1"))
    )
    return (
        df.select(*keys, checked.alias("score"), checked_label.alias("_y"))
        .groupBy(*keys, "score")
        .agg(F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg"))
    )


def running(df: DataFrame, keys: Sequence[str], score="score", label="y_true") -> DataFrame:
    """Histogram with `pos_below`, `neg_below`, `pos_all`, `neg_all` and `bucket`."""
    return running_sums(histogram(df, keys, score, label), keys, "score", ["pos", "neg"])


def running_of(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same from a ready-made histogram `(keys, score, pos, neg)`."""
    return running_sums(counts, keys, "score", ["pos", "neg"])


def confusion_aggregates(threshold: Column | float = 0.5, score="score") -> list[Column]:
    """tn, fp, fn, tp over a histogram."""
    called = F.col(score) >= threshold
    return [
        F.sum(F.when(~called, F.col("neg")).otherwise(0)).alias("tn"),
        F.sum(F.when(called, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~called, F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(called, F.col("pos")).otherwise(0)).alias("tp"),
    ]


def confusion(df: DataFrame, keys: Sequence[str], threshold: Column | float = 0.5, score="score") -> DataFrame:
    """tn, fp, fn, tp per group straight from rows; `threshold` may be a column."""
    called, fake = F.col(score) >= threshold, F.col("y_true") == 1
    return df.groupBy(*keys).agg(
        F.count_if(~called & ~fake).alias("tn"),
        F.count_if(called & ~fake).alias("fp"),
        F.count_if(~called & fake).alias("fn"),
        F.count_if(called & fake).alias("tp"),
    )


def with_scores(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1 from tn, fp, fn, tp; empty denominators give 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns(
        {
            "accuracy": ratio(tp + tn, tn + fp + fn + tp),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def with_rates(counts: DataFrame) -> DataFrame:
    """support, fake call rate, false positive rate on real rows, miss rate on fake rows."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns(
        {
            "support": tn + fp + fn + tp,
            "fake_call_rate": ratio(tp + fp, tn + fp + fn + tp),
            "real_fpr": ratio(fp, fp + tn),
            "fake_miss_rate": ratio(fn, fn + tp),
        }
    )


def utility(
    counts: DataFrame,
    fake_detection: Column | float = 1.0,
    real_clearance: Column | float = 1.0,
    fpr_penalty: Column | float = 4.0,
    miss_penalty: Column | float = 1.5,
) -> DataFrame:
    """Weighted decision utility and the rates it is made of."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    at_least_one = lambda c: F.greatest(c, F.lit(1.0))
    out = counts.withColumns(
        {
            "recall": tp / at_least_one(tp + fn),
            "specificity": tn / at_least_one(tn + fp),
            "precision": tp / at_least_one(tp + fp),
            "accuracy": (tp + tn) / (tp + tn + fp + fn),
            "positive_rate": (tp + fn) / (tp + tn + fp + fn),
            "predicted_positive_rate": (tp + fp) / (tp + tn + fp + fn),
            "n_samples": (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")),
        }
    ).withColumns(
        {"real_fpr": 1.0 - F.col("specificity"), "fake_miss_rate": 1.0 - F.col("recall")}
    )
    as_col = lambda w: w if isinstance(w, Column) else F.lit(float(w))
    return out.withColumn(
        "utility",
        as_col(fake_detection) * F.col("recall")
        + as_col(real_clearance) * F.col("specificity")
        - as_col(fpr_penalty) * F.col("real_fpr")
        - as_col(miss_penalty) * F.col("fake_miss_rate"),
    )


def brier_score(df: DataFrame, keys: Sequence[str], score="score") -> DataFrame:
    error = clipped(F.col(score)) - F.col("y_true")
    return df.groupBy(*keys).agg(F.avg(error * error).alias("brier_score"))


def bin_edges(n_bins: int) -> list[float]:
    return [float(e) for e in np.linspace(0.0, 1.0, n_bins + 1)]


def bin_of(score: Column, n_bins: int) -> Column:
    """Number of inner edges <= score. Compares with the edges themselves: floor(score*n) misplaces some."""
    value = clipped(score)
    return sum((F.when(value >= e, 1).otherwise(0) for e in bin_edges(n_bins)[1:-1]), F.lit(0))


def calibration_bins(df: DataFrame, keys: Sequence[str], n_bins: int = 10, score="score") -> DataFrame:
    """Equal-width reliability bins, empty ones included."""
    keys = list(keys)
    edges = bin_edges(n_bins)
    filled = (
        df.withColumn("bin", bin_of(F.col(score), n_bins))
        .groupBy(*keys, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(clipped(F.col(score))).alias("conf"),
            F.avg(F.col("y_true").cast("double")).alias("acc"),
        )
    )
    slots = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(edges[i]).alias("bin_lower"), F.lit(edges[i + 1]).alias("bin_upper")) for i in range(n_bins)])
    # one map per group, then every slot of the fixed bin list looked up in it
    per_group = filled.groupBy(*keys).agg(
        F.sum("n").alias("_total"),
        F.map_from_entries(F.collect_list(F.struct("bin", F.struct("n", "conf", "acc")))).alias("_bins"),
    )
    rows = per_group.select(*keys, "_total", "_bins", F.explode(slots).alias("s"))
    hit = F.element_at("_bins", F.col("s.bin"))
    return rows.select(
        *keys,
        "s.bin",
        "s.bin_lower",
        "s.bin_upper",
        F.coalesce(hit["n"], F.lit(0)).alias("count"),
        (F.coalesce(hit["n"], F.lit(0)) / F.col("_total")).alias("weight"),
        F.coalesce(hit["conf"], F.lit(0.0)).alias("confidence"),
        F.coalesce(hit["acc"], F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.abs(hit["conf"] - hit["acc"]), F.lit(0.0)).alias("abs_gap"),
    )


def expected_calibration_error(df: DataFrame, keys: Sequence[str], n_bins: int = 10) -> DataFrame:
    bins = calibration_bins(df, keys, n_bins)
    return bins.groupBy(*keys).agg(
        F.sum(F.col("weight") * F.col("abs_gap")).alias("expected_calibration_error")
    )


def maximum_calibration_error(df: DataFrame, keys: Sequence[str], n_bins: int = 10) -> DataFrame:
    bins = calibration_bins(df, keys, n_bins).where(F.col("count") > 0)
    return bins.groupBy(*keys).agg(F.max("abs_gap").alias("maximum_calibration_error"))


def auc_aggregate() -> Column:
    """Tie-aware area under the ROC curve over `running` rows; null for one class."""
    above = F.col("pos_all") - F.col("pos_below") - F.col("pos")
    share = (F.col("neg").cast("double") / F.col("neg_all")) * (
        (above + F.col("pos") / 2.0) / F.col("pos_all")
    )
    both = (F.max("pos_all") > 0) & (F.max("neg_all") > 0)
    return F.when(both, F.sum(F.when((F.col("pos_all") > 0) & (F.col("neg_all") > 0), share)))


def roc_auc(df: DataFrame, keys: Sequence[str], score="score") -> DataFrame:
    return running(df, keys, score).groupBy(*keys).agg(auc_aggregate().alias("roc_auc"))


def binary_metrics(
    df: DataFrame, keys: Sequence[str], threshold: float = 0.5, n_bins: int = 10, score="score"
) -> DataFrame:
    """The full bundle per group, from one pass over the score histogram."""
    return summarise_running(running(df, keys, score), keys, threshold, n_bins)


def summarise_running(
    rows: DataFrame, keys: Sequence[str], threshold: Column | float = 0.5, n_bins: int = 10
) -> DataFrame:
    """Metric bundle from `running` rows; a `threshold` column must be constant within its group."""
    value = clipped(F.col("score"))
    n = F.col("pos") + F.col("neg")
    miss, real_error = value - 1.0, value
    rows = rows.withColumn("_bin", bin_of(F.col("score"), n_bins))
    in_bin = lambda i, c: F.sum(F.when(F.col("_bin") == i, c))
    totals = rows.groupBy(*keys).agg(
        *confusion_aggregates(threshold),
        F.sum(n).alias("n_samples"),
        F.sum(F.col("pos") * miss * miss + F.col("neg") * real_error * real_error).alias("_sq"),
        auc_aggregate().alias("roc_auc"),
        *[
            F.struct(
                in_bin(i, n).alias("n"), in_bin(i, value * n).alias("conf"), in_bin(i, F.col("pos")).alias("acc")
            ).alias(f"_b{i}")
            for i in range(n_bins)
        ],
    )
    bins = F.filter(F.array(*[F.col(f"_b{i}") for i in range(n_bins)]), lambda b: b["n"] > 0)
    gap = lambda b: F.abs(b["conf"] / b["n"] - b["acc"] / b["n"])
    return (
        with_scores(totals)
        .withColumn("brier_score", F.col("_sq") / F.col("n_samples"))
        .withColumn("_bins", bins)
        .withColumn(
            "expected_calibration_error",
            F.aggregate(
                "_bins", F.lit(0.0), lambda acc, b: acc + (b["n"] / F.col("n_samples")) * gap(b)
            ),
        )
        .withColumn("maximum_calibration_error", F.array_max(F.transform("_bins", gap)))
        .drop("_sq", "_bins", *[f"_b{i}" for i in range(n_bins)])
    )


def det_points(df: DataFrame, keys: Sequence[str], score="score") -> DataFrame:
    """BPCER/APCER at every distinct score, as `>=` and as strict `>`; `strict` stands for nextafter(score)."""
    return det_points_of(running(df, keys, score), keys)


def det_points_of(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    point = lambda strict, neg_out, pos_out: F.struct(
        F.lit(strict).alias("strict"),
        ratio(F.col("neg_all") - neg_out, F.col("neg_all")).alias("bpcer"),
        ratio(pos_out, F.col("pos_all")).alias("apcer"),
    )
    both = F.array(
        point(False, F.col("neg_below"), F.col("pos_below")),
        point(True, F.col("neg_below") + F.col("neg"), F.col("pos_below") + F.col("pos")),
    )
    return rows.select(
        *keys, F.col("score").alias("threshold"), "pos_all", "neg_all", F.explode(both).alias("p")
    ).select(*keys, "threshold", "p.strict", "p.bpcer", "p.apcer", "pos_all", "neg_all")


def apcer_at_bpcer(df: DataFrame, keys: Sequence[str], target: float = 0.01, score="score") -> DataFrame:
    """Lowest APCER with BPCER <= target, then higher BPCER, then lowest threshold."""
    return operating_point(running(df, keys, score), keys, target)


def operating_point(rows: DataFrame, keys: Sequence[str], target: float = 0.01) -> DataFrame:
    points = det_points_of(rows, keys)
    need = (F.col("pos_all") > 0) & (F.col("neg_all") > 0)
    allowed = points.withColumn(
        "_ok", F.when(need, F.col("bpcer") <= target).otherwise(F.raise_error(F.lit("both label classes are needed")))
    ).where("_ok")
    best = allowed.groupBy(*keys).agg(
        F.min(F.struct("apcer", (-F.col("bpcer")).alias("neg_bpcer"), "threshold", "strict")).alias("p"),
        F.first("neg_all").alias("n_bona_fide"),
        F.first("pos_all").alias("n_attack"),
    )
    return best.select(
        *keys,
        "p.threshold",
        "p.strict",
        (-F.col("p.neg_bpcer")).alias("bpcer"),
        "p.apcer",
        "n_bona_fide",
        "n_attack",
    )


def audet_proxy(df: DataFrame, keys: Sequence[str], score="score") -> DataFrame:
    return audet_of(running(df, keys, score), keys)


def audet_of(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trapezoid of APCER over sorted distinct (BPCER, APCER) points.

    BPCER only moves at scores held by genuine rows. Such a step joins the highest
    APCER before it (below the next higher genuine score) to the lowest one after it
    (above the next lower genuine score).
    """
    steps = rows.where(F.col("neg") > 0).withColumn("_upto", F.col("pos_below") + F.col("pos"))
    near = neighbours(steps, keys, "score", before={"_lower": "_upto"}, after={"_higher": "pos_below"})
    high = F.coalesce(F.col("_higher"), F.col("pos_all")).cast("double") / F.col("pos_all")
    low = F.coalesce(F.col("_lower"), F.lit(0)).cast("double") / F.col("pos_all")
    area = F.sum(F.col("neg").cast("double") / F.col("neg_all") * (high + low) * 0.5)
    return near.groupBy(*keys).agg(area.alias("audet_proxy"))


def operating_metrics(df: DataFrame, keys: Sequence[str], score="score", target: float = 0.01) -> DataFrame:
    """APCER at the BPCER target, the DET area and class counts."""
    rows = running(df, keys, score)
    return operating_metrics_of(rows, keys, target)


def operating_metrics_of(rows: DataFrame, keys: Sequence[str], target: float = 0.01) -> DataFrame:
    point = operating_point(rows, keys, target)
    return join_groups(point, audet_of(rows, keys), keys)


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join two one-row-per-group tables; without keys both are a single row."""
    keys = list(keys)
    if keys:
        return left.join(right, keys)
    values = right.select(F.struct("*").alias("v")).scalar()
    return left.withColumn("_v", values).select(*left.columns, "_v.*")


def score_stats(df: DataFrame, keys: Sequence[str], threshold: float = 0.5, score="score") -> DataFrame:
    s = F.col(score)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg(F.col("y_true").cast("double")).alias("positive_rate"),
        F.avg((s >= threshold).cast("double")).alias("predicted_positive_rate"),
        F.avg(s).alias("score_mean"),
        F.stddev_pop(s).alias("score_std"),
        F.min(s).alias("score_min"),
        F.max(s).alias("score_max"),
    )


def triage_aggregates(low: Column | float, high: Column | float, score="score") -> dict[str, Column]:
    """Rates of a three-way decision; null where nothing was decided or called."""
    s, real, fake = F.col(score), F.col("y_true") == 0, F.col("y_true") == 1
    is_real, is_fake = s <= low, s >= high
    decided = is_real | is_fake
    n = F.count(F.lit(1))
    share = lambda c: ratio(F.count_if(c), n, None)
    part = lambda c, of: ratio(F.count_if(c), F.count_if(of), None)
    rate = lambda c, of: ratio(F.count_if(c), F.greatest(F.count_if(of), F.lit(1)))
    right = (is_real & real).cast("long") + (is_fake & fake).cast("long")
    return {
        "coverage": share(decided),
        "uncertain_rate": share(~decided),
        "triage_accuracy": ratio(F.sum(right), F.count_if(decided), None),
        "fake_call_rate": share(is_fake),
        "real_call_rate": share(is_real),
        "fake_precision": part(is_fake & fake, is_fake),
        "real_precision": part(is_real & real, is_real),
        "real_fpr": rate(is_fake & real, real),
        "fake_false_clearance": rate(is_real & fake, fake),
        "fake_detection": rate(is_fake & fake, fake),
        "real_clearance": rate(is_real & real, real),
    }


def triage_metrics(df: DataFrame, keys: Sequence[str], low: float, high: float) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in triage_aggregates(low, high).items()])


def selection_objective(metrics: DataFrame, apcer_weight: float = 0.2) -> DataFrame:
    return metrics.withColumn("selection_objective", F.col("audet_proxy") + apcer_weight * F.col("apcer"))


def type_accuracy(df: DataFrame, keys: Sequence[str], predicted: str, actual: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(F.col(predicted).eqNullSafe(F.col(actual)).cast("double")).alias("type_accuracy")
    )
