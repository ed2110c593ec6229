"""Threshold search on running counts: one prefix sum in place of a rescan per candidate."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.operators.metrics import clipped, neighbours, operating_point, ratio, running, utility

FIXED_CANDIDATES = (0.0, 0.5, 1.0)


def candidate_counts(df: DataFrame, keys: Sequence[str], score="score") -> DataFrame:
    """Every candidate threshold with tn, fp, fn, tp: 0, 1/2, 1, the distinct scores and their midpoints.

    A midpoint has the counts of the score above it, so no row is looked at twice.
    """
    return candidate_counts_of(running(df.withColumn(score, clipped(F.col(score))), keys, score), keys)


def candidate_counts_of(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same from `running` rows."""
    keys = list(keys)
    near = neighbours(rows, keys, "score", after={"_next": "score"})
    here = lambda t, neg_out, pos_out: F.struct(
        t.alias("threshold"), neg_out.alias("tn"), pos_out.alias("fn")
    )
    middle = (F.col("score") + F.col("_next")) / 2.0
    above_neg, above_pos = F.col("neg_below") + F.col("neg"), F.col("pos_below") + F.col("pos")
    points = near.select(
        *keys,
        "neg_all",
        "pos_all",
        F.explode(
            F.array(
                here(F.col("score"), F.col("neg_below"), F.col("pos_below")),
                F.when(F.col("_next").isNotNull() & (middle > F.col("score")), here(middle, above_neg, above_pos)),
            )
        ).alias("p"),
    ).where(F.col("p").isNotNull())
    fixed = rows.groupBy(*keys).agg(
        F.first("neg_all").alias("neg_all"),
        F.first("pos_all").alias("pos_all"),
        F.array(
            *[
                here(
                    F.lit(t),
                    F.sum(F.when(F.col("score") < t, F.col("neg")).otherwise(0)),
                    F.sum(F.when(F.col("score") < t, F.col("pos")).otherwise(0)),
                )
                for t in FIXED_CANDIDATES
            ]
        ).alias("ps"),
    ).select(*keys, "neg_all", "pos_all", F.explode("ps").alias("p"))
    return points.unionByName(fixed).select(
        *keys,
        "p.threshold",
        "p.tn",
        (F.col("neg_all") - F.col("p.tn")).alias("fp"),
        "p.fn",
        (F.col("pos_all") - F.col("p.fn")).alias("tp"),
    )


def threshold_candidates(df: DataFrame, keys: Sequence[str], score="score") -> DataFrame:
    return candidate_counts(df, keys, score).select(*keys, "threshold").distinct()


def _counts():
    return (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))


def _rates():
    tn, fp, fn, tp = _counts()
    one = F.lit(1.0)
    return tp / F.greatest(tp + fn, one), tn / F.greatest(tn + fp, one), tp / F.greatest(tp + fp, one)


def _accuracy(**_):
    tn, fp, fn, tp = _counts()
    return (tp + tn) / (tp + tn + fp + fn)


def _f1(**_):
    recall, _, precision = _rates()
    return F.when(precision + recall == 0.0, 0.0).otherwise(
        2.0 * precision * recall / (precision + recall)
    )


def _source_f1(**_):
    recall, _, precision = _rates()
    return 2.0 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))


def _balanced(**_):
    recall, specificity, _ = _rates()
    return (recall + specificity) / 2.0


def _youden(**_):
    recall, specificity, _ = _rates()
    return recall + specificity - 1.0


def _weighted(fake_detection=0.5, real_clearance=0.5, fpr_penalty=1.0, miss_penalty=1.0):
    recall, specificity, _ = _rates()
    as_col = lambda w: w if isinstance(w, Column) else F.lit(float(w))
    return (
        as_col(fake_detection) * recall
        + as_col(real_clearance) * specificity
        - as_col(fpr_penalty) * (1.0 - specificity)
        - as_col(miss_penalty) * (1.0 - recall)
    )


OBJECTIVES: dict[str, Callable[..., Column]] = {
    "accuracy": _accuracy,
    "f1": _f1,
    "source_accuracy": _accuracy,
    "source_balanced_accuracy": _balanced,
    "source_f1": _source_f1,
    "source_utility": _weighted,
    "source_youden": _youden,
}
"""Objective name -> expression over tn, fp, fn, tp. Add an entry to extend the search."""

ARRAY_OBJECTIVES: dict[str, Callable] = {
    "accuracy": lambda tn, fp, fn, tp: (tp + tn) / (tp + tn + fp + fn),
    "f1": lambda tn, fp, fn, tp: 2.0 * tp / (2.0 * tp + fp + fn),
}
"""The same for numpy arrays, for searches inside a task."""

TIE_BREAKS: dict[str, Callable[[], Column]] = {
    "near_half": lambda: -F.abs(F.col("threshold") - 0.5),
    "higher": lambda: F.col("threshold"),
    "lower": lambda: -F.col("threshold"),
}


def objective_column(name: str, **weights) -> Column:
    if name not in OBJECTIVES:
        raise ValueError(f"unknown threshold objective: {name}")
    return OBJECTIVES[name](**weights)


def choose(
    candidates: DataFrame, keys: Sequence[str], objective: Column, tie_break: str = "near_half"
) -> DataFrame:
    """Best candidate per group: objective, then the tie rule, then the lower threshold."""
    if tie_break not in TIE_BREAKS:
        raise ValueError(f"unknown tie-break: {tie_break}")
    best = candidates.groupBy(*keys).agg(
        F.min(
            F.struct(
                (-objective).alias("cost"),
                (-TIE_BREAKS[tie_break]()).alias("tie"),
                "threshold",
                "tn",
                "fp",
                "fn",
                "tp",
            )
        ).alias("b")
    )
    return best.select(
        *keys, "b.threshold", (-F.col("b.cost")).alias("objective"), "b.tn", "b.fp", "b.fn", "b.tp"
    )


def best_threshold(df: DataFrame, keys: Sequence[str], objective: str = "accuracy", score="score") -> DataFrame:
    """Highest accuracy or F1; equal values prefer the threshold nearest one half."""
    if objective not in ("accuracy", "f1"):
        raise ValueError(f"unknown threshold objective: {objective}")
    return choose(candidate_counts(df, keys, score), keys, objective_column(objective))


CAP_SLACK = 1e-12


def positive_rate() -> Column:
    return (F.col("tp") + F.col("fp")).cast("double") / (
        F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    )


def select_source_threshold(
    df: DataFrame,
    keys: Sequence[str],
    strategy: str = "source_utility",
    tie_break: str = "near_half",
    cap: float | None = None,
    score="score",
    **weights,
) -> DataFrame:
    """Threshold by strategy under an optional cap on the rate of rows called fake."""
    if cap is not None and not 0.0 <= cap <= 1.0:
        raise ValueError("the cap must be in [0, 1]")
    counts = candidate_counts(df, keys, score)
    if cap is not None:
        # one row per group is needed even when nothing passes, to fail instead of losing the group
        passes = positive_rate() <= cap + CAP_SLACK
        found = F.max(passes.cast("int"))
        groups = counts.groupBy(*keys).agg(
            F.when(found == 1, F.lit(True))
            .otherwise(F.raise_error(F.lit("no threshold satisfies the cap")))
            .alias("_found")
        )
        chosen = choose(counts.where(passes), keys, objective_column(strategy, **weights), tie_break)
        if keys:
            chosen = groups.join(chosen, list(keys), "left").drop("_found")
        else:
            chosen = chosen.where(groups.select("_found").scalar())
    else:
        chosen = choose(counts, keys, objective_column(strategy, **weights), tie_break)
    return chosen.withColumn("positive_rate", positive_rate())


def operating_threshold_report(df: DataFrame, keys: Sequence[str], target: float = 0.01) -> DataFrame:
    """Threshold at the BPCER target, with its accuracy and the label counts it gives."""
    rows = running(df, keys)
    point = operating_point(rows, keys, target)
    called = F.when(F.col("strict"), F.col("score") > F.col("threshold")).otherwise(
        F.col("score") >= F.col("threshold")
    )
    joined = rows.join(point, list(keys)) if keys else rows.withColumn(
        "_p", point.select(F.struct("*")).scalar()
    ).select("*", "_p.*")
    n = F.sum(F.col("pos") + F.col("neg"))
    right = F.when(called, F.col("pos")).otherwise(F.col("neg"))
    return joined.groupBy(*keys, "threshold", "strict", "bpcer", "apcer").agg(
        n.alias("n_rows"),
        (F.sum(right) / n).alias("accuracy"),
        F.sum(F.when(called, F.col("pos") + F.col("neg")).otherwise(0)).alias("n_called_attack"),
        F.sum(F.when(called, 0).otherwise(F.col("pos") + F.col("neg"))).alias("n_called_genuine"),
    )


def policy_grid(
    caps: Sequence[float | None],
    fake_detection: Sequence[float],
    real_clearance: Sequence[float],
    fpr_penalty: Sequence[float],
    miss_penalty: Sequence[float],
) -> Column:
    """The policy grid as one literal array of structs: its size is set by the caller's lists."""
    from sieveline.functions.scalar import policy_label

    rows = []
    for cap in caps:
        for fd in fake_detection:
            for rc in real_clearance:
                for fp in fpr_penalty:
                    for mp in miss_penalty:
                        rows.append(
                            F.struct(
                                F.lit(policy_label(cap, fd, rc, fp, mp)).alias("policy"),
                                F.lit(cap).cast("double").alias("cap"),
                                F.lit(float(fd)).alias("w_fd"),
                                F.lit(float(rc)).alias("w_rc"),
                                F.lit(float(fp)).alias("p_fpr"),
                                F.lit(float(mp)).alias("p_miss"),
                            )
                        )
    return F.array(*rows)


def policy_sweep(
    source: DataFrame, target: DataFrame, keys: Sequence[str], grid: Column, tie_break: str = "higher"
) -> DataFrame:
    """For every policy: the threshold its objective picks on source rows, and source and target metrics there.

    The grid meets candidate counts (distinct scores), never rows, and the winner is a
    plain min aggregate, so each task keeps one running best per policy.
    """
    keys = list(keys)
    counts = candidate_counts(source, keys).withColumn("_grid", F.explode(grid)).select("*", "_grid.*").drop("_grid")
    allowed = counts.where(F.col("cap").isNull() | (positive_rate() <= F.col("cap") + CAP_SLACK))
    policy = ["policy", "cap", "w_fd", "w_rc", "p_fpr", "p_miss"]
    weights = dict(
        fake_detection=F.col("w_fd"),
        real_clearance=F.col("w_rc"),
        fpr_penalty=F.col("p_fpr"),
        miss_penalty=F.col("p_miss"),
    )
    chosen = choose(allowed, [*keys, *policy], objective_column("source_utility", **weights), tie_break)
    fixed = _fixed_policy(source, keys)
    chosen = chosen.select(
        *keys, *policy, "threshold", F.col("objective").alias("threshold_source_utility"), "tn", "fp", "fn", "tp"
    ).unionByName(fixed)
    named = lambda prefix, names: [F.col(c).alias(f"{prefix}_{c}") for c in names]
    kept = ["utility", "accuracy", "precision", "recall", "predicted_positive_rate"]
    scored = utility(chosen, F.col("w_fd"), F.col("w_rc"), F.col("p_fpr"), F.col("p_miss")).select(
        *keys, *policy, "threshold", "threshold_source_utility", *named("source", kept)
    )
    # target counts at the chosen thresholds: thresholds are few per group, rows are histogram rows
    from sieveline.operators.metrics import confusion_aggregates, histogram

    limits = scored.groupBy(*keys).agg(F.collect_set("threshold").alias("_ts"))
    at = (
        histogram(target, keys)
        .join(limits, keys)
        .withColumn("threshold", F.explode("_ts"))
        .groupBy(*keys, "threshold")
        .agg(*confusion_aggregates(F.col("threshold")))
    )
    both = scored.join(at, [*keys, "threshold"])
    return utility(both, F.col("w_fd"), F.col("w_rc"), F.col("p_fpr"), F.col("p_miss")).select(
        *scored.columns, *named("target", kept)
    )


def _fixed_policy(source: DataFrame, keys: list[str]) -> DataFrame:
    from sieveline.operators.metrics import confusion

    return confusion(source, keys, 0.5).select(
        *keys,
        F.lit("fixed_0p5").alias("policy"),
        F.lit(None).cast("double").alias("cap"),
        *[F.lit(1.0).alias(c) for c in ("w_fd", "w_rc", "p_fpr", "p_miss")],
        F.lit(0.5).alias("threshold"),
        F.lit(None).cast("double").alias("threshold_source_utility"),
        "tn",
        "fp",
        "fn",
        "tp",
    )


def policy_summary(detail: DataFrame) -> DataFrame:
    """Mean and sample deviation over seeds per policy."""
    values = [c for c in detail.columns if c.startswith(("source_", "target_"))] + ["threshold"]
    return detail.groupBy("policy", "cap", "w_fd", "w_rc", "p_fpr", "p_miss").agg(
        F.count_distinct("seed").alias("n_seeds"),
        *[F.avg(v).alias(f"{v}_mean") for v in values],
        *[F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{v}_std") for v in values],
    )


def transfer_threshold_report(
    df: DataFrame, variant: str, clean: str, keys: Sequence[str] = (), objective: str = "accuracy"
) -> DataFrame:
    """Per variant: accuracy and F1 at 0.5, at the threshold chosen on the clean variant, and at the variant's own best."""
    from sieveline.operators.metrics import confusion, with_scores

    keys = list(keys)
    best = best_threshold(df, [*keys, variant], objective)
    own = with_scores(best).select(
        *keys,
        variant,
        F.col("threshold").alias("oracle_threshold"),
        F.col("accuracy").alias("oracle_accuracy"),
        F.col("f1").alias("oracle_f1"),
    )
    picked = best.where(F.col(variant) == clean).select(*keys, F.col("threshold").alias("clean_threshold"))
    with_limit = (
        df.join(picked, keys)
        if keys
        else df.withColumn("clean_threshold", picked.select("clean_threshold").scalar())
    )
    called = lambda t: F.col("score") >= t
    fake = F.col("y_true") == 1
    cells = lambda t, prefix: [
        F.count_if(~called(t) & ~fake).alias(f"{prefix}tn"),
        F.count_if(called(t) & ~fake).alias(f"{prefix}fp"),
        F.count_if(~called(t) & fake).alias(f"{prefix}fn"),
        F.count_if(called(t) & fake).alias(f"{prefix}tp"),
    ]
    counts = with_limit.groupBy(*keys, variant, "clean_threshold").agg(
        *cells(F.lit(0.5), "default_"), *cells(F.col("clean_threshold"), "clean_")
    )
    for prefix in ("default_", "clean_"):
        tn, fp, fn, tp = (F.col(prefix + c) for c in ("tn", "fp", "fn", "tp"))
        counts = counts.withColumns(
            {
                f"{prefix}accuracy": ratio(tp + tn, tp + tn + fp + fn),
                f"{prefix}f1": ratio(2 * tp, 2 * tp + fp + fn),
            }
        ).drop(*[prefix + c for c in ("tn", "fp", "fn", "tp")])
    return counts.join(own, [*keys, variant])
