"""Score fusion: means, weight grids, rank ensembles, and logistic fusion with its whole run."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.scalar import stable_hash
from sieveline.operators import metrics as m
from sieveline.operators.calibration import fit_calibrator
from sieveline.operators.joins import align_scores
from sieveline.operators.models import ScaledLogistic, fit_scaled_logistic
from sieveline.operators.runstats import minmax, pct_rank_average, select_best
from sieveline.operators.sampling import calibration_split
from sieveline.operators.thresholds import candidate_counts, choose, objective_column, positive_rate
from sieveline.plans.ordered import hash_unit, running_sums
from sieveline.session import cut_lineage

NORMALIZATIONS = ("raw", "minmax", "rank")


def mean_fusion(methods: Sequence[str]) -> Column:
    return sum((F.col(c) for c in methods[1:]), F.col(methods[0])) / float(len(methods))


def weight_grid(n_sources: int, step: float) -> list[tuple[float, ...]]:
    """All non-negative weights in multiples of `step` that sum to one."""
    if n_sources < 2:
        raise ValueError("fusion needs at least two sources")
    units = round(1.0 / step) if 0.0 < step <= 1.0 else 0
    if units < 1 or abs(units * step - 1.0) > 1e-8:
        raise ValueError("the step must divide one evenly")
    heads = (h for h in itertools.product(range(units + 1), repeat=n_sources - 1) if sum(h) <= units)
    return [tuple(k * step for k in (*h, units - sum(h))) for h in heads]


def weights_text(weights: Sequence[float]) -> str:
    return ",".join(f"{w:.4f}" for w in weights)


def weights_column(grid: Sequence[Sequence[float]]) -> Column:
    """The grid as a literal array of (name, weights)."""
    return F.array(
        *[
            F.struct(F.lit(weights_text(w)).alias("weights"), F.array(*[F.lit(float(x)) for x in w]).alias("w"))
            for w in grid
        ]
    )


def weighted_sum(columns: Sequence[str], weights: Column) -> Column:
    total = F.col(columns[0]) * F.get(weights, 0)
    for i, c in enumerate(columns[1:], start=1):
        total = total + F.col(c) * F.get(weights, i)
    return total


def collapsed(df: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Rows with equal scores as one row with label counts."""
    return df.groupBy(*methods).agg(
        F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") == 0).alias("neg")
    )


def normalised(counts: DataFrame, methods: Sequence[str], modes: Sequence[str]) -> DataFrame:
    """Collapsed rows with `<method>_<mode>` columns for every normalisation."""
    out = counts
    if "minmax" in modes:
        out = minmax(out, methods)
    if "rank" in modes:
        for c in methods:
            ties = counts.groupBy(c).agg(F.sum(F.col("pos") + F.col("neg")).alias("n"))
            ranks = running_sums(ties, [], c, ["n"]).select(
                c, ((F.col("n_below") + (F.col("n") + 1) / 2.0) / F.col("n_all")).alias(f"{c}_rank")
            )
            out = out.join(ranks, c)
    if "raw" in modes:
        out = out.withColumns({f"{c}_raw": F.col(c) for c in methods})
    return out


def fusion_search(
    df: DataFrame, methods: Sequence[str], step: float, modes: Sequence[str] = ("raw", "rank")
) -> DataFrame:
    """Metrics of every normalisation and weight vector, best first by `place`.

    The grid meets rows that were collapsed to distinct score tuples, and the fused
    scores are summed up again per (mode, weights, score) before any ordering.
    """
    unknown = set(modes) - set(NORMALIZATIONS)
    if unknown:
        raise ValueError(f"unknown normalisations: {sorted(unknown)}")
    rows = cut_lineage(normalised(collapsed(df, methods), methods, modes))
    grid = weights_column(weight_grid(len(methods), step))
    fused = rows.withColumn("_grid", F.explode(grid))
    scores = F.array(
        *[
            F.struct(
                F.lit(mode).alias("normalization"),
                weighted_sum([f"{c}_{mode}" for c in methods], F.col("_grid.w")).alias("score"),
            )
            for mode in modes
        ]
    )
    keys = ["normalization", "weights"]
    counts = (
        fused.select("pos", "neg", F.col("_grid.weights").alias("weights"), F.explode(scores).alias("s"))
        .groupBy("s.normalization", "weights", "s.score")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    running = cut_lineage(m.running_of(counts, keys))
    both = m.join_groups(m.summarise_running(running, keys), m.operating_metrics_of(running, keys), keys)
    table = both.select(
        *keys,
        "accuracy",
        "roc_auc",
        "apcer",
        "bpcer",
        "threshold",
        "strict",
        "audet_proxy",
        "brier_score",
        "expected_calibration_error",
    )
    return table


def best_fusion(table: DataFrame) -> DataFrame:
    """First row by APCER, DET area, then AUC."""
    order = [F.round("apcer", 12).asc(), F.round("audet_proxy", 12).asc(), F.round("roc_auc", 12).desc(), F.asc("normalization"), F.asc("weights")]
    return select_best(table, [], order)


def apply_fusion(
    df: DataFrame,
    names: Sequence[str],
    recipe: dict,
    threshold: float | None = None,
) -> DataFrame:
    """Fused score and label from a saved recipe (source_names, weights, normalization, threshold)."""
    expected, weights = list(recipe["source_names"]), [float(w) for w in recipe["weights"]]
    mode = recipe.get("normalization", "raw")
    if list(names) != expected:
        raise ValueError(f"names must equal the recipe's: expected {expected}, got {list(names)}")
    if len(expected) != len(weights) or min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("weights must be non-negative, one per source, with a positive sum")
    limit = recipe.get("threshold") if threshold is None else threshold
    if limit is None:
        raise ValueError("no threshold in the call or the recipe")
    weights = [w / sum(weights) for w in weights]
    out = df
    if mode == "minmax":
        out = minmax(out, names)
    elif mode == "rank":
        for c in names:
            out = pct_rank_average(out, [], c, f"{c}_rank")
    columns = [c if mode == "raw" else f"{c}_{mode}" for c in names]
    score = weighted_sum(columns, F.array(*[F.lit(w) for w in weights]))
    return out.withColumn("fraud_score", score).withColumn(
        "label", (F.col("fraud_score") >= float(limit)).cast("int")
    )


def rank_ensemble(df: DataFrame, key: str, methods: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """Weighted mean of the members' percentage ranks, over keys every member scored."""
    wide = align_scores(df, key, methods)
    for c in methods:
        wide = pct_rank_average(wide, [], c, f"{c}_rank")
    total = sum(weights)
    shares = F.array(*[F.lit(float(w) / total) for w in weights])
    return wide.withColumn("score", weighted_sum([f"{c}_rank" for c in methods], shares))


def group_rank_blend(df: DataFrame, score: str, group: str, weights: Sequence[float], apcer_weight: float = 0.2) -> DataFrame:
    """Metrics of w * global rank + (1 - w) * group rank for every w, with the selection objective."""
    ranked = pct_rank_average(pct_rank_average(df, [], score, "global_rank"), [group], score, "group_rank")
    pairs = ranked.groupBy("global_rank", "group_rank").agg(
        F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") == 0).alias("neg")
    )
    grid = F.array(*[F.lit(float(w)) for w in weights])
    blend = F.col("global_weight") * F.col("global_rank") + (1.0 - F.col("global_weight")) * F.col("group_rank")
    counts = (
        pairs.withColumn("global_weight", F.explode(grid))
        .groupBy("global_weight", blend.alias("score"))
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    keys = ["global_weight"]
    rows = cut_lineage(m.running_of(counts, keys))
    both = m.join_groups(m.summarise_running(rows, keys), m.operating_metrics_of(rows, keys), keys)
    return m.selection_objective(both, apcer_weight).select(
        *keys, "accuracy", "roc_auc", "apcer", "audet_proxy", "selection_objective"
    )


def branch_dropout_rows(
    df: DataFrame, key: str, methods: Sequence[str], rate: float, repeats: int, seed: int, fill: str = "neutral"
) -> DataFrame:
    """The rows plus `repeats` copies with scores masked at `rate`; a row never loses every score.

    The mask comes from a hash of (seed, key, repeat, method), so any partitioning
    gives the same copies.
    """
    if not 0.0 <= rate < 1.0:
        raise ValueError("the dropout rate must be in [0, 1)")
    if fill not in ("neutral", "mean"):
        raise ValueError(f"unknown fill: {fill}")
    first = df.withColumn("repeat", F.lit(0))
    if rate == 0.0 or repeats <= 0:
        return first
    copies = df.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    draw = lambda c: hash_unit(stable_hash(F.concat_ws(":", F.col(key).cast("string"), F.col("repeat"), F.lit(c)), seed))
    drawn = copies.withColumns({f"_u_{c}": draw(c) for c in methods})
    lowest = F.least(*[F.col(f"_u_{c}") for c in methods]) if len(methods) > 1 else F.col(f"_u_{methods[0]}")
    highest = F.greatest(*[F.col(f"_u_{c}") for c in methods]) if len(methods) > 1 else lowest
    # when every score would go, the one with the highest draw stays
    every = highest < rate
    if fill == "mean":
        means = df.agg(F.struct(*[F.avg(c).alias(c) for c in methods]).alias("m")).scalar()
        drawn = drawn.withColumn("_m", means)
        value = lambda c: F.col(f"_m.{c}")
    else:
        value = lambda c: F.lit(0.5)
    masked = drawn.withColumns(
        {
            c: F.when((F.col(f"_u_{c}") < rate) & ~(every & (F.col(f"_u_{c}") == highest)), value(c)).otherwise(F.col(c))
            for c in methods
        }
    )
    return first.unionByName(masked.select(first.columns))


def logistic_fusion(train: DataFrame, methods: Sequence[str], c: float = 0.03) -> ScaledLogistic:
    """Standardised, class-balanced L2 logistic model on the method scores."""
    return fit_scaled_logistic(train, methods, "y_true", c)


def coefficient_table(spark, model: ScaledLogistic) -> DataFrame:
    """Standardised and raw-score coefficients and the intercept; one row per method."""
    scales = [1.0 if s < 1e-12 else s for s in model.scales]
    raw = [w / s for w, s in zip(model.weights, scales)]
    shift = sum(w * mean / s for w, mean, s in zip(model.weights, model.means, scales))
    rows = [(n, float(w), float(r)) for n, w, r in zip(model.features, model.weights, raw)]
    rows.append(("__intercept__", float(model.intercept), float(model.intercept - shift)))
    return spark.createDataFrame(rows, "method string, standardized_coefficient double, raw_score_coefficient double")


def fusion_run(
    train: DataFrame,
    variants: dict[str, DataFrame],
    key: str,
    methods: Sequence[str],
    c: float = 0.03,
    calibrator: str = "none",
    fraction: float = 0.25,
    strategy: str = "source_utility",
    tie_break: str = "near_half",
    seed: int = 7,
    dropout: tuple[float, int] = (0.0, 0),
) -> tuple[DataFrame, DataFrame]:
    """Align, split, fit, calibrate, pick a threshold, and score the training rows and every variant.

    `train` and the variants are long predictions. Returns (metrics per variant, scored rows).
    """
    wide = cut_lineage(align_scores(train, key, methods))
    parts = cut_lineage(calibration_split(wide, key, "y_true", fraction, seed, key))
    fit_rows = parts.where(F.col("split") == "fit").select(wide.columns)
    held = parts.where(F.col("split") == "calibration").select(wide.columns)
    fit_rows = branch_dropout_rows(fit_rows, key, methods, dropout[0], dropout[1], seed)
    model = logistic_fusion(fit_rows, methods, c)
    scored_held = model.score(held, "score")
    apply = fit_calibrator(calibrator, scored_held) if calibrator != "none" else None
    final = lambda rows: (
        rows.withColumn("fake_score", F.col("score")) if apply is None else apply(rows, "score", "fake_score")
    )
    calibrated = final(scored_held).select("y_true", F.col("fake_score").alias("score"))
    counts = candidate_counts(cut_lineage(calibrated), [])
    best = choose(counts, [], objective_column(strategy), tie_break).withColumn("rate", positive_rate())
    limit = best.first()["threshold"]
    out = None
    for name, rows in {"train": wide, **{v: align_scores(p, key, methods) for v, p in variants.items()}}.items():
        one = final(model.score(rows, "score")).select(
            F.lit(name).alias("variant"), key, "y_true", F.col("score").alias("raw_fake_score"), "fake_score"
        )
        out = one if out is None else out.unionByName(one)
    scored = cut_lineage(out)
    plain = scored.withColumnRenamed("fake_score", "score")
    table = m.binary_metrics(plain, ["variant"], limit).join(m.score_stats(plain, ["variant"], limit).drop("n_samples"), "variant")
    return table.withColumn("threshold", F.lit(float(limit))), scored
