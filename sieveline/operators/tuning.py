"""Tuning of the logistic fusion on held-out sources, and evaluation of the chosen configuration.

All configurations are fitted together by a few passes over one table, and their
scores go through one histogram table, where caps and thresholds are settled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.operators import metrics as m
from sieveline.operators.fusion import branch_dropout_rows
from sieveline.operators.manyfits import fit_many, score_many
from sieveline.operators.models import fit_scaled_logistic
from sieveline.operators.runstats import select_best
from sieveline.operators.sampling import key_holdout
from sieveline.operators.thresholds import CAP_SLACK, candidate_counts_of, choose, objective_column, positive_rate
from sieveline.session import cut_lineage

# Weights of the decision utility, and seed offsets of the hold-outs.
WEIGHTS = {"fake_detection": 1.0, "real_clearance": 1.0, "fpr_penalty": 4.0, "miss_penalty": 1.5}
REAL_VALIDATION_OFFSET = 404
SOURCE_OFFSET = 1009
FINAL_OFFSET = 9091
DECISION = (
    "utility",
    "accuracy",
    "precision",
    "recall",
    "f1",
    "roc_auc",
    "brier_score",
    "expected_calibration_error",
    "predicted_positive_rate",
)


@dataclass(frozen=True)
class Dropout:
    label: str = "none"
    rate: float = 0.0
    repeats: int = 0
    fill: str = "neutral"


def caps_column(caps: Sequence[float | None]) -> Column:
    return F.array(*[F.struct(F.lit("none" if c is None else f"{c:g}").alias("cap_name"), F.lit(c).cast("double").alias("cap")) for c in caps])


def capped_thresholds(rows: DataFrame, keys: Sequence[str], caps: Sequence[float | None], tie_break: str = "higher") -> DataFrame:
    """Best utility threshold of `running` rows under every cap."""
    counts = candidate_counts_of(rows, keys).withColumn("_cap", F.explode(caps_column(caps))).select("*", "_cap.*").drop("_cap")
    allowed = counts.where(F.col("cap").isNull() | (positive_rate() <= F.col("cap") + CAP_SLACK))
    best = choose(allowed, [*keys, "cap_name"], objective_column("source_utility", **WEIGHTS), tie_break)
    return best.withColumn("train_positive_rate", positive_rate()).select(
        *keys, "cap_name", "threshold", F.col("objective").alias("train_utility"), "train_positive_rate"
    )


def decision_table(rows: DataFrame, thresholds: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Decision metrics of `running` rows at each threshold of their group."""
    at = rows.join(thresholds.select(*keys, "cap_name", "threshold"), list(keys))
    bundle = m.summarise_running(at, [*by, "cap_name", "threshold"], F.col("threshold"))
    scored = m.utility(bundle, *WEIGHTS.values())
    return scored.select(*by, "cap_name", "threshold", "n_samples", *DECISION)


def _fit(train: DataFrame, key: str, methods: Sequence[str], c: float, dropout: Dropout, seed: int):
    rows = branch_dropout_rows(train, key, methods, dropout.rate, dropout.repeats, seed, dropout.fill)
    return fit_scaled_logistic(rows, methods, "y_true", c)


def holdout_grid(
    source: DataFrame,
    key: str,
    methods: Sequence[str],
    cs: Sequence[float],
    caps: Sequence[float | None],
    sources: Sequence[int],
    seeds: Sequence[int],
    dropouts: Sequence[Dropout] = (Dropout(),),
    fraction: float = 0.5,
    tie_break: str = "higher",
) -> DataFrame:
    """Validation metrics per seed x strength x dropout x cap x held-out source.

    `source` is one row per key with y_true, source_label and a column per method.
    All models are fitted together, and all rows scored by all of them in one pass.
    """
    flagged = source
    for seed in seeds:
        real = key_holdout(source.where("y_true = 0"), key, fraction, seed + REAL_VALIDATION_OFFSET)
        flagged = flagged.join(real.select(key, F.lit(True).alias(f"_v{seed}")), key, "left")
    rows = cut_lineage(flagged.fillna(False, [f"_v{seed}" for seed in seeds]))
    held_out = lambda seed, held: F.col(f"_v{seed}") | ((F.col("y_true") == 1) & (F.col("source_label") == held))
    sets, parts = [], []
    for seed in seeds:
        for held in sources:
            train = rows.where(~F.coalesce(held_out(seed, held), F.lit(False))).select(key, "y_true", *methods)
            for dropout in dropouts:
                copies = branch_dropout_rows(train, key, methods, dropout.rate, dropout.repeats, seed + held * SOURCE_OFFSET, dropout.fill)
                parts.append(copies.select(F.lit(len(sets)).alias("set"), "y_true", *methods))
                sets.append((seed, held, dropout.label))
    models = fit_many(reduce(DataFrame.unionByName, parts), "set", methods, "y_true", cs)
    names = sorted(models)
    flags = [f"_v{seed}" for seed in seeds]
    scored = score_many(rows, [models[n] for n in names], ["y_true", "source_label", *flags])
    told = F.array(*[F.struct(F.lit(float(c)).alias("c"), *_set_columns(sets[n], seeds)) for n, c in names])
    scored = scored.withColumn("_s", F.get(told, F.col("model"))).select("*", "_s.*")
    validation = F.get(F.array(*flags), F.col("seed_at")) | ((F.col("y_true") == 1) & (F.col("source_label") == F.col("heldout_source")))
    scored = scored.withColumn("role", F.when(validation, "validation").otherwise("train"))
    keys = ["seed", "c", "dropout", "heldout_source"]
    running = cut_lineage(m.running(scored, [*keys, "role"]))
    chosen = cut_lineage(capped_thresholds(running.where("role = 'train'").drop("role"), keys, caps, tie_break))
    table = decision_table(running.where("role = 'validation'"), chosen, keys, keys)
    named = table.select(
        *keys, "cap_name", "threshold", F.col("n_samples").alias("validation_samples"), *[F.col(d).alias(f"validation_{d}") for d in DECISION]
    )
    return named.join(chosen.drop("threshold"), [*keys, "cap_name"])


def _set_columns(named: tuple[int, int, str], seeds: Sequence[int]) -> list[Column]:
    seed, held, dropout = named
    return [
        F.lit(int(seed)).alias("seed"),
        F.lit(list(seeds).index(seed)).alias("seed_at"),
        F.lit(int(held)).alias("heldout_source"),
        F.lit(dropout).alias("dropout"),
    ]


def grid_summary(folds: DataFrame) -> DataFrame:
    """Mean and worst-case validation utility per seed and configuration."""
    return folds.groupBy("seed", "c", "dropout", "cap_name").agg(
        F.count(F.lit(1)).alias("n_holdouts"),
        F.avg("validation_utility").alias("validation_utility_mean"),
        F.min("validation_utility").alias("validation_utility_min"),
        F.avg("validation_accuracy").alias("validation_accuracy_mean"),
        F.avg("validation_roc_auc").alias("validation_roc_auc_mean"),
        F.avg("validation_predicted_positive_rate").alias("validation_predicted_positive_rate_mean"),
        F.avg("train_positive_rate").alias("train_positive_rate_mean"),
        F.avg("threshold").alias("threshold_mean"),
    )


def select_config(summary: DataFrame, keys: Sequence[str] = (), mode: str = "mean") -> DataFrame:
    """Best configuration (per cap when `keys` says so) by validation utility."""
    order = [
        F.round(f"validation_utility_{mode}", 12).desc(),
        F.desc("validation_accuracy_mean"),
        F.asc("validation_predicted_positive_rate_mean"),
        F.asc("c"),
        F.asc("dropout"),
    ]
    return select_best(summary, list(keys), order)


def final_evaluation(
    source: DataFrame,
    targets: DataFrame,
    variant: str,
    key: str,
    methods: Sequence[str],
    c: float,
    caps: Sequence[float | None],
    seed: int,
    dropout: Dropout = Dropout(),
    tie_break: str = "higher",
) -> DataFrame:
    """Refit on all source rows, pick the threshold per cap there, and evaluate source and every target variant.

    `targets` carries a `variant` column: tile modes, transforms or a single 'target'.
    """
    model = _fit(source.select(key, "y_true", *methods), key, methods, c, dropout, seed + FINAL_OFFSET)
    both = source.withColumn(variant, F.lit("source")).select(variant, "y_true", *methods).unionByName(
        targets.select(variant, "y_true", *methods)
    )
    running = cut_lineage(m.running(model.score(both), [variant]))
    own = running.where(F.col(variant) == "source")
    limits = capped_thresholds(own.drop(variant), [], caps, tie_break).select(F.lit("all").alias("_all"), "*")
    limits = cut_lineage(limits)
    at = running.withColumn("_all", F.lit("all"))
    table = decision_table(at, limits, ["_all"], [variant])
    return table.join(limits.select("cap_name", "train_utility", "train_positive_rate"), "cap_name")


def cap_sweep(
    source: DataFrame,
    targets: DataFrame,
    variant: str,
    key: str,
    methods: Sequence[str],
    cs: Sequence[float],
    caps: Sequence[float | None],
    sources: Sequence[int],
    seeds: Sequence[int],
    dropouts: Sequence[Dropout] = (Dropout(),),
    mode: str = "min",
    tie_break: str = "higher",
) -> DataFrame:
    """Per seed and cap the best configuration on held-out sources, refitted on all source rows and evaluated on the targets.

    The chosen models are fitted together too: jobs do not grow with seeds and caps.
    """
    folds = holdout_grid(source, key, methods, cs, caps, sources, seeds, dropouts, tie_break=tie_break)
    # one row per seed and cap: the caller's lists bound it
    chosen = select_config(grid_summary(folds), ["seed", "cap_name"], mode).select("seed", "cap_name", "c", "dropout").collect()
    of_label = {d.label: d for d in dropouts}
    sets = sorted({(r["seed"], r["dropout"]) for r in chosen})
    parts = []
    for i, (seed, label) in enumerate(sets):
        d = of_label[label]
        rows = branch_dropout_rows(source.select(key, "y_true", *methods), key, methods, d.rate, d.repeats, seed + FINAL_OFFSET, d.fill)
        parts.append(rows.select(F.lit(i).alias("set"), "y_true", *methods))
    models = fit_many(reduce(DataFrame.unionByName, parts), "set", methods, "y_true", sorted({r["c"] for r in chosen}))
    picked = [models[sets.index((r["seed"], r["dropout"])), r["c"]] for r in chosen]
    both = source.withColumn(variant, F.lit("source")).select(variant, "y_true", *methods).unionByName(
        targets.select(variant, "y_true", *methods)
    )
    running = cut_lineage(m.running(score_many(both, picked, [variant, "y_true"]), ["model", variant]))
    limits = capped_thresholds(running.where(F.col(variant) == "source").drop(variant), ["model"], caps, tie_break)
    named = [F.struct(*[F.lit(r[c]).alias(c) for c in ("seed", "cap_name", "c", "dropout")]) for r in chosen]
    limits = limits.withColumn("_s", F.get(F.array(*named), F.col("model"))).where(F.col("_s.cap_name") == F.col("cap_name"))
    limits = cut_lineage(limits.select("*", "_s.seed", "_s.c", "_s.dropout").drop("_s"))
    table = decision_table(running, limits, ["model"], ["model", variant])
    return table.join(limits.select("model", "seed", "c", "dropout", "train_utility", "train_positive_rate"), "model").drop("model")
