"""Held-out-source grids that fit models. Two domains by path hash; every row is in one of them."""

from pyspark.sql import functions as F

from sieveline.operators import joins as j, tuning as tu
from sieveline.session import cut_lineage
from sieveline.suite.registry import case

METHODS = ["alpha", "beta", "gamma"]
CS, CAPS, SOURCES, SEEDS = [1.0, 0.3, 0.1, 0.03, 0.01], [None, 0.48], [1, 2, 3, 4, 5], [7, 17, 29]
DROPOUTS = [tu.Dropout(), tu.Dropout("mean0p35x8", 0.35, 8, "mean")]


def domains(t):
    w = t.predictions_wide.select(
        "id", "path", "y_true", "source_label", F.col("s1").alias("alpha"), F.col("s2").alias("beta"), F.col("s3").alias("gamma")
    )
    flagged = w.withColumn("domain", F.when(F.substring(F.sha2("path", 256), 1, 1) < "8", "source").otherwise("target"))
    rows = cut_lineage(flagged)
    return rows.where("domain = 'source'"), rows.where("domain = 'target'")


@case("q_E07_holdout_tuning_grid")
def _(t):
    source, _ = domains(t)
    return tu.holdout_grid(source, "path", METHODS, CS, CAPS, SOURCES, SEEDS, DROPOUTS)


@case("q_E08_final_config_eval")
def _(t):
    source, target = domains(t)
    return tu.final_evaluation(source, target.withColumn("variant", F.lit("target")), "variant", "path", METHODS, 0.03, CAPS, 7)


@case("q_E09_cap_constraint_sweep")
def _(t):
    source, target = domains(t)
    return tu.cap_sweep(source, target.withColumn("variant", F.lit("target")), "variant", "path", METHODS, CS, CAPS, SOURCES, SEEDS, DROPOUTS)


@case("q_E10_tiled_fusion_eval")
def _(t):
    source, target = domains(t)
    detail = target.select(
        "id", "y_true", F.greatest("alpha", "beta").alias("tile_max"), ((F.col("alpha") + F.col("beta")) / 2).alias("tile_mean")
    )
    modes = [target.withColumn("variant", F.lit("global"))] + [
        j.replace_by_key(target, detail, "id", "alpha", score).withColumn("variant", F.lit(score)) for score in ("tile_max", "tile_mean")
    ]
    stacked = modes[0].unionByName(modes[1]).unionByName(modes[2])
    return tu.final_evaluation(source, stacked, "variant", "path", METHODS, 0.03, [None], 7)


@case("q_E11_robust_fusion_eval")
def _(t):
    source, target = domains(t)
    shift = {"clean": lambda c: F.col(c), "dimmed": lambda c: F.col(c) * 0.9, "squared": lambda c: F.col(c) * F.col(c)}
    stacked = None
    for name, change in shift.items():
        one = target.withColumns({c: change(c) for c in METHODS}).withColumn("variant", F.lit(name))
        stacked = one if stacked is None else stacked.unionByName(one)
    return tu.final_evaluation(source, stacked, "variant", "path", METHODS, 0.03, [None, 0.5], 7)
