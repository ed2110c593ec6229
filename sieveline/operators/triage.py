"""Three-way decisions: clear as real, call fake, or leave undecided.

Limits are order statistics of the calibration scores, read off the running counts.
A limit is a score and a `strict` flag; strict stands for the next number above
(fake side) or below (real side), which has no name in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.operators.calibration import CALIBRATORS, calibrated
from sieveline.operators.metrics import ratio, running_of
from sieveline.operators.runstats import select_best
from sieveline.session import cut_lineage

LIMITS = ["real_threshold", "real_strict", "fake_threshold", "fake_strict"]


def limit_grid(max_real_fpr: Sequence[float], max_fake_clearance: Sequence[float]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(float(f)).alias("max_real_fpr"), F.lit(float(c)).alias("max_fake_clearance"))
            for f in max_real_fpr
            for c in max_fake_clearance
        ]
    )


def triage_thresholds(rows: DataFrame, keys: Sequence[str], grid: Column) -> DataFrame:
    """Both limits per group and grid point from `running` rows (both classes present)."""
    keys = list(keys)
    at = rows.withColumn("_grid", F.explode(grid)).select("*", "_grid.*").drop("_grid")
    calls = F.floor(F.col("max_real_fpr") * F.col("neg_all"))
    clears = F.floor(F.col("max_fake_clearance") * F.col("pos_all"))
    # the place in sorted order the limit sits at; with nothing allowed, the outermost score
    fake_place = F.when(calls <= 0, F.col("neg_all") - 1).otherwise(F.greatest(F.col("neg_all") - calls, F.lit(0)))
    real_place = F.when(clears <= 0, F.lit(0)).otherwise(F.least(clears, F.col("pos_all")) - 1)
    holds = lambda c, place: (F.col(f"{c}_below") <= place) & (place < F.col(f"{c}_below") + F.col(c))
    fake = F.max(F.when(holds("neg", fake_place), F.col("score")))
    real = F.max(F.when(holds("pos", real_place), F.col("score")))
    limits = at.groupBy(*keys, "max_real_fpr", "max_fake_clearance").agg(
        real.alias("_r"),
        fake.alias("_f"),
        F.max(clears <= 0).alias("_r_none"),
        F.max(calls <= 0).alias("_f_none"),
    )
    r, f = F.coalesce("_r", F.lit(0.0)), F.coalesce("_f", F.lit(1.0))
    # beyond 0 and 1 there is no next number, and an empty class leaves the limit at the end
    r_strict = F.col("_r").isNotNull() & F.col("_r_none") & (F.col("_r") > 0.0)
    f_strict = F.col("_f").isNotNull() & F.col("_f_none") & (F.col("_f") < 1.0)
    crossed = F.when(r_strict | f_strict, r > f).otherwise(r >= f)
    return limits.select(
        *keys,
        "max_real_fpr",
        "max_fake_clearance",
        F.when(crossed, f).otherwise(r).alias("real_threshold"),
        F.when(crossed, ~f_strict & (f > 0.0)).otherwise(r_strict).alias("real_strict"),
        f.alias("fake_threshold"),
        f_strict.alias("fake_strict"),
    )


def triage_from_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Triage rates from histogram rows that carry their limits."""
    s = F.col("score")
    is_real = F.when(F.col("real_strict"), s < F.col("real_threshold")).otherwise(s <= F.col("real_threshold"))
    is_fake = F.when(F.col("fake_strict"), s > F.col("fake_threshold")).otherwise(s >= F.col("fake_threshold"))
    total = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0))
    sums = counts.groupBy(*by).agg(
        F.sum("pos").alias("_p"),
        F.sum("neg").alias("_n"),
        total(is_real, "neg").alias("_rr"),
        total(is_real, "pos").alias("_rf"),
        total(is_fake, "neg").alias("_fr"),
        total(is_fake, "pos").alias("_ff"),
        total(is_real | is_fake, "neg").alias("_dn"),
        total(is_real | is_fake, "pos").alias("_dp"),
    )
    p, n, rr, rf, fr, ff = (F.col(c) for c in ("_p", "_n", "_rr", "_rf", "_fr", "_ff"))
    decided, every = F.col("_dn") + F.col("_dp"), p + n
    one = lambda c: F.greatest(c, F.lit(1))
    return sums.select(
        *by,
        every.alias("samples"),
        ratio(decided, every, None).alias("coverage"),
        ratio(every - decided, every, None).alias("uncertain_rate"),
        ratio(rr + ff, decided, None).alias("triage_accuracy"),
        ratio(fr + ff, every, None).alias("fake_call_rate"),
        ratio(rr + rf, every, None).alias("real_call_rate"),
        ratio(ff, fr + ff, None).alias("fake_precision"),
        ratio(rr, rr + rf, None).alias("real_precision"),
        ratio(fr, one(n)).alias("real_fpr"),
        ratio(rf, one(p)).alias("fake_false_clearance"),
        ratio(ff, one(p)).alias("fake_detection"),
        ratio(rr, one(n)).alias("real_clearance"),
    )


MODES = ("raw", *CALIBRATORS)


def with_score_modes(folds: DataFrame, keys: Sequence[str], modes: Sequence[str] = MODES) -> DataFrame:
    """Fold histograms under every score mode, each fitted on the calibration parts of all folds at once."""
    keys = list(keys)
    unknown = set(modes) - set(MODES)
    if unknown:
        raise ValueError(f"unknown score modes: {sorted(unknown)}")
    part = folds.where(F.col("role") == "calibration")
    done = []
    for mode in modes:
        if mode == "raw":
            one = folds.withColumn("temperature", F.lit(None).cast("double"))
        else:
            one = calibrated(mode, part, folds, keys, out="_new").drop("score").withColumnRenamed("_new", "score")
        done.append(one.select(*keys, F.lit(mode).alias("score_mode"), "temperature", "role", "score", "pos", "neg"))
    # a transform may map two scores onto one number
    counts = reduce(DataFrame.unionByName, done).groupBy(*keys, "score_mode", "temperature", "role", "score").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    return cut_lineage(counts)


def triage_report(
    folds: DataFrame, keys: Sequence[str], modes: Sequence[str], grid: Column
) -> DataFrame:
    """Calibration and test triage rates per fold, score mode and grid point. `keys` include the fold."""
    by = [*keys, "score_mode"]
    scored = with_score_modes(folds, keys, modes)
    limits = triage_thresholds(running_of(scored.where(F.col("role") == "calibration"), by), by, grid)
    point = ["max_real_fpr", "max_fake_clearance"]
    temperatures = scored.select(*by, "temperature").distinct()
    rows = scored.join(limits, by)
    rates = triage_from_counts(rows, [*by, *point, *LIMITS, "role"])
    names = [c for c in rates.columns if c not in (*by, *point, *LIMITS, "role")]
    pick = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c))).alias(f"{role}_{c}")
    wide = rates.groupBy(*by, *point, *LIMITS).agg(*[pick(r, c) for r in ("calibration", "test") for c in names])
    return wide.join(temperatures, by)


def triage_utility(part: str, w_detect=1.0, w_clear=1.0, p_fpr=4.0, p_miss=1.5) -> Column:
    c = lambda n: F.col(f"{part}_{n}")
    return (
        w_detect * c("fake_detection")
        + w_clear * c("real_clearance")
        - p_fpr * c("real_fpr")
        - p_miss * c("fake_false_clearance")
    )


def triage_tuning(report: DataFrame, keys: Sequence[str], **weights) -> DataFrame:
    """Per fold the mode and grid point with the best calibration utility."""
    scored = report.withColumns(
        {f"{part}_utility": triage_utility(part, **weights) for part in ("calibration", "test")}
    )
    # utilities are sums of a few ratios: equal ones must tie whatever the order of addition
    shown = F.round("calibration_utility", 12)
    order = [
        shown.desc(),
        F.desc("calibration_coverage"),
        F.desc("calibration_triage_accuracy"),
        F.asc("max_real_fpr"),
        F.asc("max_fake_clearance"),
        F.asc("score_mode"),
    ]
    return select_best(scored, keys, order)
