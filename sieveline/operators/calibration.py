"""Score calibration: fitted on calibration rows per group, applied to any rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sieveline.functions.scalar import LOGIT_LIMIT, SCORE_EPS, clip, logit, sigmoid
from sieveline.operators.metrics import clipped, histogram, join_groups, running_of, summarise_running
from sieveline.plans.pooling import monotone_pools, surrounding
from sieveline.session import cut_lineage, shuffle_partitions

# The temperature search grid.
GRID_LOW, GRID_HIGH, GRID_POINTS = 0.05, 20.0, 240
FINE_LOW, FINE_HIGH = 0.01, 100.0
CALIBRATORS = (
    "temperature",
    "temperature_balanced",
    "platt",
    "platt_balanced",
    "isotonic",
    "isotonic_balanced",
)


def class_balanced_weights(df: DataFrame, keys: Sequence[str], label: str = "y_true") -> DataFrame:
    """n / (2 n_label) per group and label."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n_label"))
    n = F.sum("n_label").over(Window.partitionBy(*keys))
    return counts.withColumn("weight", n / F.greatest(2.0 * F.col("n_label"), F.lit(1.0)))


def _weighted_histogram(df: DataFrame, keys: Sequence[str], balanced: bool) -> DataFrame:
    """Distinct scores with the summed weight of either label; one row per score however many rows share it.

    `df` is rows with `y_true`, or a histogram with `pos` and `neg`.
    """
    keys = list(keys)
    rows = df.select(*keys, "score", "pos", "neg") if "pos" in df.columns else histogram(df, keys)
    totals = rows.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    both = F.when(
        (F.col("_p") > 0) & (F.col("_n") > 0), F.lit(True)
    ).otherwise(F.raise_error(F.lit("calibration needs both classes")))
    joined = rows.join(totals, keys) if keys else rows.withColumn(
        "_t", totals.select(F.struct("*")).scalar()
    ).select("*", "_t.*").drop("_t")
    n = F.col("_p") + F.col("_n")
    weight = lambda total: n / F.greatest(2.0 * F.col(total), F.lit(1.0)) if balanced else F.lit(1.0)
    return joined.where(both).select(
        *keys,
        "score",
        "pos",
        "neg",
        (F.col("pos") * weight("_p")).alias("w_pos"),
        (F.col("neg") * weight("_n")).alias("w_neg"),
    )


OPEN_GROUPS = 1024
"""Groups whose sums a task holds at once, a grid of numbers each."""


def _grid_losses(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`keys, low, high, losses, weight`: summed loss of all grid points, a partial sum per task and group.

    `rows` has the keys, `logit`, `w_pos`, `w_neg` and the grid's ends `low` and `high`,
    which are those of the group. A batch meets the grid as one matrix in numpy; no
    row is copied per point.
    """
    names = [*keys, "low", "high"]
    schema = T.StructType([rows.schema[n] for n in names])
    schema = schema.add("losses", T.ArrayType(T.DoubleType())).add("weight", "double")
    kinds = to_arrow_schema(schema)
    points = np.arange(GRID_POINTS) / (GRID_POINTS - 1)

    def out(sums: dict) -> pa.RecordBatch:
        heads = list(zip(*sums)) or [()] * len(names)
        columns = [*heads, [v[:-1] for v in sums.values()], [v[-1] for v in sums.values()]]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds.types)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            numbers: dict[tuple, int] = {}
            owners = zip(*[batch.column(n).to_pylist() for n in names])
            group = np.fromiter((numbers.setdefault(o, len(numbers)) for o in owners), np.int64, batch.num_rows)
            value, pos, neg = (batch.column(c).to_numpy() for c in ("logit", "w_pos", "w_neg"))
            for owner, i in numbers.items():
                low, high = np.log(owner[-2]), np.log(owner[-1])
                at = np.flatnonzero(group == i) if len(numbers) > 1 else np.arange(batch.num_rows)
                z = np.clip(value[at, None] / np.exp(low + points * (high - low)), -LOGIT_LIMIT, LOGIT_LIMIT)
                p = np.clip(1.0 / (1.0 + np.exp(-z)), SCORE_EPS, 1.0 - SCORE_EPS)
                part = np.append(-(pos[at] @ np.log(p) + neg[at] @ np.log(1.0 - p)), (pos[at] + neg[at]).sum())
                sums[owner] = sums[owner] + part if owner in sums else part
            if len(sums) > OPEN_GROUPS:
                yield out(sums)
                sums = {}
        if sums:
            yield out(sums)

    return rows.select(*names, "logit", "w_pos", "w_neg").mapInArrow(run, schema)


def _best_point(rows: DataFrame, keys: Sequence[str], low: Column, high: Column) -> DataFrame:
    """Best temperature per group on a log grid from `low` to `high`; the lowest wins a tie."""
    keys = list(keys)
    spaced = rows.select(
        *keys, logit(F.col("score")).alias("logit"), F.col("w_pos").cast("double"), F.col("w_neg").cast("double"), low.alias("low"), high.alias("high")
    )
    parts = _grid_losses(spaced, keys).select(*keys, "low", "high", "weight", F.posexplode("losses").alias("point", "loss"))
    start, end = F.ln("low"), F.ln("high")
    per_point = parts.groupBy(*keys, "low", "high", "point").agg(
        (F.sum("loss") / F.sum("weight")).alias("loss"),
        F.first(F.exp(start + F.col("point") * (end - start) / float(GRID_POINTS - 1))).alias("temperature"),
    )
    return per_point.groupBy(*keys).agg(F.min(F.struct("loss", "point", "temperature")).alias("b"))


def temperature_fit(df: DataFrame, keys: Sequence[str], balanced: bool = False) -> DataFrame:
    """Temperature with the lowest (weighted) log-loss: a log grid, then a finer one around its best point."""
    keys = list(keys)
    # every row meets the whole grid: keep all tasks busy although the histogram itself is small
    tasks = shuffle_partitions(df.sparkSession)
    rows = _weighted_histogram(df, keys, balanced).repartition(tasks, "score")
    coarse = _best_point(rows, keys, F.lit(GRID_LOW), F.lit(GRID_HIGH))
    best = coarse.select(*keys, F.col("b.temperature").alias("_best"))
    # without keys the coarse result is one number
    centred = rows.join(best, keys) if keys else rows.withColumn("_best", F.lit(best.first()["_best"]))
    low = F.greatest(F.col("_best") / 2.0, F.lit(FINE_LOW))
    high = F.least(F.col("_best") * 2.0, F.lit(FINE_HIGH))
    fine = _best_point(centred, keys, low, high)
    return fine.select(*keys, F.col("b.temperature").alias("temperature"), F.col("b.loss").alias("loss"))


def temperature_apply(df: DataFrame, fitted: DataFrame, keys: Sequence[str], score="score", out="calibrated") -> DataFrame:
    keys = list(keys)
    limit = fitted.select(*keys, "temperature")
    joined = df.join(limit, keys) if keys else df.withColumn("temperature", F.lit(limit.first()["temperature"]))
    return joined.withColumn(out, sigmoid(logit(F.col(score)) / F.col("temperature")))


def platt_lines(df: DataFrame, keys: Sequence[str], balanced: bool = False, tolerance: float = 1e-9) -> DataFrame:
    """`slope` and `intercept` of the L2 logistic fit on the logit, for all groups at once.

    Every pass sums loss, gradient and curvature of all groups over their distinct
    scores and makes one Newton step each; a step that does not lower the loss is
    halved. The number of passes follows the slowest group, not the number of groups.
    """
    keys = list(keys)
    by = keys or ["_all"]
    rows = _weighted_histogram(df, keys, balanced).withColumn("_all", F.lit(0))
    rows = cut_lineage(rows.select(*by, logit(F.col("score")).alias("x"), "w_pos", "w_neg"))
    zero = lambda *names: [F.lit(0.0).alias(n) for n in names]
    state = rows.select(*by).distinct().select(
        *by, *zero("slope", "intercept", "d_slope", "d_intercept"), F.lit(1.0).alias("share"), F.lit(float("inf")).alias("loss"), F.lit(False).alias("done")
    )
    state = cut_lineage(state)
    while not state.where(~F.col("done")).isEmpty():
        state = cut_lineage(_newton_step(rows, state, by, tolerance))
    return state.select(*keys, "slope", "intercept")


def _newton_step(rows: DataFrame, state: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """Try each group's step; accept it and find the next direction, or halve it."""
    trial = state.withColumns({f"t_{n}": F.col(n) + F.col("share") * F.col(f"d_{n}") for n in ("slope", "intercept")})
    at = join_groups(rows, trial, by).withColumn("z", F.col("t_slope") * F.col("x") + F.col("t_intercept"))
    w = F.col("w_pos") + F.col("w_neg")
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("z")))
    miss, bend = w * p - F.col("w_pos"), w * p * (1.0 - p)
    soft = F.log1p(F.exp(-F.abs("z")))
    loss = F.col("w_pos") * (soft + F.greatest(-F.col("z"), F.lit(0.0))) + F.col("w_neg") * (soft + F.greatest(F.col("z"), F.lit(0.0)))
    x = F.col("x")
    sums = at.groupBy(*by, *[c for c in trial.columns if c not in by]).agg(
        F.sum(loss).alias("l"),
        F.sum(miss * x).alias("gs"),
        F.sum(miss).alias("gi"),
        F.sum(bend * x * x).alias("ss"),
        F.sum(bend * x).alias("si"),
        F.sum(bend).alias("ii"),
    )
    # the slope alone is held back, by half its square
    total = F.col("l") + F.col("t_slope") * F.col("t_slope") / 2.0
    gs, ss = F.col("gs") + F.col("t_slope"), F.col("ss") + 1.0
    det = ss * F.col("ii") - F.col("si") * F.col("si")
    ds = (F.col("si") * F.col("gi") - F.col("ii") * gs) / det
    di = (F.col("si") * gs - ss * F.col("gi")) / det
    better = total <= F.col("loss") + 1e-12 * F.abs("loss")
    settled = F.greatest(F.abs(ds), F.abs(di)) <= tolerance
    tiny = F.col("share") < 1e-12  # the loss cannot be lowered in doubles any more
    keep = lambda new, old: F.when(F.col("done"), F.col(old)).when(better, new).otherwise(F.col(old))
    return sums.select(
        *by,
        keep(F.col("t_slope"), "slope").alias("slope"),
        keep(F.col("t_intercept"), "intercept").alias("intercept"),
        keep(ds, "d_slope").alias("d_slope"),
        keep(di, "d_intercept").alias("d_intercept"),
        F.when(better, 1.0).otherwise(F.col("share") / 2.0).alias("share"),
        keep(total, "loss").alias("loss"),
        (F.col("done") | (better & settled) | tiny).alias("done"),
    )


def platt_fit(df: DataFrame, balanced: bool = False) -> tuple[float, float]:
    """Slope and intercept of one group."""
    return tuple(platt_lines(df, [], balanced).first())


def platt_apply(df: DataFrame, fitted: tuple[float, float], score="score", out="calibrated") -> DataFrame:
    slope, intercept = fitted
    return df.withColumn(out, 1.0 / (1.0 + F.exp(-(logit(F.col(score)) * slope + intercept))))


def isotonic_edges(df: DataFrame, keys: Sequence[str], balanced: bool = False) -> DataFrame:
    """The monotone fit of every group as points `(keys, x, y)`: both ends of each pool of equal values."""
    keys = list(keys)
    counts = _weighted_histogram(df, keys, balanced).groupBy(*keys, clipped(F.col("score")).alias("score"))
    pools = monotone_pools(counts.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), keys)
    # labels weigh the same, or as if both classes had half of all rows
    group = Window.partitionBy(*keys)
    p, n = F.col("pos").cast("double"), F.col("neg").cast("double")
    if balanced:
        p, n = p / F.sum("pos").over(group), n / F.sum("neg").over(group)
    ends = F.array_distinct(F.array("low", "high"))
    return pools.select(*keys, ends.alias("ends"), (p / (p + n)).alias("y")).select(*keys, F.explode("ends").alias("x"), "y")


def isotonic_apply(df: DataFrame, edges: DataFrame, keys: Sequence[str], score="score", out="calibrated") -> DataFrame:
    """Values of the fit; a line between pools, the outermost values beyond them. Distinct scores are looked up once."""
    keys = list(keys)
    staged = df.withColumn("_s", clipped(F.col(score)))
    found = surrounding(staged.select(*keys, "_s").distinct(), edges, keys, "_s")
    part = (F.col("_s") - F.col("before.x")) / (F.col("after.x") - F.col("before.x"))
    value = (
        F.when(F.col("before").isNull(), F.col("after.y"))
        .when(F.col("after").isNull() | (F.col("before.x") == F.col("after.x")), F.col("before.y"))
        .otherwise(F.col("before.y") + part * (F.col("after.y") - F.col("before.y")))
    )
    found = found.select(*keys, "_s", clip(value, 0.0, 1.0).alias(out))
    return join_groups(staged, found, [*keys, "_s"]).drop("_s")


def calibrated(name: str, calibration: DataFrame, rows: DataFrame, keys: Sequence[str], score="score", out="calibrated") -> DataFrame:
    """`rows` with their scores calibrated by the fits of all groups of `calibration`; `temperature` where there is one."""
    if name not in CALIBRATORS:
        raise ValueError(f"unknown calibrator: {name}")
    keys = list(keys)
    base, balanced = name.removesuffix("_balanced"), name.endswith("_balanced")
    if base == "temperature":
        return temperature_apply(rows, temperature_fit(calibration, keys, balanced), keys, score, out)
    none = F.lit(None).cast("double")
    if base == "platt":
        lines = platt_lines(calibration, keys, balanced)
        joined = join_groups(rows, lines, keys)
        line = logit(F.col(score)) * F.col("slope") + F.col("intercept")
        return joined.withColumn(out, 1.0 / (1.0 + F.exp(-line))).drop("slope", "intercept").withColumn("temperature", none)
    edges = cut_lineage(isotonic_edges(calibration, keys, balanced))
    return isotonic_apply(rows, edges, keys, score, out).withColumn("temperature", none)


def fit_calibrator(name: str, df: DataFrame):
    """Fit by name on one group of calibration rows; returns apply(rows, score, out) -> rows."""
    if name not in CALIBRATORS:
        raise ValueError(f"unknown calibrator: {name}")
    base, balanced = name.removesuffix("_balanced"), name.endswith("_balanced")
    if base == "temperature":
        fitted = temperature_fit(df, [], balanced)
        return lambda rows, score="score", out="calibrated": temperature_apply(rows, fitted, [], score, out)
    if base == "platt":
        line = platt_fit(df, balanced)
        return lambda rows, score="score", out="calibrated": platt_apply(rows, line, score, out)
    edges = cut_lineage(isotonic_edges(df, [], balanced))
    return lambda rows, score="score", out="calibrated": isotonic_apply(rows, edges, [], score, out)


REPORTED = ("accuracy", "f1", "roc_auc", "brier_score", "expected_calibration_error", "maximum_calibration_error")


def calibration_report(
    calibration: DataFrame, test: DataFrame, keys: Sequence[str], names: Sequence[str] = CALIBRATORS
) -> DataFrame:
    """Raw and calibrated metrics of the test rows per group and calibrator, and the change.

    The rows of either side are read once: fits and metrics start from histograms.
    """
    keys = list(keys)
    fit, seen = cut_lineage(histogram(calibration, keys)), cut_lineage(histogram(test, keys))
    parts = [seen.select(*keys, F.lit("raw").alias("calibrator"), F.lit(None).cast("double").alias("temperature"), "score", "pos", "neg")]
    for name in names:
        done = calibrated(name, fit, seen, keys)
        parts.append(done.select(*keys, F.lit(name).alias("calibrator"), "temperature", F.col("calibrated").alias("score"), "pos", "neg"))
    by = [*keys, "calibrator", "temperature"]
    counts = reduce(DataFrame.unionByName, parts).groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    bundle = summarise_running(running_of(cut_lineage(counts), [*keys, "calibrator"]), by)
    rates = {"real_fpr": F.col("fp") / (F.col("fp") + F.col("tn")), "fake_detection": F.col("tp") / (F.col("tp") + F.col("fn"))}
    bundle = bundle.withColumns(rates)
    shown = [*REPORTED, *rates]
    raw = bundle.where(F.col("calibrator") == "raw").select(*keys, F.col("n_samples").alias("test_samples"), *[F.col(c).alias(f"raw_{c}") for c in shown])
    new = bundle.where(F.col("calibrator") != "raw").select(*by, *[F.col(c).alias(f"calibrated_{c}") for c in shown])
    return join_groups(new, raw, keys).withColumns(
        {f"delta_{c}": F.col(f"calibrated_{c}") - F.col(f"raw_{c}") for c in ("accuracy", "brier_score", "expected_calibration_error")}
    )
