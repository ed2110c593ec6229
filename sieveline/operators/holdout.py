"""Held-out-source evaluation and model choice.

A fold holds out one fake source: it calibrates on the training reals and the other
fakes and tests on the held-out reals and that source. Everything starts from one
score histogram per slice; a fold is the sum of all slices less its own.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sieveline.operators.metrics import confusion, join_groups, ratio, utility
from sieveline.operators.runstats import bootstrap_mean_ci, chosen_list, seed_summary, select_best
from sieveline.operators.sampling import key_holdout
from sieveline.operators.thresholds import ARRAY_OBJECTIVES, FIXED_CANDIDATES, objective_column
from sieveline.plans.ordered import running_sums, with_bucket
from sieveline.plans.pooling import surrounding
from sieveline.session import cut_lineage


def with_real_part(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Add `held_out_real`: real rows whose key is in the seeded hold-out of unique real keys."""
    held = key_holdout(df.where(F.col("y_true") == 0), key, fraction, seed).withColumn("_held", F.lit(True))
    return df.join(held, key, "left").withColumn(
        "held_out_real", F.coalesce("_held", F.lit(False)) & (F.col("y_true") == 0)
    ).drop("_held")


def slice_histogram(df: DataFrame, keys: Sequence[str], source: str, score: str = "score") -> DataFrame:
    """Counts per distinct score of every (source, real part), written once: all folds start from it."""
    counts = df.groupBy(*keys, F.col(source).alias("source"), "held_out_real", F.col(score).alias("score")).agg(
        F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") == 0).alias("neg")
    )
    return cut_lineage(counts)


def fold_histogram(slices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`keys, fold, role, score, pos, neg` for every held-out source; `role` is calibration or test.

    Only for work that gives each fold scores of its own, as fitted score modes do.
    """
    keys = list(keys)
    sources = slices.where(F.col("pos") > 0).agg(F.array_sort(F.collect_set("source")).alias("s")).scalar()
    rows = slices.withColumn("fold", F.explode(sources))
    own = (F.col("pos") > 0) & (F.col("source") == F.col("fold"))
    test = F.col("held_out_real") | own
    return (
        rows.withColumn("role", F.when(test, "test").otherwise("calibration"))
        .groupBy(*keys, "fold", "role", "score")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )


def usable_folds(folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop folds where a part lacks a class, as the evaluation cannot use them."""
    keys = [*keys, "fold"]
    sizes = folds.groupBy(*keys, "role").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    good = sizes.where((F.col("p") > 0) & (F.col("n") > 0)).groupBy(*keys).agg(F.count(F.lit(1)).alias("parts"))
    return cut_lineage(folds.join(good.where("parts = 2").select(*keys), keys))


def fold_sizes(slices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of either class in both parts of every usable fold: totals, and totals without the fold's own source.

    Fakes without a source are never held out.
    """
    keys = list(keys)
    real = lambda held: F.sum(F.when(F.col("held_out_real") == held, F.col("neg")).otherwise(0))
    totals = slices.groupBy(*keys).agg(real(False).alias("calibration_real"), real(True).alias("test_real"), F.sum("pos").alias("_all"))
    own = slices.where(F.col("pos") > 0).groupBy(*keys, F.col("source").alias("fold")).agg(F.sum("pos").alias("test_fake"))
    sizes = join_groups(own.where(F.col("fold").isNotNull()), totals, keys).select(
        *keys, "fold", "calibration_real", (F.col("_all") - F.col("test_fake")).alias("calibration_fake"), "test_real", "test_fake"
    )
    return sizes.where((F.col("calibration_real") > 0) & (F.col("calibration_fake") > 0) & (F.col("test_real") > 0))


FOLD_CELLS = 1 << 21
"""Scores times sources looked at in one step of a task."""

_ROLES = ("calibration", "test")
_BEST = "role string, cost double, tie double, threshold double, tn long, fn long, auc double"


def best_of_folds(slices: DataFrame, keys: Sequence[str], objective: str = "accuracy") -> DataFrame:
    """The best candidate threshold of both parts of every fold: `keys, fold, role, threshold, tn, fn, neg, pos` and `concordant`.

    A fold's counts below a score are those of all sources less its own, so no
    row is copied per fold: the order is cut into buckets, every bucket starts from
    what lies below it (one number per source), and evaluates all folds at its scores.
    `concordant` counts pairs of a test real below a test fake, ties half.
    """
    if objective not in ARRAY_OBJECTIVES:
        raise ValueError(f"no array form of the objective: {objective}")
    keys = list(keys)
    held = F.col("held_out_real")
    rows = with_bucket(slices, F.col("score")).select(
        *keys,
        F.col("bucket").cast("int").alias("bucket"),
        "source",
        F.col("score").cast("double").alias("score"),
        F.when(held, 0).otherwise(F.col("neg")).alias("train"),
        F.when(held, F.col("neg")).otherwise(0).alias("held"),
        "pos",
    )
    last = lambda c: F.max(F.when(F.col(c) > 0, F.col("score"))).alias(f"{c}_last")
    parts = rows.groupBy(*keys, "bucket", "source").agg(
        *[F.sum(c).alias(c) for c in ("train", "held", "pos")], *[last(c) for c in ("train", "held", "pos")]
    )
    source_kind = rows.schema["source"].dataType
    below = T.StructType([*[parts.schema[k] for k in keys], T.StructField("bucket", T.IntegerType())])
    below = below.add("sources", T.ArrayType(source_kind)).add("before", T.ArrayType(T.LongType())).add("last", T.ArrayType(T.DoubleType()))
    below = below.add("all", T.ArrayType(T.LongType()))
    below_kinds = to_arrow_schema(below)

    def starts(table: pa.Table) -> pa.Table:
        return _below(keys, below_kinds, table)

    start = parts.groupBy(*(keys or [F.lit("all")])).applyInArrow(starts, below)

    best = T.StructType([parts.schema[k] for k in keys]).add("fold", source_kind)
    for field in T.StructType.fromDDL(_BEST).fields:
        best = best.add(field)
    best_kinds = to_arrow_schema(best)

    def evaluate(table: pa.Table, first: pa.Table) -> pa.Table:
        return _evaluate(keys, objective, best_kinds, table, first)

    by = [*keys, "bucket"]
    found = rows.groupBy(*by).cogroup(start.groupBy(*by)).applyInArrow(evaluate, best)
    found = found.unionByName(_fixed_candidates(slices, keys, objective).select(found.columns))
    picked = found.groupBy(*keys, "fold", "role").agg(F.min(F.struct("cost", "tie", "threshold", "tn", "fn")).alias("b"), F.sum("auc").alias("concordant"))
    return picked.select(*keys, "fold", "role", "b.threshold", "b.tn", "b.fn", "concordant")


def _below(keys: list[str], kinds: pa.Schema, table: pa.Table) -> pa.Table:
    """What lies below every bucket of a group: counts and last scores, of training reals, held-out reals and each source."""
    table = table.sort_by("bucket")
    names = sorted(set(table.column("source").to_pylist()), key=lambda v: (v is not None, v))
    place = {v: i + 2 for i, v in enumerate(names)}  # after the two real parts
    before, last = np.zeros(len(names) + 2, np.int64), np.full(len(names) + 2, -np.inf)
    buckets, counts, lasts = [], [], []
    cells = table.select(["bucket", "source", "train", "held", "pos", "train_last", "held_last", "pos_last"]).to_pylist()
    for cell in cells:
        if not buckets or buckets[-1] != cell["bucket"]:
            buckets.append(cell["bucket"])
            counts.append(before.copy())
            lasts.append(last.copy())
        for at, c in ((0, "train"), (1, "held"), (place[cell["source"]], "pos")):
            before[at] += cell[c]
            if cell[f"{c}_last"] is not None:
                last[at] = max(last[at], cell[f"{c}_last"])
    n = len(buckets)
    same = {k: pa.repeat(table.column(k)[0], n) for k in keys}
    columns = {"bucket": buckets, "sources": [names] * n, "before": counts, "last": lasts, "all": [before] * n}
    return pa.table([same[f.name] if f.name in same else pa.array(columns[f.name], f.type) for f in kinds], schema=kinds)


def _others_most(values: np.ndarray) -> np.ndarray:
    """For every place the highest of the other values."""
    if len(values) < 2:
        return np.full(len(values), -np.inf)
    top = np.argsort(values)[-2:]
    out = np.full(len(values), values[top[1]])
    out[top[1]] = values[top[0]]
    return out


def _evaluate(keys: list[str], objective: str, kinds: pa.Schema, rows: pa.Table, start: pa.Table) -> pa.Table:
    """Best candidates of one bucket, for both parts of all folds."""
    names = start.column("sources")[0].as_py()
    before, last, total = (np.array(start.column(c)[0].as_py()) for c in ("before", "last", "all"))
    f = len(names)
    place = {v: i for i, v in enumerate(names)}
    rows = rows.sort_by("score")
    scores, at = np.unique(rows.column("score").to_numpy(), return_inverse=True)
    source = np.array([place[v] for v in rows.column("source").to_pylist()])
    train, held, pos = (rows.column(c).to_numpy() for c in ("train", "held", "pos"))
    measure, found = ARRAY_OBJECTIVES[objective], {r: [] for r in _ROLES}
    auc = np.zeros(f)
    real_below, own_below = before[:2].copy(), before[2:].copy()
    last = {"calibration": np.maximum(last[0], _others_most(last[2:])), "test": np.maximum(last[1], last[2:])}
    step = max(1, FOLD_CELLS // f)
    for low in range(0, len(scores), step):
        here = scores[low : low + step, None]
        own, real = np.zeros((len(here), f), np.int64), np.zeros((len(here), 2), np.int64)
        inside = (at >= low) & (at < low + step)
        where = at[inside] - low
        np.add.at(own, (where, source[inside]), pos[inside])
        np.add.at(real, (where, 0), train[inside])
        np.add.at(real, (where, 1), held[inside])
        own_at, real_at = own_below + np.cumsum(own, 0) - own, real_below + np.cumsum(real, 0) - real
        others_at, others = own_at.sum(1, keepdims=True) - own_at, own.sum(1, keepdims=True) - own
        auc += (own * (real_at[:, 1:] + real[:, 1:] / 2.0)).sum(0)
        sides = {
            "calibration": (real_at[:, :1], others_at, (real[:, :1] > 0) | (others > 0), total[0], total[2:].sum() - total[2:]),
            "test": (real_at[:, 1:], own_at, (real[:, 1:] > 0) | (own > 0), total[1], total[2:]),
        }
        for role, (tn, fn, there, neg, positives) in sides.items():
            marks = np.where(there, here, -np.inf)
            upto = np.maximum.accumulate(np.vstack([last[role], marks]), 0)
            middle = (upto[:-1] + here) / 2.0
            middle[~there | ~np.isfinite(upto[:-1]) | (middle <= upto[:-1])] = np.inf
            last[role] = upto[-1]
            tn = np.broadcast_to(tn, fn.shape)
            with np.errstate(divide="ignore", invalid="ignore"):
                value = np.where(there, measure(tn * 1.0, neg - tn * 1.0, fn * 1.0, positives - fn * 1.0), -np.inf)
            most = value.max(0)
            # a midpoint and the score above it have the same counts: the nearer to one half, then the lower
            both, equal = np.stack([np.broadcast_to(here, fn.shape), middle]), (value == most) & there
            tie = np.where(equal & np.isfinite(both), np.abs(both - 0.5), np.inf)
            least = tie.min((0, 1))
            threshold = np.where(tie == least, both, np.inf)
            flat = threshold.reshape(-1, f).argmin(0)
            score = flat % len(here)
            column = np.arange(f)
            found[role].append((-most, least, threshold.reshape(-1, f)[flat, column], tn[score, column], fn[score, column], there.any(0)))
        own_below, real_below = own_below + own.sum(0), real_below + real.sum(0)
    out = {c: [] for c in ("fold", *(x.split()[0] for x in _BEST.split(", ")))}
    usable = (total[0] > 0) & (total[1] > 0) & (total[2:] > 0) & (total[2:].sum() > total[2:])
    usable &= np.array([v is not None for v in names])
    for role, chunks in found.items():
        for n, (cost, tie, threshold, tn, fn, any_there) in enumerate(chunks):
            for i in np.flatnonzero(usable & any_there):
                out["fold"].append(names[i])
                out["role"].append(role)
                for c, v in zip(("cost", "tie", "threshold", "tn", "fn"), (cost, tie, threshold, tn, fn)):
                    out[c].append(v[i].item())
                out["auc"].append(0.0)
    for i in np.flatnonzero(usable):
        if auc[i]:  # a row of its own, worse than any candidate
            for c, v in (("fold", names[i]), ("role", "test"), ("cost", np.inf), ("tie", 0.0), ("threshold", 0.0), ("tn", 0), ("fn", 0), ("auc", auc[i])):
                out[c].append(v)
    n = len(out["fold"])
    same = {k: pa.repeat(rows.column(k)[0], n) for k in keys}
    return pa.table([same[x.name] if x.name in same else pa.array(out[x.name], x.type) for x in kinds], schema=kinds)


def _fixed_candidates(slices: DataFrame, keys: list[str], objective: str) -> DataFrame:
    """The thresholds 0, 1/2 and 1 of both parts of every usable fold as candidates."""
    lower = lambda c, t, where=F.lit(True): F.sum(F.when((F.col("score") < t) & where, F.col(c)).otherwise(0))
    held = F.col("held_out_real")
    totals = slices.groupBy(*keys).agg(
        *[lower("neg", t, ~held).alias(f"train{i}") for i, t in enumerate(FIXED_CANDIDATES)],
        *[lower("neg", t, held).alias(f"held{i}") for i, t in enumerate(FIXED_CANDIDATES)],
        *[lower("pos", t).alias(f"all{i}") for i, t in enumerate(FIXED_CANDIDATES)],
    )
    own = slices.where(F.col("pos") > 0).groupBy(*keys, F.col("source").alias("fold")).agg(
        *[lower("pos", t).alias(f"own{i}") for i, t in enumerate(FIXED_CANDIDATES)]
    )
    known = join_groups(join_groups(own, totals, keys), fold_sizes(slices, keys), [*keys, "fold"])
    points = []
    for i, t in enumerate(FIXED_CANDIDATES):
        for role, tn, fn in (("calibration", f"train{i}", F.col(f"all{i}") - F.col(f"own{i}")), ("test", f"held{i}", F.col(f"own{i}"))):
            neg, pos = F.col(f"{role}_real"), F.col(f"{role}_fake")
            points.append(
                F.struct(
                    F.lit(role).alias("role"), F.lit(t).alias("threshold"), F.col(tn).alias("tn"), (neg - F.col(tn)).alias("fp"), fn.alias("fn"), (pos - fn).alias("tp")
                )
            )
    rows = known.select(*keys, "fold", F.explode(F.array(*points)).alias("p")).select(*keys, "fold", "p.*")
    return rows.withColumns(
        {"cost": -objective_column(objective), "tie": F.abs(F.col("threshold") - 0.5), "auc": F.lit(0.0)}
    )


def holdout_report(slices: DataFrame, keys: Sequence[str], objective: str = "accuracy", default: float = 0.5) -> DataFrame:
    """Per fold: test metrics at the default, the calibrated and the best possible threshold. `slices` is a slice histogram."""
    keys = list(keys)
    by = [*keys, "fold"]
    best = cut_lineage(best_of_folds(slices, keys, objective))
    sizes = fold_sizes(slices, keys)
    at = best.groupBy(*by).pivot("role", list(_ROLES)).agg(
        F.first("threshold").alias("threshold"), F.first("tn").alias("tn"), F.first("fn").alias("fn"), F.first("concordant").alias("concordant")
    )
    known = cut_lineage(join_groups(at, sizes, by))
    # a fold's own fakes meet its threshold; its reals are the same for all folds and are looked up in one order
    own = slices.where(F.col("pos") > 0).withColumnRenamed("source", "fold").join(known.select(*by, F.col("calibration_threshold").alias("_t")), by)
    hit = lambda limit: F.sum(F.when(F.col("score") >= limit, F.col("pos")).otherwise(0))
    fakes = own.groupBy(*by).agg(hit(F.lit(default)).alias("_dtp"), hit(F.col("_t")).alias("_stp"))
    held = slices.where(F.col("held_out_real")).groupBy(*keys, F.col("score").cast("double").alias("x")).agg(F.sum("neg").alias("neg"))
    held = cut_lineage(running_sums(held, keys, "x", ["neg"]).select(*keys, "x", "neg_below"))
    limits = known.select(*by, F.explode(F.array(F.struct(F.lit("s").alias("at"), F.col("calibration_threshold").alias("t")), F.struct(F.lit("d").alias("at"), F.lit(float(default)).alias("t")))).alias("l"))
    met = surrounding(limits.select(*by, "l.*"), held, keys, "t")
    reals = met.groupBy(*by).agg(*[F.max(F.when(F.col("at") == tag, F.col("after.neg_below"))).alias(f"_{tag}tn") for tag in "sd"])
    rows = join_groups(join_groups(known, fakes, by), reals, by)
    neg, pos = F.col("test_real"), F.col("test_fake")
    out = {}
    for tag, name in (("d", "default"), ("s", "source_threshold")):
        tp, tn = F.col(f"_{tag}tp"), F.coalesce(F.col(f"_{tag}tn"), neg)  # no real at or above the threshold: all lie below
        out[f"{name}_accuracy"] = ratio(tp + tn, neg + pos)
        out[f"{name}_f1"] = ratio(2 * tp, tp + neg - tn + pos)
        if tag == "s":
            out["real_fpr"], out["fake_detection"] = ratio(neg - tn, neg, None), ratio(tp, pos, None)
    cal_tp, test_tp = F.col("calibration_fake") - F.col("calibration_fn"), pos - F.col("test_fn")
    out["calibration_accuracy"] = ratio(cal_tp + F.col("calibration_tn"), F.col("calibration_real") + F.col("calibration_fake"))
    out["oracle_accuracy"] = ratio(test_tp + F.col("test_tn"), neg + pos)
    out["oracle_f1"] = ratio(2 * test_tp, test_tp + neg - F.col("test_tn") + pos)
    out["roc_auc"] = F.col("test_concordant") / (neg.cast("double") * pos)
    names = {"calibration_threshold": "source_threshold", "test_threshold": "oracle_threshold"}
    return rows.withColumns(out).select(
        *by, *[F.col(c).alias(n) for c, n in names.items()], "test_real", "test_fake", *out
    )


def holdout_summary(report: DataFrame, keys: Sequence[str], metrics: Sequence[str], seed: int = 0) -> DataFrame:
    """Mean and bootstrap interval over the folds per group, long form."""
    return bootstrap_mean_ci(report, keys, metrics, seed)


DECISION = ["utility", "accuracy", "precision", "recall", "specificity", "real_fpr", "fake_miss_rate", "predicted_positive_rate"]


def candidate_metrics(source: DataFrame, target: DataFrame, thresholds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source utility and target metrics of every candidate run at its threshold."""
    keys = list(keys)

    def side(df: DataFrame, prefix: str) -> DataFrame:
        counts = confusion(df.join(thresholds.select(*keys, "threshold"), keys), [*keys, "threshold"], F.col("threshold"))
        return utility(counts).select(*keys, *[F.col(c).alias(f"{prefix}_{c}") for c in DECISION])

    return thresholds.select(*keys, "threshold").join(side(source, "source"), keys).join(side(target, "target"), keys)


def candidate_holdouts(source: DataFrame, thresholds: DataFrame, keys: Sequence[str], label: str = "source_label") -> DataFrame:
    """Utility of every candidate run on the reals plus one fake source, for each source.

    Confusion cells per source are added up; no row is read once per fold.
    """
    keys = list(keys)
    rows = source.join(thresholds.select(*keys, "threshold"), keys)
    cells = confusion(rows.withColumn("_s", F.when(F.col("y_true") == 1, F.col(label))), [*keys, "threshold", "_s"], F.col("threshold"))
    real = cells.where(F.col("_s").isNull()).select(*keys, F.col("tn").alias("_tn"), F.col("fp").alias("_fp"))
    fake = cells.where(F.col("_s").isNotNull())
    folds = fake.join(real, keys).select(
        *keys, "threshold", F.col("_s").alias("heldout_source"), F.col("_tn").alias("tn"), F.col("_fp").alias("fp"), "fn", "tp"
    )
    return utility(folds).select(
        *keys, "threshold", "heldout_source", *[F.col(c).alias(f"holdout_{c}") for c in DECISION], F.col("n_samples").alias("holdout_n_samples")
    )


CAP_SLACK = 1e-12


def choose_candidates(
    folds: DataFrame, runs: DataFrame, candidate: str, mode: str = "mean", cap: float | None = None
) -> DataFrame:
    """Per seed the candidate with the best mean or worst-case held-out utility under a cap on called rows."""
    if mode not in ("mean", "min"):
        raise ValueError(f"unknown score mode: {mode}")
    per = folds.groupBy(candidate, "seed").agg(
        F.avg("holdout_utility").alias("utility_mean"), F.min("holdout_utility").alias("utility_min")
    ).join(runs, [candidate, "seed"])
    allowed = F.lit(True) if cap is None else F.col("source_predicted_positive_rate") <= cap + CAP_SLACK
    flagged = per.withColumn("_ok", allowed)
    window = Window.partitionBy("seed")
    found = F.when(F.max(F.col("_ok").cast("int")).over(window) == 1, F.col("_ok")).otherwise(
        F.raise_error(F.lit("no candidate satisfies the cap")).cast("boolean")
    )
    passing = flagged.withColumn("_found", found).where("_found").drop("_ok", "_found")
    order = [F.desc(f"utility_{mode}"), F.asc("source_predicted_positive_rate"), F.asc(candidate)]
    label = f"holdout_{mode}_" + ("unconstrained" if cap is None else f"cap_{cap:g}".replace(".", "p"))
    return select_best(passing, ["seed"], order).withColumn("policy", F.lit(label))


def selection_summary(selected: DataFrame, candidate: str, metrics: Sequence[str]) -> DataFrame:
    return seed_summary(selected, ["policy"], metrics).join(
        chosen_list(selected, ["policy"], "seed", candidate, "selected_candidates"), "policy"
    )
