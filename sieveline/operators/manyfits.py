"""Many logistic models in a handful of jobs.

Training sets lie in one long table, numbered by a column. A pass over it sums loss,
gradient and curvature of every model of every set, task by task in numpy, and the
driver takes one Newton step per model: it only ever sees a few numbers per model.
The number of jobs is that of the passes, whatever the size of the grid.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.operators.models import ScaledLogistic
from sieveline.session import cut_lineage

MOST_PASSES = 200


def _columns(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in names], axis=1)


def fit_many(
    train: DataFrame, number: str, features: Sequence[str], label: str, strengths: Sequence[float], balanced: bool = True, tolerance: float = 1e-9
) -> dict[tuple[int, float], ScaledLogistic]:
    """One model per training set and strength C: L2 logistic regression on features standardised per set.

    `number` is an integer column that names the set. Rows that are equal in a set are counted once.
    """
    if any(c <= 0 for c in strengths):
        raise ValueError("C must be positive")
    features, k = list(features), len(features)
    rows = train.groupBy(F.col(number).cast("long").alias("_set"), F.col(label).cast("double").alias("_y"), *features).agg(F.count(F.lit(1)).alias("_n"))
    rows = cut_lineage(rows)
    weight = F.col("_n").cast("double")
    sums = rows.groupBy("_set").agg(
        F.sum("_n").alias("n"),
        F.sum(F.col("_n") * F.col("_y")).alias("p"),
        *[(F.sum(F.col(f) * weight) / F.sum(weight)).alias(f"m{i}") for i, f in enumerate(features)],
    )
    stats = sums.collect()  # a row per set of the caller's grid
    means = {r["_set"]: np.array([r[f"m{i}"] for i in range(k)]) for r in stats}
    totals = {r["_set"]: (r["n"], r["p"]) for r in stats}
    if any(p <= 0 or p >= n for n, p in totals.values()):
        raise ValueError("every training set needs both classes")
    centre = F.create_map(*[x for s, mu in means.items() for x in (F.lit(s), F.array(*[F.lit(float(v)) for v in mu]))])
    away = rows.withColumn("_m", F.element_at(centre, F.col("_set")))
    spread = away.groupBy("_set").agg(
        *[(F.sum(F.pow(F.col(f) - F.get("_m", i), 2) * weight) / F.sum(weight)).alias(f"v{i}") for i, f in enumerate(features)]
    )
    scales = {r["_set"]: np.array([np.sqrt(r[f"v{i}"]) or 1.0 for i in range(k)]) for r in spread.collect()}
    weights = {s: (n / (2 * (n - p)), n / (2 * p)) if balanced else (1.0, 1.0) for s, (n, p) in totals.items()}

    models = [(s, float(c)) for s in sorted(means) for c in strengths]
    beta = np.zeros((len(models), k + 1))
    base, loss, move, share = beta.copy(), np.full(len(models), np.inf), np.zeros_like(beta), np.ones(len(models))
    open_ = np.ones(len(models), bool)
    held_back = np.array([[1 / c] * k + [0.0] for _, c in models])
    for _ in range(MOST_PASSES):
        at = np.flatnonzero(open_)
        trial = base + share[:, None] * move
        sums = _pass(rows, features, [(i, models[i][0], trial[i]) for i in at.tolist()], means, scales, weights)
        for i in at:
            value, gradient, bend = sums[i]
            value += (held_back[i] * trial[i] ** 2).sum() / 2
            if value > loss[i] + 1e-12 * abs(loss[i]):
                share[i] /= 2
                open_[i] = share[i] > 1e-12
                continue
            base[i], loss[i], share[i] = trial[i], value, 1.0
            move[i] = -np.linalg.solve(bend + np.diag(held_back[i]), gradient + held_back[i] * trial[i])
            open_[i] = np.abs(move[i]).max() > tolerance
        if not open_.any():
            return {
                (s, c): ScaledLogistic(tuple(features), tuple(means[s].tolist()), tuple(scales[s].tolist()), tuple(b[:k].tolist()), float(b[k]))
                for (s, c), b in zip(models, base)
            }
    raise RuntimeError(f"no fit within {MOST_PASSES} passes")


def _pass(rows: DataFrame, features: list[str], models: list[tuple], means: dict, scales: dict, weights: dict) -> dict:
    """Loss, gradient and curvature of every model at its coefficients, from one job."""
    size = len(features) + 1
    of_set: dict[int, list] = {}
    for i, s, beta in models:
        of_set.setdefault(s, []).append((i, beta))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            sets, y, n = (batch.column(c).to_numpy() for c in ("_set", "_y", "_n"))
            values = _columns(batch, features)
            for s in np.unique(sets).tolist():
                if s not in of_set:
                    continue
                own = sets == s
                x = np.column_stack([(values[own] - means[s]) / scales[s], np.ones(own.sum())])
                w = n[own] * np.where(y[own] == 1, weights[s][1], weights[s][0])
                for i, beta in of_set[s]:
                    z = x @ beta
                    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                    loss = (w * (np.logaddexp(0, z) - y[own] * z)).sum()
                    gradient = x.T @ (w * (p - y[own]))
                    bend = (x * (w * p * (1 - p))[:, None]).T @ x
                    sums[i] = sums.get(i, 0.0) + np.concatenate([[loss], gradient, bend.ravel()])
        if sums:
            place = np.tile(np.arange(1 + size + size * size), len(sums))
            yield pa.record_batch(
                [pa.array(np.repeat(list(sums), 1 + size + size * size)), pa.array(place), pa.array(np.concatenate(list(sums.values())))],
                names=["model", "place", "value"],
            )

    parts = rows.select("_set", "_y", "_n", *features).mapInArrow(run, "model long, place long, value double")
    table = parts.groupBy("model", "place").agg(F.sum("value").alias("v"))
    out: dict = {i: np.zeros(1 + size + size * size) for i, _, _ in models}
    for r in table.collect():  # a few numbers per model
        out[r["model"]][r["place"]] = r["v"]
    return {i: (v[0], v[1 : 1 + size], v[1 + size :].reshape(size, size)) for i, v in out.items()}


def score_many(rows: DataFrame, models: Sequence[ScaledLogistic], keep: Sequence[str], number: str = "model") -> DataFrame:
    """Every row's score by every model: `keep`, the model's place in the list as `number`, and `score`; one pass."""
    features, keep = list(models[0].features), list(keep)
    weights = np.array([np.array(m.weights) / np.array(m.scales) for m in models]).T
    shift = np.array([m.intercept - (np.array(m.weights) * np.array(m.means) / np.array(m.scales)).sum() for m in models])
    kept = rows.select(*keep).schema
    schema = T.StructType([*kept.fields]).add(number, "integer").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = 1 / (1 + np.exp(-(_columns(batch, features) @ weights + shift)))
            for i in range(len(models)):
                columns = [batch.column(c) for c in keep]
                columns += [pa.array(np.full(batch.num_rows, i, np.int32)), pa.array(np.ascontiguousarray(scores[:, i]))]
                yield pa.record_batch(columns, names=[*keep, number, "score"])

    extra = [f for f in features if f not in keep]
    return rows.select(*keep, *extra).mapInArrow(run, schema)
