"""Many fits at once, and the held-out grid made of them, against fits one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import tuning as tu
from sieveline.operators.fusion import branch_dropout_rows
from sieveline.operators.manyfits import fit_many, score_many
from sieveline.operators.sampling import key_holdout


def fit(x, y, c):
    mu, sd = x.mean(0), x.std(0)
    sd[sd == 0] = 1.0
    a = np.column_stack([(x - mu) / sd, np.ones(len(y))])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    ridge, beta = np.diag([1 / c] * x.shape[1] + [0]), np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ beta))
        beta = beta - np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (w * (p - y)) + ridge @ beta)
    return mu, sd, beta


def test_models_of_all_sets_and_strengths(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s in range(3):
        for _ in range(80 * (s + 1)):
            y = int(rng.random() < 0.4)
            rows.append((s, y, float(np.round(rng.normal() + y * s, 1)), float(rng.normal() * 10), 3.0))
    df = spark.createDataFrame(rows, "part int, y int, a double, b double, flat double")
    got = fit_many(df, "part", ["a", "b", "flat"], "y", [0.03, 1.0])
    assert set(got) == {(s, c) for s in range(3) for c in (0.03, 1.0)}
    for (s, c), model in got.items():
        own = np.array([r[2:] for r in rows if r[0] == s])
        mu, sd, beta = fit(own, np.array([r[1] for r in rows if r[0] == s]), c)
        assert np.allclose(model.means, mu) and np.allclose(model.scales, sd)
        assert np.allclose([*model.weights, model.intercept], beta, atol=1e-7)
    models = [got[n] for n in sorted(got)]
    scored = {(r["part"], r["a"], r["b"], r["at"]): r["score"] for r in score_many(df, models, ["part", "a", "b"], "at").collect()}
    for i in (0, 5):
        for r in models[i].score(df).collect():
            assert scored[r["part"], r["a"], r["b"], i] == pytest.approx(r["score"], abs=1e-12)


def test_separated_and_one_sided_sets(spark):
    rows = [(0, 0, 0.0), (0, 1, 1.0), (0, 0, 0.1), (0, 1, 0.9)]
    got = fit_many(spark.createDataFrame(rows, "part int, y int, a double"), "part", ["a"], "y", [1000.0])
    assert got[0, 1000.0].weights[0] > 3
    with pytest.raises(ValueError, match="both classes"):
        fit_many(spark.createDataFrame([(0, 1, 0.5)], "part int, y int, a double"), "part", ["a"], "y", [1.0])


@pytest.fixture(scope="module")
def source(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(240):
        y = int(rng.random() < 0.5)
        rows.append((i, f"p{i}", y, int(rng.integers(1, 3)) if y else 0, *[float(np.clip(0.3 * y + 0.7 * rng.random(), 0, 1)) for _ in range(2)]))
    return spark.createDataFrame(rows, "id long, path string, y_true int, source_label int, a double, b double")


DROPOUTS = [tu.Dropout(), tu.Dropout("mean", 0.35, 2, "mean")]


def test_grid_agrees_with_cells_fitted_one_by_one(source):
    got = tu.holdout_grid(source, "path", ["a", "b"], [1.0, 0.03], [None, 0.48], [1, 2], [7, 17], DROPOUTS).collect()
    cells = {(r["seed"], r["c"], r["dropout"], r["heldout_source"], r["cap_name"]): r for r in got}
    assert len(cells) == len(got) == 2 * 2 * 2 * 2 * 2
    rows = {r["path"]: r for r in source.collect()}
    for seed, c, d, held in ((7, 1.0, DROPOUTS[0], 1), (17, 0.03, DROPOUTS[1], 2)):
        out = {r["path"] for r in key_holdout(source.where("y_true = 0"), "path", 0.5, seed + tu.REAL_VALIDATION_OFFSET).collect()}
        out |= {p for p, r in rows.items() if r["y_true"] == 1 and r["source_label"] == held}
        train = source.where(~F.col("path").isin(list(out))).select("path", "y_true", "a", "b")
        copies = branch_dropout_rows(train, "path", ["a", "b"], d.rate, d.repeats, seed + held * tu.SOURCE_OFFSET, d.fill).collect()
        x, y = np.array([(r["a"], r["b"]) for r in copies]), np.array([r["y_true"] for r in copies])
        mu, sd, beta = fit(x, y, c)
        cell = cells[seed, c, d.label, held, "none"]
        values = np.array([(rows[p]["a"], rows[p]["b"]) for p in sorted(out)])
        truth = np.array([rows[p]["y_true"] for p in sorted(out)])
        score = 1 / (1 + np.exp(-(np.column_stack([(values - mu) / sd, np.ones(len(truth))]) @ beta)))
        assert cell["validation_samples"] == len(out)
        assert cell["validation_accuracy"] == pytest.approx(((score >= cell["threshold"]) == (truth == 1)).mean())
        assert cell["validation_brier_score"] == pytest.approx(((score - truth) ** 2).mean(), abs=1e-7)


def test_sweep_evaluates_one_configuration_per_seed_and_cap(source):
    target = source.withColumn("variant", F.lit("target"))
    got = tu.cap_sweep(source, target, "variant", "path", ["a", "b"], [1.0, 0.03], [None, 0.48], [1, 2], [7, 17], DROPOUTS).collect()
    assert {(r["seed"], r["cap_name"], r["variant"]) for r in got} == {(s, c, v) for s in (7, 17) for c in ("none", "0.48") for v in ("source", "target")}
    assert len(got) == 8
    for r in got:  # source and target are the same rows here
        twin = next(x for x in got if (x["seed"], x["cap_name"]) == (r["seed"], r["cap_name"]) and x["variant"] != r["variant"])
        assert r["accuracy"] == pytest.approx(twin["accuracy"])
