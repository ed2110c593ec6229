"""Calibrators, logistic fits, feature selection and intervals against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import calibration as c
from sieveline.operators import fusion as u
from sieveline.operators import models as g
from sieveline.operators import runstats as r


def sample(seed=1, n=300):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.35).astype(int)
    s = np.round(np.clip(0.25 * y + 0.75 * rng.random(n), 0, 1), 2)
    return y, s


def frame(spark, y, s):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y_true int, score double")


def logit(s):
    p = np.clip(s, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def newton(x, y, w, strength):
    """L2 logistic regression, intercept free."""
    a = np.column_stack([x, np.ones(len(x))])
    ridge = np.eye(a.shape[1]) / strength
    ridge[-1, -1] = 0
    beta = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-a @ beta))
        grad = a.T @ (w * (p - y)) + ridge @ beta
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + ridge
        beta -= np.linalg.solve(hess, grad)
    return beta


def balanced(y):
    return np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))


@pytest.mark.parametrize("even", [False, True])
def test_platt(spark, even):
    y, s = sample()
    slope, intercept = c.platt_fit(frame(spark, y, s), even)
    beta = newton(logit(s)[:, None], y, balanced(y) if even else np.ones(len(y)), 1.0)
    assert (slope, intercept) == (pytest.approx(beta[0], abs=1e-4), pytest.approx(beta[1], abs=1e-4))


def pav(s, y, w):
    blocks = []
    for v in np.unique(s):
        m = s == v
        blocks.append([v, v, np.average(y[m], weights=w[m]), w[m].sum()])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([a[0], b[1], (a[2] * a[3] + b[2] * b[3]) / (a[3] + b[3]), a[3] + b[3]])
    return lambda v: next(b[2] for b in blocks if b[0] <= v <= b[1])


@pytest.mark.parametrize("name", ["isotonic", "isotonic_balanced"])
def test_isotonic(spark, name):
    y, s = sample(2)
    value = pav(s, y, balanced(y) if name.endswith("balanced") else np.ones(len(y)))
    df = frame(spark, y, s)
    for row in c.fit_calibrator(name, df)(df).collect():
        assert row["calibrated"] == pytest.approx(value(row["score"]), abs=1e-9)


@pytest.mark.parametrize("even", [False, True])
def test_temperature(spark, even):
    y, s = sample(3)
    w = balanced(y) if even else np.ones(len(y))

    def loss(t):
        p = np.clip(1 / (1 + np.exp(-np.clip(logit(s) / t, -60, 60))), 1e-6, 1 - 1e-6)
        return np.average(-(y * np.log(p) + (1 - y) * np.log(1 - p)), weights=w)

    grid = np.geomspace(0.05, 20, 240)
    t = grid[np.argmin([loss(x) for x in grid])]
    fine = np.geomspace(max(t / 2, 0.01), min(t * 2, 100), 240)
    want = fine[np.argmin([loss(x) for x in fine])]
    assert c.temperature_fit(frame(spark, y, s), [], even).first()["temperature"] == pytest.approx(want)


def test_calibration_needs_both_classes(spark):
    with pytest.raises(Exception, match="both classes"):
        c.temperature_fit(frame(spark, [1, 1], [0.2, 0.4]), []).collect()
    with pytest.raises(ValueError):
        c.fit_calibrator("nothing", frame(spark, [0, 1], [0.1, 0.9]))


def wide(spark, seed=4, n=240):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x = np.round(rng.random((n, 3)) * 0.8 + 0.2 * y[:, None] * [1, 0.5, 0], 3) + 0.0004
    rows = [(i, int(a), *map(float, b)) for i, (a, b) in enumerate(zip(y, x))]
    return y, x, spark.createDataFrame(rows, "id bigint, y_true int, a double, b double, c double")


def test_logistic_fusion_and_coefficients(spark):
    y, x, df = wide(spark)
    model = u.logistic_fusion(df, ["a", "b", "c"], 0.5)
    z = (x - x.mean(0)) / x.std(0)
    beta = newton(z, y, balanced(y), 0.5)
    assert model.weights == pytest.approx(beta[:3], abs=1e-4)
    table = {r["method"]: r for r in u.coefficient_table(spark, model).collect()}
    raw = beta[:3] / x.std(0)
    assert table["a"]["raw_score_coefficient"] == pytest.approx(raw[0], abs=1e-3)
    assert table["__intercept__"]["raw_score_coefficient"] == pytest.approx(beta[3] - (raw * x.mean(0)).sum(), abs=1e-3)


def test_branch_dropout(spark):
    _, _, df = wide(spark)
    rows = u.branch_dropout_rows(df, "id", ["a", "b", "c"], 0.9, 2, 7)
    again = u.branch_dropout_rows(df.repartition(5), "id", ["a", "b", "c"], 0.9, 2, 7)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, again.collect()))
    gone = [sum(r[k] == 0.5 for k in "abc") for r in rows.collect() if r["repeat"] > 0]
    assert max(gone) == 2 and np.mean(gone) > 1.5
    assert u.branch_dropout_rows(df, "id", ["a"], 0.0, 2, 7).count() == df.count()


def test_weight_grid():
    assert len(u.weight_grid(3, 0.25)) == 15
    assert all(abs(sum(w) - 1) < 1e-12 for w in u.weight_grid(4, 0.1))
    for n, step in ((1, 0.5), (2, 0.3), (2, 0.0)):
        with pytest.raises(ValueError):
            u.weight_grid(n, step)


def test_recipe_names_must_match(spark):
    _, _, df = wide(spark)
    recipe = {"source_names": ["a", "b"], "weights": [1, 1], "normalization": "raw", "threshold": 0.5}
    assert u.apply_fusion(df, ["a", "b"], recipe).count() == df.count()
    with pytest.raises(ValueError, match="equal the recipe"):
        u.apply_fusion(df, ["b", "a"], recipe)
    with pytest.raises(ValueError, match="threshold"):
        u.apply_fusion(df, ["a", "b"], recipe | {"threshold": None})


def test_anova_matches_the_definition(spark):
    y, x, df = wide(spark)
    long = g.long_features(df.withColumn("v", F.array("a", "b", "c")), "id", "y_true", "v")
    got = {r["feature"]: r["f_value"] for r in g.anova_f(long).collect()}
    for i in range(3):
        groups = [x[y == k, i] for k in (0, 1)]
        between = sum(len(v) * (v.mean() - x[:, i].mean()) ** 2 for v in groups)
        within = sum(((v - v.mean()) ** 2).sum() for v in groups) / (len(x) - 2)
        assert got[i] == pytest.approx(between / within)
    assert g.anova_selector(df, ["a", "b", "c"], "y_true", 1) == [["a", "b", "c"][max(got, key=got.get)]]


def test_bootstrap_is_numpys(spark):
    values = [0.5, 0.7, 0.9]
    df = spark.createDataFrame([("m", i, v) for i, v in enumerate(values)], "method string, seed int, accuracy double")
    row = r.bootstrap_mean_ci(df, ["method"], ["accuracy"], seed=11, resamples=200).first()
    rng = np.random.default_rng(11)
    means = [np.array(values)[rng.integers(0, 3, size=3)].mean() for _ in range(200)]
    assert (row["mean"], row["ci_low"], row["ci_high"]) == pytest.approx((0.7, np.quantile(means, 0.025), np.quantile(means, 0.975)))
    one = r.bootstrap_mean_ci(df.limit(1), ["method"], ["accuracy"]).first()
    assert one["mean"] == one["ci_low"] == one["ci_high"]


def test_paired_support_labels(spark):
    rows = [(s, m, a) for s in (7, 17, 29) for m, a in (("base", 0.70 + s / 1000), ("cand", 0.75 + s / 1000))]
    df = spark.createDataFrame(rows, "seed int, method string, accuracy double")
    row = r.paired_support(df, "method", "cand", "base", {"accuracy": "higher"}).first()
    assert row["support_label"] == "consistent_gain_ci_excludes_zero" and row["candidate_wins"] == 3
    worse = r.paired_support(df, "method", "cand", "base", {"accuracy": "lower"}).first()
    assert worse["support_label"] == "candidate_trails" and worse["candidate_losses"] == 3


def test_poisson_bootstrap_covers_the_mean(spark):
    df = spark.range(2000).withColumn("k", F.lit("a")).withColumn("v", F.col("id") % 10)
    row = r.poisson_bootstrap(df, ["k"], "id", "v", replicates=100).first()
    assert row["ci_low"] < row["mean"] == 4.5 < row["ci_high"] and row["ci_high"] - row["ci_low"] < 0.4


def test_paired_support_columns(spark):
    rows = [(s, m, 0.5 + 0.1 * (m == "new") + 0.01 * s, 0.3 - 0.1 * (m == "new"), None) for s in range(3) for m in ("new", "old")]
    df = spark.createDataFrame(rows, "seed int, method string, accuracy double, brier double, other double")
    out = r.paired_support(df, "method", "new", "old", {"accuracy": "higher", "brier": "lower", "other": "higher"}, on=["seed"])
    found = {x["metric"]: x for x in out.collect()}
    assert found["accuracy"]["candidate_mean"] == pytest.approx(0.61) and found["accuracy"]["baseline_mean"] == pytest.approx(0.51)
    assert found["brier"]["raw_ci_low"] == pytest.approx(-0.1) and found["brier"]["ci_low"] == pytest.approx(0.1)
    assert found["brier"]["support_label"] == "consistent_gain_ci_excludes_zero"
    assert found["other"]["support_label"] == "no_pairs" and found["other"]["n_pairs"] == 0
