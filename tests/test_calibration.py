"""Calibrators of many groups at once, and the pooling they rest on."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import calibration as c
from sieveline.operators import triage as tr
from sieveline.plans import pooling

GROUPS = ("a", "b", "c")


def scored(seed, n, digits):
    """Rows (group, label, score) whose groups differ in size and slope; a third of the first group share a score."""
    rng = np.random.default_rng(seed)
    rows = []
    for k, g in enumerate(GROUPS):
        m = n * (k + 1)
        y = (rng.random(m) < 0.3 + 0.1 * k).astype(int)
        s = np.clip(0.1 * k * y + (0.2 + 0.1 * k) * y + 0.6 * rng.random(m), 0, 1)
        s = np.round(s, digits)
        if k == 0:
            s[: m // 3] = 0.4
        rows += [(g, int(a), float(b)) for a, b in zip(y, s)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, y_true int, score double")


def pav(rows, even):
    """[(low, high, value)] of pools of distinct scores."""
    y, s = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    wp, wn = (1 / max(y.sum(), 1), 1 / max((1 - y).sum(), 1)) if even else (1, 1)
    blocks = []
    for v in np.unique(s):
        here = s == v
        blocks.append([v, v, wp * y[here].sum(), wn * (1 - y[here]).sum()])
        while len(blocks) > 1 and blocks[-2][2] * (blocks[-1][2] + blocks[-1][3]) >= blocks[-1][2] * (blocks[-2][2] + blocks[-2][3]) - 1e-15:
            x = blocks.pop()
            blocks[-1] = [blocks[-1][0], x[1], blocks[-1][2] + x[2], blocks[-1][3] + x[3]]
    return [(a, b, p / (p + n)) for a, b, p, n in blocks]


@pytest.mark.parametrize("digits", [2, 15])
@pytest.mark.parametrize("name", ["isotonic", "isotonic_balanced"])
def test_isotonic_of_all_groups_agrees_with_pooling_one_by_one(spark, name, digits):
    rows = scored(4, 150, digits)
    asked = [(g, 0, x) for g in GROUPS for x in (-1.0, 0.0, 0.123456, 0.4, 0.51, 0.777, 1.0, 2.0)]
    fit = frame(spark, rows)
    got = c.calibrated(name, fit, frame(spark, rows + asked), ["g"]).collect()
    assert len(got) == len(rows) + len(asked)
    for g in GROUPS:
        pools = pav([r for r in rows if r[0] == g], name.endswith("balanced"))
        x, y = zip(*[p for a, b, v in pools for p in ((a, v), (b, v))])
        for row in got:
            if row["g"] == g:
                assert row["calibrated"] == pytest.approx(np.interp(min(max(row["score"], 0), 1), x, y), abs=1e-9)


def test_hulls_of_stretches_merge_to_the_hull_of_all():
    pick = random.Random(3)
    for _ in range(200):
        x = y = 0
        points = []
        for _ in range(pick.randint(1, 60)):
            x, y = x + pick.randint(0, 3), y + pick.randint(0, 3)
            if not points or points[-1] != (x, y):
                points.append((x, y))
        want = [points[i] for i in pooling.lower_hull(points)]
        cuts = sorted(pick.sample(range(len(points) + 1), min(3, len(points))))
        parts = [points[a:b] for a, b in zip([0, *cuts], [*cuts, len(points)]) if a < b]
        corners = [p[i] for p in parts for i in pooling.lower_hull(p)]
        assert [corners[i] for i in pooling.lower_hull(corners)] == want


def test_pools_of_more_rows_than_doubles_can_count(spark):
    big = 3 * 10**17
    counts = spark.createDataFrame([("a", 0.1, big, big + 1), ("a", 0.2, big, big), ("a", 0.3, big, big + 1), ("a", 0.4, big, 1)], "g string, score double, pos long, neg long")
    got = [tuple(r) for r in pooling.monotone_pools(counts, ["g"]).orderBy("pool").collect()]
    assert got == [("a", 0, 0.1, 0.1, big + 1, big), ("a", 1, 0.2, 0.3, 2 * big + 1, 2 * big), ("a", 2, 0.4, 0.4, 1, big)]


@pytest.mark.parametrize("even", [False, True])
def test_platt_of_all_groups_agrees_with_newton_one_by_one(spark, even):
    rows = scored(8, 200, 6)
    got = {r["g"]: (r["slope"], r["intercept"]) for r in c.platt_lines(frame(spark, rows), ["g"], even).collect()}
    for g in GROUPS:
        y, s = np.array([r[1] for r in rows if r[0] == g]), np.array([r[2] for r in rows if r[0] == g])
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if even else np.ones(len(y))
        p = np.clip(s, 1e-6, 1 - 1e-6)
        a, beta = np.column_stack([np.log(p / (1 - p)), np.ones(len(y))]), np.zeros(2)
        for _ in range(60):
            q = 1 / (1 + np.exp(-a @ beta))
            grad, bend = a.T @ (w * (q - y)) + [beta[0], 0], (a * (w * q * (1 - q))[:, None]).T @ a + np.diag([1, 0])
            beta = beta - np.linalg.solve(bend, grad)
        assert got[g] == (pytest.approx(beta[0], abs=1e-7), pytest.approx(beta[1], abs=1e-7))


def test_platt_with_separated_classes_settles(spark):
    rows = [("a", 0, 0.001)] * 5 + [("a", 1, 0.999)] * 5 + [("b", 0, 0.9999999)] * 3 + [("b", 1, 0.0000001)] * 200
    got = {r["g"]: r["slope"] for r in c.platt_lines(frame(spark, rows), ["g"]).collect()}
    assert got["a"] > 0 > got["b"]


def test_one_class_is_refused(spark):
    with pytest.raises(Exception, match="both classes"):
        c.isotonic_edges(frame(spark, [("a", 1, 0.5)]), ["g"]).collect()


def test_every_mode_keeps_every_row(spark):
    rows = [(*r, role) for r in scored(5, 60, 3) for role in ("calibration", "test")]
    df = spark.createDataFrame(rows, "g string, y_true int, score double, role string")
    folds = df.groupBy("g", "role", "score").agg(F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") == 0).alias("neg"))
    sums = tr.with_score_modes(folds, ["g"]).groupBy("score_mode", "g", "role").agg(F.sum(F.col("pos") + F.col("neg")).alias("n")).collect()
    assert len(sums) == 7 * 3 * 2 and {(r["g"], r["n"]) for r in sums} == {("a", 60), ("b", 120), ("c", 180)}
    with pytest.raises(ValueError, match="unknown score modes"):
        tr.with_score_modes(folds, ["g"], ["raw", "magic"])


def test_report_names_every_calibrator(spark):
    rows = frame(spark, scored(6, 80, 4))
    got = c.calibration_report(rows, rows, ["g"]).collect()
    assert {(r["g"], r["calibrator"]) for r in got} == {(g, n) for g in GROUPS for n in c.CALIBRATORS}
    by = {(r["g"], r["calibrator"]): r for r in got}
    for g in GROUPS:  # the monotone fit on its own rows is perfectly calibrated in each pool, and never worse than raw
        r = by[g, "isotonic"]
        assert r["calibrated_brier_score"] <= r["raw_brier_score"] and r["temperature"] is None
        assert by[g, "temperature"]["temperature"] is not None
