"""Metrics and thresholds: closed-form tables, and numpy over heavily tied scores."""

import numpy as np
import pytest

from sieveline.operators import metrics as m
from sieveline.operators import thresholds as h

SCHEMA = "g string, y_true int, score double"


def frame(spark, y, s, g="a"):
    return spark.createDataFrame([(g, int(a), float(b)) for a, b in zip(y, s)], SCHEMA)


def tied(seed, n=400, levels=23):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    s = np.round((0.3 * y + rng.random(n)) / 1.3 * levels) / levels
    return y, s


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))


def det(y, s):
    cuts = np.unique(np.concatenate([s, np.nextafter(s, np.inf), [-np.inf, np.inf]]))
    return [(t, np.mean(s[y == 0] >= t), np.mean(s[y == 1] < t)) for t in cuts]


def area(y, s):
    points = sorted({(b, a) for _, b, a in det(y, s)})
    return sum((b2 - b1) * (a1 + a2) / 2 for (b1, a1), (b2, a2) in zip(points, points[1:]))


def test_calibration_closed_form(spark):
    df = frame(spark, [0, 1, 1, 0], [0.1, 0.9, 0.7, 0.2])
    assert m.brier_score(df, ["g"]).first()["brier_score"] == pytest.approx(0.0375)
    bins = {r["bin"]: r for r in m.calibration_bins(df, ["g"], 2).collect()}
    assert (bins[0]["count"], bins[0]["confidence"], bins[0]["accuracy"]) == (2, pytest.approx(0.15), 0.0)
    assert (bins[1]["count"], bins[1]["confidence"], bins[1]["accuracy"]) == (2, pytest.approx(0.8), 1.0)
    assert m.expected_calibration_error(df, ["g"], 2).first()[1] == pytest.approx(0.175)
    assert m.maximum_calibration_error(df, ["g"], 2).first()[1] == pytest.approx(0.2)


def test_bin_edges_follow_the_edge_list(spark):
    scores = [i / 10 for i in range(11)]
    rows = frame(spark, [0] * 11, scores).withColumn("bin", m.bin_of(m.F.col("score"), 10)).orderBy("score").collect()
    want = np.digitize(scores, np.linspace(0, 1, 11)[1:-1])
    assert [r["bin"] for r in rows] == list(want)


def test_operating_points(spark):
    y, s = [0, 0, 0, 1, 1, 1], [0.1, 0.2, 0.8, 0.4, 0.6, 0.9]
    p = m.apcer_at_bpcer(frame(spark, y, s), ["g"]).first()
    assert (p["bpcer"], p["apcer"]) == (0.0, pytest.approx(2 / 3))
    assert p["threshold"] == 0.8 and p["strict"]
    clean = m.apcer_at_bpcer(frame(spark, y, [0.05, 0.15, 0.25, 0.65, 0.75, 0.95]), ["g"]).first()
    assert (clean["apcer"], clean["bpcer"], clean["n_bona_fide"], clean["n_attack"]) == (0.0, 0.0, 3, 3)
    # sorted points join the highest to the lowest APCER, so a perfect detector is not 0
    perfect = m.audet_proxy(frame(spark, y, [0.05, 0.15, 0.25, 0.65, 0.75, 0.95]), ["g"]).first()
    assert perfect["audet_proxy"] == pytest.approx(1 / 6)
    with pytest.raises(Exception, match="both label classes"):
        m.apcer_at_bpcer(frame(spark, [0, 0, 0], [0.1, 0.2, 0.3]), ["g"]).collect()


@pytest.mark.parametrize("bad", [float("nan"), float("inf")])
def test_unusable_scores_fail(spark, bad):
    with pytest.raises(Exception, match="finite"):
        m.histogram(frame(spark, [0, 1], [0.2, bad]), ["g"]).collect()


def test_one_class_auc_is_null(spark):
    assert m.roc_auc(frame(spark, [1, 1], [0.2, 0.3]), ["g"]).first()["roc_auc"] is None


def test_against_numpy_with_ties_and_any_partitioning(spark):
    parts = {f"g{i}": tied(i) for i in range(3)}
    rows = [(g, int(a), float(b)) for g, (y, s) in parts.items() for a, b in zip(y, s)]
    for df in (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)):
        bundle = {r["g"]: r for r in m.binary_metrics(df, ["g"]).collect()}
        points = {r["g"]: r for r in m.operating_metrics(df, ["g"], target=0.05).collect()}
        for g, (y, s) in parts.items():
            assert bundle[g]["roc_auc"] == pytest.approx(auc(y, s), abs=1e-12)
            assert bundle[g]["accuracy"] == pytest.approx(np.mean((s >= 0.5) == (y == 1)))
            best = min((a, -b, t) for t, b, a in det(y, s) if b <= 0.05)
            assert points[g]["apcer"] == pytest.approx(best[0])
            assert points[g]["bpcer"] == pytest.approx(-best[1])
            assert points[g]["audet_proxy"] == pytest.approx(area(y, s), abs=1e-12)


def thresholds(s):
    u = np.unique(s)
    return np.unique(np.concatenate([[0, 0.5, 1], u, (u[:-1] + u[1:]) / 2]))


def test_threshold_candidates_and_choice(spark):
    y, s = tied(5)
    df = frame(spark, y, s)
    got = {r["threshold"]: r for r in h.candidate_counts(df, ["g"]).collect()}
    assert sorted(got) == sorted(thresholds(s))
    for t, r in got.items():
        assert (r["tp"], r["fp"]) == (((s >= t) & (y == 1)).sum(), ((s >= t) & (y == 0)).sum())
    value = lambda t: np.mean((s >= t) == (y == 1))
    best = max(value(t) for t in thresholds(s))
    want = min((abs(t - 0.5), t) for t in thresholds(s) if value(t) == best)[1]
    assert h.best_threshold(df, ["g"]).first()["threshold"] == want


def test_threshold_cap(spark):
    y, s = tied(6)
    row = h.select_source_threshold(frame(spark, y, s), ["g"], "source_youden", "higher", cap=0.2).first()
    assert row["positive_rate"] <= 0.2
    allowed = [t for t in thresholds(s) if np.mean(s >= t) <= 0.2 + 1e-12]
    youden = lambda t: np.mean(s[y == 1] >= t) + np.mean(s[y == 0] < t) - 1
    assert row["objective"] == pytest.approx(max(youden(t) for t in allowed))
    with pytest.raises(ValueError):
        h.select_source_threshold(frame(spark, y, s), ["g"], cap=2.0)
    with pytest.raises(ValueError):
        h.objective_column("nothing")


def test_triage_limits(spark):
    from sieveline.operators import triage as tr

    y, s = tied(8)
    rows = m.running(frame(spark, y, s), ["g"])
    grid = [0.0, 0.01, 0.1, 0.4]
    got = tr.triage_thresholds(rows, ["g"], tr.limit_grid(grid, grid)).collect()
    assert len(got) == 16
    real, fake = np.sort(s[y == 0]), np.sort(s[y == 1])
    for r in got:
        k = int(np.floor(r["max_real_fpr"] * len(real)))
        f = np.nextafter(real[-1], 1.0) if k <= 0 else real[max(len(real) - k, 0)]
        k = int(np.floor(r["max_fake_clearance"] * len(fake)))
        c = np.nextafter(fake[0], 0.0) if k <= 0 else fake[min(k - 1, len(fake) - 1)]
        if c >= f:
            c = np.nextafter(f, 0.0)
        gf = np.nextafter(r["fake_threshold"], 1.0) if r["fake_strict"] else r["fake_threshold"]
        gc = np.nextafter(r["real_threshold"], 0.0) if r["real_strict"] else r["real_threshold"]
        assert (gf, gc) == (f, c)
