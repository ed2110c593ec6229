"""Held-out sources: folds as differences of prefix sums, against counting every fold on its own."""

import numpy as np
import pyarrow as pa
import pytest

from sieveline.operators import holdout as e

SOURCES = (1, 2, 3, None)


def made(seed, n, digits, sources=SOURCES):
    """(group, source, held_out_real, label, score); scores of the reals and fakes tie often when rounded."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in ("a", "b"):
        for _ in range(n):
            y = int(rng.random() < 0.5)
            s = float(np.round(np.clip(0.3 * y + 0.7 * rng.random(), 0, 1), digits))
            source = sources[rng.integers(len(sources))] if y else 0
            rows.append((g, source, bool(not y and rng.random() < 0.3), y, s))
        # one source far above all others, one score that many share
        rows += [(g, 1, False, 1, 1.0)] * 7 + [(g, 0, False, 0, 0.25)] * (n // 3)
    return rows


def best(scores, y, objective):
    points = sorted(set(scores) | {0.0, 0.5, 1.0} | {(a + b) / 2 for a, b in zip(sorted(set(scores)), sorted(set(scores))[1:])})
    found = []
    for t in points:
        called = scores >= t
        tp, fp, fn, tn = (called & (y == 1)).sum(), (called & (y == 0)).sum(), (~called & (y == 1)).sum(), (~called & (y == 0)).sum()
        value = (tp + tn) / len(y) if objective == "accuracy" else 2 * tp / (2 * tp + fp + fn)
        found.append((-value, abs(t - 0.5), t, tn, fn))
    return min(found)


def expected(rows, objective, default):
    out = {}
    for g in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == g]
        for f in {r[1] for r in own if r[3]} - {None}:
            test = np.array([r[2] or (r[3] == 1 and r[1] == f) for r in own])
            y, s = np.array([r[3] for r in own]), np.array([r[4] for r in own])
            parts = {}
            for name, part in (("calibration", ~test), ("test", test)):
                if len(set(y[part].tolist())) == 2:
                    parts[name] = (s[part], y[part])
            if len(parts) < 2:
                continue
            cal, (ts, ty) = best(*parts["calibration"], objective), parts["test"]
            oracle = best(ts, ty, objective)
            pos, neg = ts[ty == 1], ts[ty == 0]
            auc = np.mean([(neg < p).mean() + (neg == p).mean() / 2 for p in pos])
            row = {"source_threshold": cal[2], "oracle_threshold": oracle[2], "roc_auc": auc, "test_real": len(neg), "test_fake": len(pos)}
            for name, t in (("default", default), ("source_threshold", cal[2])):
                called = ts >= t
                tp, fp = (called & (ty == 1)).sum(), (called & (ty == 0)).sum()
                row[f"{name}_accuracy"] = (called == (ty == 1)).mean()
                row[f"{name}_f1"] = 2 * tp / (tp + fp + len(pos)) if tp + fp + len(pos) else 0.0
                if name != "default":
                    row["real_fpr"], row["fake_detection"] = fp / len(neg), tp / len(pos)
            cs, cy = parts["calibration"]
            row["calibration_accuracy"] = ((cs >= cal[2]) == (cy == 1)).mean()
            row["oracle_accuracy"] = ((ts >= oracle[2]) == (ty == 1)).mean()
            out[g, f] = row
    return out


def slices(spark, rows):
    df = spark.createDataFrame(rows, "g string, source_label int, held_out_real boolean, y_true int, score double")
    return e.slice_histogram(df, ["g"], "source_label")


@pytest.mark.parametrize("digits", [2, 15])
@pytest.mark.parametrize("objective, default", [("accuracy", 0.5), ("f1", 0.31)])
def test_report_agrees_with_counting_every_fold(spark, digits, objective, default):
    rows = made(digits, 90, digits)
    want = expected(rows, objective, default)
    got = e.holdout_report(slices(spark, rows), ["g"], objective, default).collect()
    assert {(r["g"], r["fold"]) for r in got} == set(want) and len(got) == len(want) >= 6
    for r in got:
        for name, value in want[r["g"], r["fold"]].items():
            assert r[name] == pytest.approx(value, abs=1e-12), (r["g"], r["fold"], name)


def test_folds_without_a_class_are_left_out(spark):
    rows = [r for r in made(1, 30, 2, (1, 2)) if r[0] == "a"] + [("b", 1, False, 1, 0.5), ("b", 0, False, 0, 0.5), ("b", 0, True, 0, 0.4)]
    sizes = e.fold_sizes(slices(spark, rows), ["g"]).collect()
    assert {(r["g"], r["fold"]) for r in sizes} == {("a", 1), ("a", 2)}  # the only source of b leaves no fake to calibrate on
    assert {(r["g"], r["fold"]) for r in e.holdout_report(slices(spark, rows), ["g"]).collect()} == {("a", 1), ("a", 2)}


def test_without_keys_and_unknown_objective(spark):
    rows = [r for r in made(4, 60, 3) if r[0] == "a"]
    df = slices(spark, rows).drop("g")
    want = expected(rows, "accuracy", 0.5)
    got = {r["fold"]: r["source_threshold"] for r in e.holdout_report(df, []).collect()}
    assert got == {f: row["source_threshold"] for (_, f), row in want.items()}
    with pytest.raises(ValueError, match="no array form"):
        e.best_of_folds(df, [], "magic")


def test_steps_inside_a_bucket_change_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    n, names = 200, [1, 2, 3]
    rows = pa.table(
        {
            "bucket": pa.array([5] * n, pa.int32()),
            "source": rng.choice(names, n),
            "score": np.round(rng.random(n), 2),
            "train": rng.integers(0, 3, n),
            "held": rng.integers(0, 3, n),
            "pos": rng.integers(0, 3, n),
        }
    )
    before = [4, 3, 2, 1, 0]
    whole = [before[0] + sum(rows["train"].to_pylist()), before[1] + sum(rows["held"].to_pylist())]
    whole += [before[2 + i] + sum(p for p, s in zip(rows["pos"].to_pylist(), rows["source"].to_pylist()) if s == v) for i, v in enumerate(names)]
    start = pa.table({"bucket": pa.array([5], pa.int32()), "sources": [names], "before": [before], "last": [[-0.3, -0.2, -0.1, -0.4, float("-inf")]], "all": [whole]})
    kinds = pa.schema([("fold", pa.int64()), ("role", pa.string()), ("cost", pa.float64()), ("tie", pa.float64()), ("threshold", pa.float64()), ("tn", pa.int64()), ("fn", pa.int64()), ("auc", pa.float64())])

    def least(step):
        monkeypatch.setattr(e, "FOLD_CELLS", step)
        table = e._evaluate([], "accuracy", kinds, rows, start).to_pylist()
        out = {}
        for r in table:
            key = (r["fold"], r["role"])
            out[key] = min(out.get(key, (np.inf,)), (r["cost"], r["tie"], r["threshold"], r["tn"], r["fn"]))
        return out, {r["fold"]: r["auc"] for r in table if r["auc"]}

    assert least(1 << 20) == least(7) and len(least(1)[0]) == 6
