"""Evaluation metrics."""

from pyspark.sql import functions as F

from sieveline.operators import metrics as m
from sieveline.suite.registry import case
from sieveline.suite.sqlparts import bin_sql, cells

METHOD, RUN = ["method"], ["method", "seed"]


@case("q_M01_confusion", f"SELECT method, seed, {cells()} FROM predictions GROUP BY method, seed")
def _(t):
    return m.confusion(t.predictions, RUN)


@case(
    "q_M02_accuracy_precision_recall_f1",
    "SELECT method, seed, r9(accuracy) AS accuracy, r9(precision) AS precision, r9(recall) AS recall, r9(f1) AS f1 FROM runs",
)
def _(t):
    out = m.with_scores(m.confusion(t.predictions, RUN))
    return out.select(*RUN, "accuracy", "precision", "recall", "f1")


@case(
    "q_M03_brier_score",
    "SELECT method, seed, r9(avg(pow(score - y_true, 2))) AS brier_score FROM predictions GROUP BY method, seed",
)
def _(t):
    return m.brier_score(t.predictions, RUN)


BINS = f"""
WITH filled AS (SELECT method, {bin_sql()} AS bin, count(*) AS n, avg(score) AS conf, avg(y_true) AS acc
                FROM predictions GROUP BY ALL),
slots AS (SELECT method, unnest(range(10)) AS bin, total
          FROM (SELECT method, count(*) AS total FROM predictions GROUP BY method) g),
bins AS (SELECT s.method, s.bin::INTEGER AS bin, coalesce(n, 0) AS count, coalesce(n, 0) / total::DOUBLE AS weight,
                coalesce(conf, 0) AS confidence, coalesce(acc, 0) AS accuracy,
                coalesce(abs(conf - acc), 0) AS abs_gap
         FROM slots s LEFT JOIN filled f ON s.method = f.method AND s.bin = f.bin)
"""


@case(
    "q_M04_calibration_bins",
    BINS
    + """SELECT method, bin, r9(bin / 10.0) AS bin_lower, r9((bin + 1) / 10.0) AS bin_upper, count,
                r9(weight) AS weight, r9(confidence) AS confidence, r9(accuracy) AS accuracy, r9(abs_gap) AS abs_gap
         FROM bins""",
)
def _(t):
    return m.calibration_bins(t.predictions, METHOD)


@case(
    "q_M05_expected_calibration_error",
    BINS + "SELECT method, r9(sum(weight * abs_gap)) AS expected_calibration_error FROM bins GROUP BY method",
)
def _(t):
    return m.expected_calibration_error(t.predictions, METHOD)


@case(
    "q_M06_maximum_calibration_error",
    BINS + "SELECT method, r9(max(abs_gap)) AS maximum_calibration_error FROM bins WHERE count > 0 GROUP BY method",
)
def _(t):
    return m.maximum_calibration_error(t.predictions, METHOD)


@case("q_M07_roc_auc", "SELECT method, seed, r9(roc_auc) AS roc_auc FROM runs")
def _(t):
    return m.roc_auc(t.predictions, RUN)


RUN_COLUMNS = """method, seed, tn, fp, fn, tp, n_samples, r9(roc_auc) AS roc_auc, r9(accuracy) AS accuracy,
    r9(precision) AS precision, r9(recall) AS recall, r9(f1) AS f1, r9(brier_score) AS brier_score,
    r9(expected_calibration_error) AS expected_calibration_error,
    r9(maximum_calibration_error) AS maximum_calibration_error"""


@case("q_M08_binary_metrics", f"SELECT {RUN_COLUMNS} FROM runs")
def _(t):
    return m.binary_metrics(t.predictions, RUN)


@case(
    "q_M09_det_curve",
    "SELECT method, r9(threshold) AS threshold, strict, r9(bpcer) AS bpcer, r9(apcer) AS apcer FROM det_m",
)
def _(t):
    return m.det_points(t.predictions, METHOD).drop("pos_all", "neg_all")


@case(
    "q_M10_apcer_at_bpcer",
    """SELECT method, r9(threshold) AS threshold, strict, r9(bpcer) AS bpcer, r9(apcer) AS apcer,
              n_bona_fide, n_attack FROM point_m""",
)
def _(t):
    return m.apcer_at_bpcer(t.predictions, METHOD)


@case("q_M11_audet_proxy", "SELECT method, r9(audet_proxy) AS audet_proxy FROM audet_m")
def _(t):
    return m.audet_proxy(t.predictions, METHOD)


OPERATING = """SELECT method, r9(threshold) AS threshold, strict, r9(bpcer) AS bpcer, r9(apcer) AS apcer,
              n_bona_fide, n_attack, r9(audet_proxy) AS audet_proxy{more} FROM point_m JOIN audet_m USING (method)"""


@case("q_M12_operating_metrics", OPERATING.format(more=""))
def _(t):
    return m.operating_metrics(t.predictions, METHOD)


@case(
    "q_M13_confusion_rates",
    """SELECT type, method, tn + fp + fn + tp AS support, r9((tp + fp) / (tn + fp + fn + tp)) AS fake_call_rate,
              r9(CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn) END) AS real_fpr,
              r9(CASE WHEN fn + tp = 0 THEN 0 ELSE fn / (fn + tp) END) AS fake_miss_rate
       FROM (SELECT type, method, """
    + cells()
    + " FROM predictions GROUP BY type, method) c",
)
def _(t):
    out = m.with_rates(m.confusion(t.predictions, ["type", "method"]))
    return out.select("type", "method", "support", "fake_call_rate", "real_fpr", "fake_miss_rate")


@case(
    "q_M14_utility_metrics",
    """SELECT method, seed, r9(recall) AS recall, r9(specificity) AS specificity, r9(1 - specificity) AS real_fpr,
              r9(1 - recall) AS fake_miss_rate, n_samples, r9((tp + fp) / n_samples) AS predicted_positive_rate,
              r9(recall + specificity - 4 * (1 - specificity) - 1.5 * (1 - recall)) AS utility
       FROM (SELECT *, tn / greatest(tn + fp, 1)::DOUBLE AS specificity FROM runs) r""",
)
def _(t):
    out = m.utility(m.confusion(t.predictions, RUN))
    return out.select(
        *RUN, "recall", "specificity", "real_fpr", "fake_miss_rate", "n_samples", "predicted_positive_rate", "utility"
    )


def triage_sql(low="0.2", high="0.8", prefix="", score="score", shown="r9"):
    r, f = f"({score} <= {low})", f"({score} >= {high})"
    n = lambda c: f"count(*) FILTER ({c})"
    return f"""
    {shown}({n(f'{r} OR {f}')} / count(*)) AS {prefix}coverage,
    {shown}({n(f'NOT ({r} OR {f})')} / count(*)) AS {prefix}uncertain_rate,
    {shown}(({n(f'{r} AND y_true = 0')} + {n(f'{f} AND y_true = 1')}) / nullif({n(f'{r} OR {f}')}, 0)) AS {prefix}triage_accuracy,
    {shown}({n(f)} / count(*)) AS {prefix}fake_call_rate,
    {shown}({n(r)} / count(*)) AS {prefix}real_call_rate,
    {shown}({n(f'{f} AND y_true = 1')} / nullif({n(f)}, 0)) AS {prefix}fake_precision,
    {shown}({n(f'{r} AND y_true = 0')} / nullif({n(r)}, 0)) AS {prefix}real_precision,
    {shown}({n(f'{f} AND y_true = 0')} / greatest({n('y_true = 0')}, 1)) AS {prefix}real_fpr,
    {shown}({n(f'{r} AND y_true = 1')} / greatest({n('y_true = 1')}, 1)) AS {prefix}fake_false_clearance,
    {shown}({n(f'{f} AND y_true = 1')} / greatest({n('y_true = 1')}, 1)) AS {prefix}fake_detection,
    {shown}({n(f'{r} AND y_true = 0')} / greatest({n('y_true = 0')}, 1)) AS {prefix}real_clearance"""


@case("q_M15_triage_metrics", f"SELECT method, seed, {triage_sql()} FROM predictions GROUP BY method, seed")
def _(t):
    return m.triage_metrics(t.predictions, RUN, 0.2, 0.8)


@case(
    "q_M16_score_stats",
    """SELECT method, seed, count(*) AS n_samples, r9(avg(y_true)) AS positive_rate,
              r9(avg(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END)) AS predicted_positive_rate,
              r9(avg(score)) AS score_mean, r9(stddev_pop(score)) AS score_std,
              r9(min(score)) AS score_min, r9(max(score)) AS score_max
       FROM predictions GROUP BY method, seed""",
)
def _(t):
    return m.score_stats(t.predictions, RUN)


@case(
    "q_M17_selection_objective",
    OPERATING.format(more=", r9(audet_proxy + 0.2 * apcer) AS selection_objective"),
)
def _(t):
    return m.selection_objective(m.operating_metrics(t.predictions, METHOD))


@case(
    "q_M18_type_accuracy",
    """SELECT method, r9(avg(CASE WHEN (CASE WHEN score >= 0.6 THEN 'error' WHEN score >= 0.3 THEN 'click' ELSE 'view' END) = type
                              THEN 1 ELSE 0 END)) AS type_accuracy FROM predictions GROUP BY method""",
)
def _(t):
    guess = F.when(F.col("score") >= 0.6, "error").when(F.col("score") >= 0.3, "click").otherwise("view")
    return m.type_accuracy(t.predictions.withColumn("guess", guess), METHOD, "guess", "type")
