"""Held-out sources, model choice and triage."""

from pyspark.sql import functions as F

from sieveline.functions.scalar import path_key
from sieveline.operators import holdout as e, metrics as m, thresholds as h, triage as tr
from sieveline.suite.q_metrics import triage_sql
from sieveline.suite.q_sampling import hash_sql, tie_sql
from sieveline.suite.q_thresholds import ACC, calibrated_sql, pick
from sieveline.suite.registry import SHARED, case
from sieveline.suite.sqlparts import bundle, candidates, cells, curve

# ---- folds ------------------------------------------------------------------

SHARED["held_keys"] = f"""
    SELECT path_key FROM (SELECT path_key, count(*) OVER () AS n, row_number() OVER (ORDER BY {hash_sql('path_key', '11')}, {tie_sql('path_key')}) AS r
                          FROM (SELECT DISTINCT lower(path) AS path_key FROM predictions_wide WHERE y_true = 0) k) x
    WHERE r <= least(n - 1, greatest(1, round_even(n * 0.3::DOUBLE, 0)))"""
SHARED["fold_rows"] = """
    SELECT p.method, p.y_true, p.score, f.fold,
           CASE WHEN (p.y_true = 0 AND k.path_key IS NOT NULL) OR (p.y_true = 1 AND p.source_label = f.fold) THEN 'test' ELSE 'calibration' END AS role
    FROM predictions p LEFT JOIN held_keys k ON lower(p.path) = k.path_key,
         (SELECT DISTINCT source_label AS fold FROM predictions WHERE y_true = 1) f"""


def slices(t):
    rows = e.with_real_part(t.predictions.withColumn("path_key", path_key("path")), "path_key", 0.3, 11)
    return e.slice_histogram(rows, ["method"], "source_label")


def folds(t):
    return e.usable_folds(e.fold_histogram(slices(t), ["method"]), ["method"])


@case(
    "q_E01_holdout_folds",
    """SELECT method, fold, count(*) FILTER (role = 'calibration' AND y_true = 0) AS calibration_real, count(*) FILTER (role = 'calibration' AND y_true = 1) AS calibration_fake,
              count(*) FILTER (role = 'test' AND y_true = 0) AS test_real, count(*) FILTER (role = 'test' AND y_true = 1) AS test_fake
       FROM fold_rows GROUP BY method, fold""",
)
def _(t):
    return e.fold_sizes(slices(t), ["method"])


SHARED["fold_curve"] = curve("fold_rows", "method, fold, role")
SHARED["fold_cand"] = candidates("fold_curve", "method, fold, role")
SHARED["fold_best"] = pick("fold_cand", "method, fold, role", ACC)
SHARED["fold_auc"] = bundle("fold_rows", "method, fold, role")
SHARED["holdout_report"] = f"""
    WITH c AS (SELECT method, fold, threshold AS source_threshold, {ACC} AS calibration_accuracy FROM fold_best WHERE role = 'calibration'),
    o AS (SELECT method, fold, threshold AS oracle_threshold, {ACC} AS oracle_accuracy, 2 * tp / (2 * tp + fp + fn)::DOUBLE AS oracle_f1 FROM fold_best WHERE role = 'test'),
    d AS (SELECT method, fold, {cells()} FROM fold_rows WHERE role = 'test' GROUP BY ALL),
    s AS (SELECT method, fold, {cells('source_threshold')} FROM fold_rows JOIN c USING (method, fold) WHERE role = 'test' GROUP BY method, fold)
    SELECT c.method, c.fold, source_threshold, calibration_accuracy, oracle_threshold, oracle_accuracy, oracle_f1, a.roc_auc,
           d.tn + d.fp AS test_real, d.fn + d.tp AS test_fake,
           (d.tp + d.tn) / (d.tp + d.tn + d.fp + d.fn)::DOUBLE AS default_accuracy, 2 * d.tp / (2 * d.tp + d.fp + d.fn)::DOUBLE AS default_f1,
           (s.tp + s.tn) / (s.tp + s.tn + s.fp + s.fn)::DOUBLE AS source_threshold_accuracy, 2 * s.tp / (2 * s.tp + s.fp + s.fn)::DOUBLE AS source_threshold_f1,
           s.fp / (s.fp + s.tn)::DOUBLE AS real_fpr, s.tp / (s.tp + s.fn)::DOUBLE AS fake_detection
    FROM c JOIN o USING (method, fold) JOIN d USING (method, fold) JOIN s USING (method, fold)
    JOIN (SELECT * FROM fold_auc WHERE role = 'test') a USING (method, fold)"""
_REPORT = [
    "source_threshold", "calibration_accuracy", "oracle_threshold", "oracle_accuracy", "oracle_f1", "roc_auc", "default_accuracy",
    "default_f1", "source_threshold_accuracy", "source_threshold_f1", "real_fpr", "fake_detection",
]


@case(
    "q_E02_holdout_threshold_report",
    "SELECT method, fold, test_real, test_fake, " + ", ".join(f"r9({c}) AS {c}" for c in _REPORT) + " FROM holdout_report",
)
def _(t):
    return e.holdout_report(slices(t), ["method"])


@case("q_E03_holdout_method_summary")
def _(t):
    report = e.holdout_report(slices(t), ["method"])
    return e.holdout_summary(
        report, ["method"], ["default_accuracy", "source_threshold_accuracy", "oracle_accuracy", "roc_auc"], seed=7
    )


_SUMMED = ["default_accuracy", "source_threshold_accuracy", "oracle_accuracy", "roc_auc"]


@case(
    "q_E03_holdout_method_means",
    f"""SELECT method, metric, count(*) AS n, r9(avg(value)) AS mean
        FROM (SELECT method, unnest([{', '.join(repr(c) for c in _SUMMED)}]) AS metric, unnest([{', '.join(_SUMMED)}]) AS value FROM holdout_report) l GROUP BY ALL""",
)
def _(t):
    return e.holdout_summary(e.holdout_report(slices(t), ["method"]), ["method"], _SUMMED, seed=7).drop("ci_low", "ci_high")


# ---- candidates: methods as candidates, two domains by path hash --------------

SHARED["domain_rows"] = """
    SELECT *, CASE WHEN substr(sha256(path), 1, 1) < '8' THEN 'source' ELSE 'target' END AS domain FROM predictions"""
SHARED["domain_source"] = "SELECT * FROM domain_rows WHERE domain = 'source'"
SHARED["domain_curve"] = curve("domain_source", "method, seed")
SHARED["domain_cand"] = candidates("domain_curve", "method, seed")
SHARED["domain_best"] = pick("domain_cand", "method, seed", ACC)


def domains(t):
    rows = t.predictions.withColumn("domain", F.when(F.substring(F.sha2("path", 256), 1, 1) < "8", "source").otherwise("target"))
    source, target = rows.where("domain = 'source'"), rows.where("domain = 'target'")
    return source, target, h.best_threshold(source, ["method", "seed"])


def _decision(prefix):
    rec, spec = "tp / greatest(tp + fn, 1)::DOUBLE", "tn / greatest(tn + fp, 1)::DOUBLE"
    n = "(tp + tn + fp + fn)::DOUBLE"
    return f"""{rec} + {spec} - 4 * (1 - {spec}) - 1.5 * (1 - {rec}) AS {prefix}_utility, (tp + tn) / {n} AS {prefix}_accuracy,
        tp / greatest(tp + fp, 1)::DOUBLE AS {prefix}_precision, {rec} AS {prefix}_recall, {spec} AS {prefix}_specificity,
        1 - {spec} AS {prefix}_real_fpr, 1 - {rec} AS {prefix}_fake_miss_rate, (tp + fp) / {n} AS {prefix}_predicted_positive_rate"""


SHARED["cand_cells"] = f"""
    SELECT method, seed, domain, any_value(threshold) AS threshold, {cells('threshold')}
    FROM (SELECT d.method, d.seed, d.domain, d.score, d.y_true, b.threshold FROM domain_rows d JOIN domain_best b USING (method, seed)) x GROUP BY method, seed, domain"""
SHARED["cand_metrics"] = f"""
    SELECT * FROM (SELECT method, seed, threshold, {_decision('source')} FROM cand_cells WHERE domain = 'source') a
    JOIN (SELECT method, seed, {_decision('target')} FROM cand_cells WHERE domain = 'target') b USING (method, seed)"""
_DEC = lambda p: ", ".join(f"r9({p}_{c}) AS {p}_{c}" for c in e.DECISION)


@case(
    "q_E04_candidate_source_metrics",
    f"SELECT method, seed, r9(threshold) AS threshold, {_DEC('source')}, {_DEC('target')} FROM cand_metrics",
)
def _(t):
    return e.candidate_metrics(*domains(t), ["method", "seed"])


SHARED["cand_folds"] = f"""
    SELECT method, seed, threshold, fold AS heldout_source, {_decision('holdout')}, tn + fp + fn + tp AS holdout_n_samples
    FROM (SELECT method, seed, fold, any_value(threshold) AS threshold, {cells('threshold')}
          FROM (SELECT d.method, d.seed, d.score, d.y_true, b.threshold, f.fold
                FROM domain_source d JOIN domain_best b USING (method, seed), (SELECT unnest([1, 2, 3, 4, 5]) AS fold) f
                WHERE d.y_true = 0 OR d.source_label = f.fold) x GROUP BY method, seed, fold) y"""


@case(
    "q_E05_candidate_holdout_metrics",
    f"SELECT method, seed, r9(threshold) AS threshold, heldout_source, {_DEC('holdout')}, holdout_n_samples FROM cand_folds",
)
def _(t):
    source, _, limits = domains(t)
    return e.candidate_holdouts(source, limits, ["method", "seed"])


CHOICE = """
    SELECT '{label}' AS policy, seed, method, r9(utility_mean) AS utility_mean, r9(utility_min) AS utility_min, r9(threshold) AS threshold,
           r9(source_predicted_positive_rate) AS source_predicted_positive_rate, r9(target_accuracy) AS target_accuracy
    FROM (SELECT method, seed, avg(holdout_utility) AS utility_mean, min(holdout_utility) AS utility_min FROM cand_folds GROUP BY method, seed) u
    JOIN cand_metrics USING (method, seed) WHERE {where}
    QUALIFY row_number() OVER (PARTITION BY seed ORDER BY {by} DESC, source_predicted_positive_rate, method) = 1"""


@case(
    "q_E06_candidate_choice",
    CHOICE.format(label="holdout_mean_unconstrained", where="true", by="utility_mean")
    + " UNION ALL "
    + CHOICE.format(label="holdout_min_cap_0p45", where="source_predicted_positive_rate <= 0.45::DOUBLE + 1e-12::DOUBLE", by="utility_min"),
)
def _(t):
    source, target, limits = domains(t)
    runs = e.candidate_metrics(source, target, limits, ["method", "seed"])
    per_fold = e.candidate_holdouts(source, limits, ["method", "seed"])
    both = [e.choose_candidates(per_fold, runs, "method", mode, cap) for mode, cap in (("mean", None), ("min", 0.45))]
    return both[0].unionByName(both[1]).select(
        "policy", "seed", "method", "utility_mean", "utility_min", "threshold", "source_predicted_positive_rate", "target_accuracy"
    )


# ---- triage -----------------------------------------------------------------

FPRS, CLEARS = (0.0, 0.01, 0.05), (0.0, 0.02, 0.1)


def limits_sql(curve_name, keys):
    """Both limits as plain numbers, with the engine's own nextafter, by grid point."""
    return f"""
    SELECT {keys}, max_real_fpr, max_fake_clearance, f AS fake_limit,
           CASE WHEN r >= f THEN nextafter(f, 0.0::DOUBLE) ELSE r END AS real_limit
    FROM (SELECT {keys}, a.max_real_fpr, b.max_fake_clearance,
                 CASE WHEN floor(a.max_real_fpr * any_value(neg_all)) <= 0 THEN nextafter(max(CASE WHEN neg > 0 THEN score END), 1.0::DOUBLE)
                      ELSE max(CASE WHEN neg_below <= neg_all - floor(a.max_real_fpr * neg_all) AND neg_all - floor(a.max_real_fpr * neg_all) < neg_below + neg THEN score END) END AS f,
                 CASE WHEN floor(b.max_fake_clearance * any_value(pos_all)) <= 0 THEN nextafter(min(CASE WHEN pos > 0 THEN score END), 0.0::DOUBLE)
                      ELSE max(CASE WHEN pos_below <= floor(b.max_fake_clearance * pos_all) - 1 AND floor(b.max_fake_clearance * pos_all) - 1 < pos_below + pos THEN score END) END AS r
          FROM {curve_name}, (VALUES {', '.join(f'({v}::DOUBLE)' for v in FPRS)}) a(max_real_fpr), (VALUES {', '.join(f'({v}::DOUBLE)' for v in CLEARS)}) b(max_fake_clearance)
          GROUP BY {keys}, a.max_real_fpr, b.max_fake_clearance) x"""


SHARED["triage_limits_m"] = limits_sql("curve_m", "method")


@case(
    "q_R01_triage_thresholds",
    """SELECT method, max_real_fpr, max_fake_clearance, r9(real_limit) AS real_threshold, r9(fake_limit) AS fake_threshold,
              real_limit NOT IN (SELECT score FROM curve_m c WHERE c.method = l.method) AS real_strict,
              fake_limit NOT IN (SELECT score FROM curve_m c WHERE c.method = l.method) AS fake_strict
       FROM triage_limits_m l""",
)
def _(t):
    grid = tr.limit_grid(FPRS, CLEARS)
    return tr.triage_thresholds(m.running(t.predictions, ["method"]), ["method"], grid)


SHARED["fold_cal"] = "SELECT * FROM fold_rows WHERE role = 'calibration'"
SHARED["fold_modes"] = calibrated_sql("modes", "fold_cal", "fold_rows", "method, fold", "role, y_true, score")
SHARED["mode_rows"] = """
    SELECT method, fold, 'raw' AS score_mode, NULL::DOUBLE AS temperature, role, y_true, score FROM fold_rows
    UNION ALL
    SELECT method, fold, calibrator, temperature, role, y_true, cal FROM fold_modes"""


@case(
    "q_R02_score_mode_transform",
    """SELECT method, fold, score_mode, role, r9(temperature) AS temperature, sum(y_true)::BIGINT AS pos, sum(1 - y_true)::BIGINT AS neg,
              r9(avg(score)) AS mean_score FROM mode_rows GROUP BY ALL""",
)
def _(t):
    rows = tr.with_score_modes(folds(t), ["method", "fold"])
    n = F.col("pos") + F.col("neg")
    return rows.groupBy("method", "fold", "score_mode", "temperature", "role").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), (F.sum(F.col("score") * n) / F.sum(n)).alias("mean_score")
    )


SHARED["mode_cal"] = "SELECT * FROM mode_rows WHERE role = 'calibration'"
SHARED["mode_curve"] = curve("mode_cal", "method, fold, score_mode")
SHARED["mode_limits"] = limits_sql("mode_curve", "method, fold, score_mode")
TRIAGE_NAMES = [
    "coverage", "uncertain_rate", "triage_accuracy", "fake_call_rate", "real_call_rate", "fake_precision", "real_precision",
    "real_fpr", "fake_false_clearance", "fake_detection", "real_clearance",
]


# the SQL check puts the limits between two scores the way the operator does: 4 ulps of slack for exp()
def _side(role):
    return f"""SELECT method, fold, score_mode, max_real_fpr, max_fake_clearance, any_value(temperature) AS temperature,
                      any_value(real_limit) AS real_limit, any_value(fake_limit) AS fake_limit, count(*) AS {role}_samples,
                      {triage_sql('real_limit', 'fake_limit', role + '_', shown='')}
               FROM mode_rows JOIN mode_limits USING (method, fold, score_mode) WHERE role = '{role}'
               GROUP BY method, fold, score_mode, max_real_fpr, max_fake_clearance"""


SHARED["triage_report"] = f"""
    SELECT c.*, t.* EXCLUDE (method, fold, score_mode, max_real_fpr, max_fake_clearance, temperature, real_limit, fake_limit)
    FROM ({_side('calibration')}) c JOIN ({_side('test')}) t USING (method, fold, score_mode, max_real_fpr, max_fake_clearance)"""
_RATES = ", ".join(
    f"{p}_samples, " + ", ".join(f"r9({p}_{n}) AS {p}_{n}" for n in TRIAGE_NAMES) for p in ("calibration", "test")
)


def report(t):
    return tr.triage_report(folds(t), ["method", "fold"], tr.MODES, tr.limit_grid(FPRS, CLEARS))


@case(
    "q_R03_triage_report",
    f"""SELECT method, fold, score_mode, max_real_fpr, max_fake_clearance, r9(temperature) AS temperature, r9(real_limit) AS real_threshold,
               r9(fake_limit) AS fake_threshold, {_RATES} FROM triage_report""",
)
def _(t):
    return report(t).drop("real_strict", "fake_strict")


_UTIL = lambda p: f"{p}_fake_detection + {p}_real_clearance - 4 * {p}_real_fpr - 1.5 * {p}_fake_false_clearance"


@case(
    "q_R04_triage_tuning",
    f"""SELECT method, fold, score_mode, max_real_fpr, max_fake_clearance, r9({_UTIL('calibration')}) AS calibration_utility,
               r9({_UTIL('test')}) AS test_utility, r9(calibration_coverage) AS calibration_coverage, r9(test_coverage) AS test_coverage,
               r9(test_triage_accuracy) AS test_triage_accuracy
        FROM triage_report
        QUALIFY row_number() OVER (PARTITION BY method, fold ORDER BY round({_UTIL('calibration')}, 8) DESC, calibration_coverage DESC,
                                   calibration_triage_accuracy DESC, max_real_fpr, max_fake_clearance, score_mode) = 1""",
)
def _(t):
    best = tr.triage_tuning(report(t), ["method", "fold"])
    return best.select(
        "method", "fold", "score_mode", "max_real_fpr", "max_fake_clearance", "calibration_utility", "test_utility",
        "calibration_coverage", "test_coverage", "test_triage_accuracy",
    )
