"""Threshold selection and score calibration."""

from pyspark.sql import functions as F

from sieveline.operators import calibration as c
from sieveline.operators import thresholds as h
from sieveline.suite.registry import SHARED, case
from sieveline.suite.sqlparts import bundle, candidates, cells, curve, det, point

SHARED["cand_m"] = candidates("curve_m", "method")
SHARED["curve_ms"] = curve("predictions", "method, seed")
SHARED["cand_ms"] = candidates("curve_ms", "method, seed")
SHARED["det_ms"] = det("curve_ms", "method, seed")
SHARED["point_ms"] = point("det_ms", "method, seed")

ACC = "(tp + tn)::DOUBLE / (tp + tn + fp + fn)::DOUBLE"
REC = "(tp::DOUBLE / greatest(tp + fn, 1)::DOUBLE)"
SPEC = "(tn::DOUBLE / greatest(tn + fp, 1)::DOUBLE)"
PREC = "(tp::DOUBLE / greatest(tp + fp, 1)::DOUBLE)"
F1 = f"(CASE WHEN {PREC} + {REC} = 0 THEN 0 ELSE 2.0::DOUBLE * {PREC} * {REC} / ({PREC} + {REC}) END)"
RATE = "((tp + fp)::DOUBLE / (tp + fp + tn + fn)::DOUBLE)"


def weighted(fd, rc, fp, mp):
    return f"({fd}::DOUBLE * {REC} + {rc}::DOUBLE * {SPEC} - {fp}::DOUBLE * (1.0::DOUBLE - {SPEC}) - {mp}::DOUBLE * (1.0::DOUBLE - {REC}))"


def pick(source, keys, objective, tie="abs(threshold - 0.5::DOUBLE)", where="true"):
    return f"""SELECT {keys}, threshold, objective, tn, fp, fn, tp
        FROM (SELECT *, {objective} AS objective FROM {source} WHERE {where}) o
        QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY objective DESC, {tie}, threshold) = 1"""


@case("q_H01_threshold_candidates", "SELECT method, r9(threshold) AS threshold FROM cand_m")
def _(t):
    return h.threshold_candidates(t.predictions, ["method"])


@case(
    "q_H02_best_threshold",
    f"""SELECT 'accuracy' AS goal, method, seed, r9(threshold) AS threshold, r9(objective) AS objective, tn, fp, fn, tp
        FROM ({pick('cand_ms', 'method, seed', ACC)}) a
        UNION ALL
        SELECT 'f1', method, seed, r9(threshold), r9(objective), tn, fp, fn, tp
        FROM ({pick('cand_ms', 'method, seed', F1)}) f""",
)
def _(t):
    keys = ["method", "seed"]
    both = [
        h.best_threshold(t.predictions, keys, goal).withColumn("goal", F.lit(goal)) for goal in ("accuracy", "f1")
    ]
    return both[0].unionByName(both[1])


STRATEGIES = {
    "source_accuracy": ("near_half", None, ACC, "abs(threshold - 0.5::DOUBLE)"),
    "source_balanced_accuracy": ("higher", None, f"({REC} + {SPEC}) / 2.0::DOUBLE", "threshold DESC"),
    "source_f1": ("lower", 0.5, f"2.0::DOUBLE * {PREC} * {REC} / greatest({PREC} + {REC}, 1e-12::DOUBLE)", "threshold"),
    "source_utility": ("higher", 0.45, weighted(0.5, 0.5, 1, 1), "threshold DESC"),
    "source_youden": ("near_half", 0.3, f"{REC} + {SPEC} - 1.0::DOUBLE", "abs(threshold - 0.5::DOUBLE)"),
}


@case(
    "q_H03_select_source_threshold",
    "\nUNION ALL\n".join(
        f"""SELECT '{name}' AS strategy, method, r9(threshold) AS threshold, r9(objective) AS objective, tn, fp, fn, tp,
                   r9({RATE}) AS positive_rate
            FROM ({pick('cand_m', 'method', goal, tie, 'true' if cap is None else f'{RATE} <= {cap}::DOUBLE + 1e-12::DOUBLE')}) p{i}"""
        for i, (name, (_, cap, goal, tie)) in enumerate(STRATEGIES.items())
    ),
)
def _(t):
    out = None
    for name, (tie, cap, _, _) in STRATEGIES.items():
        one = h.select_source_threshold(t.predictions, ["method"], name, tie, cap).withColumn("strategy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@case(
    "q_H04_bpcer_threshold",
    """SELECT p.method, p.seed, r9(p.threshold) AS threshold, strict, r9(bpcer) AS bpcer, r9(apcer) AS apcer,
              count(*) AS n_rows,
              r9(avg(CASE WHEN (CASE WHEN strict THEN score > threshold ELSE score >= threshold END) = (y_true = 1) THEN 1 ELSE 0 END)) AS accuracy,
              count(*) FILTER (CASE WHEN strict THEN score > threshold ELSE score >= threshold END) AS n_called_attack,
              count(*) FILTER (NOT (CASE WHEN strict THEN score > threshold ELSE score >= threshold END)) AS n_called_genuine
       FROM predictions p JOIN point_ms q ON p.method = q.method AND p.seed = q.seed
       GROUP BY ALL""".replace("p.threshold", "q.threshold"),
)
def _(t):
    return h.operating_threshold_report(t.predictions, ["method", "seed"])


CAPS, FD, RC, RFP, FMP = (None, 0.48, 0.3), (1.0,), (1.0, 0.5), (4.0, 1.0), (1.5,)
POLICIES = [
    (h_cap, fd, rc, rfp, fmp) for h_cap in CAPS for fd in FD for rc in RC for rfp in RFP for fmp in FMP
]


def _policy_values():
    from sieveline.functions.scalar import policy_label

    rows = [
        f"('{policy_label(*p)}', {'NULL' if p[0] is None else p[0]}::DOUBLE, {p[1]}::DOUBLE, {p[2]}::DOUBLE, {p[3]}::DOUBLE, {p[4]}::DOUBLE)"
        for p in POLICIES
    ]
    return "(VALUES " + ", ".join(rows) + ") g(policy, cap, w_fd, w_rc, p_fpr, p_miss)"


U = f"w_fd * {REC} + w_rc * {SPEC} - p_fpr * (1.0::DOUBLE - {SPEC}) - p_miss * (1.0::DOUBLE - {REC})"
SHARED["sweep_source"] = "SELECT * FROM predictions WHERE method = 'alpha'"
SHARED["sweep_target"] = "SELECT * FROM predictions WHERE method = 'beta'"
SHARED["sweep_curve"] = curve("sweep_source", "seed")
SHARED["sweep_cand"] = candidates("sweep_curve", "seed")
SHARED["sweep_chosen"] = f"""
    SELECT seed, policy, cap, w_fd, w_rc, p_fpr, p_miss, threshold, objective AS threshold_source_utility, tn, fp, fn, tp
    FROM (SELECT *, {U} AS objective FROM sweep_cand, {_policy_values()}
          WHERE cap IS NULL OR {RATE} <= cap + 1e-12::DOUBLE) o
    QUALIFY row_number() OVER (PARTITION BY seed, policy ORDER BY objective DESC, threshold DESC) = 1
    UNION ALL
    SELECT seed, 'fixed_0p5', NULL, 1, 1, 1, 1, 0.5, NULL, tn, fp, fn, tp
    FROM (SELECT seed, {cells()} FROM sweep_source GROUP BY seed) f"""


def _side(prefix):
    return f"""{U} AS {prefix}_utility, {ACC} AS {prefix}_accuracy, {PREC} AS {prefix}_precision,
        {REC} AS {prefix}_recall, {RATE} AS {prefix}_predicted_positive_rate"""


SHARED["sweep_target_cells"] = f"""
    SELECT g.policy, g.seed, g.w_fd, g.w_rc, g.p_fpr, g.p_miss, k.tn, k.fp, k.fn, k.tp
    FROM sweep_chosen g
    JOIN (SELECT policy, seed, {cells('limit_at')}
          FROM (SELECT c.policy, c.seed, c.threshold AS limit_at, p.score, p.y_true
                FROM sweep_chosen c JOIN sweep_target p ON p.seed = c.seed) r
          GROUP BY policy, seed) k USING (policy, seed)"""
SHARED["sweep_detail"] = f"""
    SELECT a.*, b.* EXCLUDE (policy, seed)
    FROM (SELECT seed, policy, cap, w_fd, w_rc, p_fpr, p_miss, threshold, threshold_source_utility, {_side('source')}
          FROM sweep_chosen) a
    JOIN (SELECT policy, seed, {_side('target')} FROM sweep_target_cells) b
      ON a.policy = b.policy AND a.seed = b.seed"""

SWEEP_VALUES = [
    f"{side}_{v}"
    for side in ("source", "target")
    for v in ("utility", "accuracy", "precision", "recall", "predicted_positive_rate")
] + ["threshold"]


def _sweep(t):
    p = t.predictions.select("seed", "y_true", "score", "method")
    grid = h.policy_grid(CAPS, FD, RC, RFP, FMP)
    return h.policy_sweep(
        p.where(F.col("method") == "alpha"), p.where(F.col("method") == "beta"), ["seed"], grid
    )


@case(
    "q_H05_threshold_policy_sweep",
    """SELECT policy, r9(cap) AS cap, r9(w_fd) AS w_fd, r9(w_rc) AS w_rc, r9(p_fpr) AS p_fpr, r9(p_miss) AS p_miss,
              count(DISTINCT seed) AS n_seeds, """
    + ", ".join(f"r9(avg({v})) AS {v}_mean, r9(coalesce(stddev_samp({v}), 0)) AS {v}_std" for v in SWEEP_VALUES)
    + " FROM sweep_detail GROUP BY policy, cap, w_fd, w_rc, p_fpr, p_miss",
)
def _(t):
    detail = _sweep(t).drop("threshold_source_utility")
    return h.policy_summary(detail)


@case(
    "q_H05_threshold_policy_detail",
    "SELECT seed, policy, r9(cap) AS cap, r9(w_fd) AS w_fd, r9(w_rc) AS w_rc, r9(p_fpr) AS p_fpr, r9(p_miss) AS p_miss, "
    "r9(threshold_source_utility) AS threshold_source_utility, "
    + ", ".join(f"r9({v}) AS {v}" for v in SWEEP_VALUES)
    + " FROM sweep_detail",
)
def _(t):
    return _sweep(t)


SHARED["curve_v"] = curve("variants", "variant")
SHARED["cand_v"] = candidates("curve_v", "variant")
SHARED["best_v"] = pick("cand_v", "variant", ACC)


@case(
    "q_H06_transfer_threshold_report",
    f"""WITH lim AS (SELECT threshold AS clean_threshold FROM best_v WHERE variant = 'clean'),
        d AS (SELECT variant, {cells()} FROM variants GROUP BY variant),
        k AS (SELECT variant, any_value(clean_threshold) AS clean_threshold, {cells('clean_threshold')}
              FROM variants, lim GROUP BY variant)
        SELECT b.variant, r9(k.clean_threshold) AS clean_threshold, r9(b.threshold) AS oracle_threshold,
               r9((d.tp + d.tn) / (d.tp + d.tn + d.fp + d.fn)) AS default_accuracy,
               r9(2 * d.tp / (2 * d.tp + d.fp + d.fn)) AS default_f1,
               r9((k.tp + k.tn) / (k.tp + k.tn + k.fp + k.fn)) AS clean_accuracy,
               r9(2 * k.tp / (2 * k.tp + k.fp + k.fn)) AS clean_f1,
               r9((b.tp + b.tn) / (b.tp + b.tn + b.fp + b.fn)) AS oracle_accuracy,
               r9(2 * b.tp / (2 * b.tp + b.fp + b.fn)) AS oracle_f1
        FROM best_v b JOIN d ON d.variant = b.variant JOIN k ON k.variant = b.variant""",
)
def _(t):
    return h.transfer_threshold_report(t.variants, "variant", "clean")


WEIGHT = """SELECT method, seed, y_true, n_label, r9(sum(n_label) OVER (PARTITION BY method, seed) / greatest(2.0 * n_label, 1)) AS weight
            FROM (SELECT method, seed, y_true, count(*) AS n_label FROM predictions GROUP BY ALL) c"""


@case("q_K01_class_balanced_weight", WEIGHT)
def _(t):
    return c.class_balanced_weights(t.predictions, ["method", "seed"])


P = "greatest(least(1 / (1 + exp(-greatest(least(ln(q / (1 - q)) / temperature, 60.0::DOUBLE), -60.0::DOUBLE))), 0.999999::DOUBLE), 1e-6::DOUBLE)"
Q = "greatest(least(score, 0.999999::DOUBLE), 1e-6::DOUBLE)"


def temperature_parts(prefix, balanced, source="predictions", keys="method"):
    """Coarse and fine grid over distinct scores, as CTEs `<prefix>_fit`."""
    weight = lambda k: f"(tot / (2.0::DOUBLE * tot_{k}))" if balanced else "1.0::DOUBLE"
    best = lambda grid: f"""
        SELECT {keys}, temperature, loss FROM (
          SELECT {keys}, i, temperature,
                 sum(-(wp * ln({P}) + wn * ln(1 - {P}))) / sum(wp + wn) AS loss
          FROM {grid} GROUP BY {keys}, i, temperature) l
        QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY loss, i) = 1"""
    lo, hi = "greatest(t / 2, 0.01)", "least(t * 2, 100.0)"
    SHARED[f"{prefix}_hist"] = f"""
        SELECT {keys}, {Q} AS q, n1 * {weight(1)} AS wp, n0 * {weight(0)} AS wn
        FROM (SELECT *, sum(n1) OVER g AS tot_1, sum(n0) OVER g AS tot_0, sum(n1 + n0) OVER g AS tot
              FROM (SELECT {keys}, score, count(*) FILTER (y_true = 1) AS n1, count(*) FILTER (y_true = 0) AS n0
                    FROM {source} GROUP BY ALL) a WINDOW g AS (PARTITION BY {keys})) b"""
    SHARED[f"{prefix}_coarse_grid"] = f"""
        SELECT h.*, i, exp(ln(0.05::DOUBLE) + i * (ln(20.0::DOUBLE) - ln(0.05::DOUBLE)) / 239) AS temperature
        FROM {prefix}_hist h, range(240) r(i)"""
    SHARED[f"{prefix}_coarse"] = best(f"{prefix}_coarse_grid")
    SHARED[f"{prefix}_fine_grid"] = f"""
        SELECT h.*, i, exp(ln({lo}) + i * (ln({hi}) - ln({lo})) / 239) AS temperature
        FROM {prefix}_hist h JOIN (SELECT {keys}, temperature AS t FROM {prefix}_coarse) c USING ({keys}), range(240) r(i)"""
    SHARED[f"{prefix}_fit"] = best(f"{prefix}_fine_grid")


temperature_parts("temp_plain", False)
temperature_parts("temp_even", True)


@case("q_K02_temperature_fit", "SELECT method, r9(temperature) AS temperature, r9(loss) AS loss FROM temp_plain_fit")
def _(t):
    return c.temperature_fit(t.predictions, ["method"])


@case("q_K03_temperature_balanced", "SELECT method, r9(temperature) AS temperature, r9(loss) AS loss FROM temp_even_fit")
def _(t):
    return c.temperature_fit(t.predictions, ["method"], balanced=True)


def platt_parts(prefix, balanced, source="predictions", keys="method"):
    """Newton steps from zero on the logit of distinct scores, as CTE `<prefix>_fit`; the slope's square holds it back."""
    weight = lambda k: f"(tot / (2.0::DOUBLE * tot_{k}))" if balanced else "1.0::DOUBLE"
    z = "(s.a * h.x + s.b)"
    p = f"(1 / (1 + exp(-{z})))"
    SHARED[f"{prefix}_hist"] = f"""
        SELECT {keys}, ln({Q} / (1 - {Q})) AS x, n1 * {weight(1)} AS wp, n0 * {weight(0)} AS wn
        FROM (SELECT *, sum(n1) OVER g AS tot_1, sum(n0) OVER g AS tot_0, sum(n1 + n0) OVER g AS tot
              FROM (SELECT {keys}, score, count(*) FILTER (y_true = 1) AS n1, count(*) FILTER (y_true = 0) AS n0
                    FROM {source} GROUP BY ALL) a WINDOW g AS (PARTITION BY {keys})) b"""
    step, previous = "", f"(SELECT DISTINCT {keys}, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM {prefix}_hist)"
    for i in range(12):
        sums = f"""
            SELECT {keys}, any_value(s.a) AS a, any_value(s.b) AS b,
                   sum(((wp + wn) * {p} - wp) * x) + any_value(s.a) AS ga, sum((wp + wn) * {p} - wp) AS gb,
                   sum((wp + wn) * {p} * (1 - {p}) * x * x) + 1 AS aa, sum((wp + wn) * {p} * (1 - {p}) * x) AS ab, sum((wp + wn) * {p} * (1 - {p})) AS bb
            FROM {prefix}_hist h JOIN {previous} s USING ({keys}) GROUP BY {keys}"""
        step = f"SELECT {keys}, a + (ab * gb - bb * ga) / (aa * bb - ab * ab) AS a, b + (ab * ga - aa * gb) / (aa * bb - ab * ab) AS b FROM ({sums}) n"
        SHARED[f"{prefix}_step{i}"], previous = step, f"{prefix}_step{i}"
    SHARED[f"{prefix}_fit"] = f"SELECT {keys}, a AS slope, b AS intercept FROM {previous}"


def isotonic_parts(prefix, balanced, source="predictions", keys="method"):
    """Fitted values of distinct scores, as CTE `<prefix>_fit`: the highest, over where a stretch begins, of its lowest mean.

    Stretches in which the mean never rises share one value whatever lies around
    them; a few rounds of joining those keep the table of all stretches small.
    """
    SHARED[f"{prefix}_join0"] = f"""
        SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY score) AS i, score AS lo, score AS hi, n1, n0
        FROM (SELECT {keys}, greatest(least(score, 1.0::DOUBLE), 0.0::DOUBLE) AS score, count(*) FILTER (y_true = 1) AS n1, count(*) FILTER (y_true = 0) AS n0
              FROM {source} GROUP BY ALL) a"""
    for k in range(6):
        SHARED[f"{prefix}_join{k + 1}"] = f"""
            SELECT {keys}, g AS i, min(lo) AS lo, max(hi) AS hi, sum(n1)::BIGINT AS n1, sum(n0)::BIGINT AS n0
            FROM (SELECT *, 1 + sum(rise) OVER (PARTITION BY {keys} ORDER BY i) AS g
                  FROM (SELECT *, CASE WHEN n1 * lag(n0) OVER o > lag(n1) OVER o * n0 THEN 1 ELSE 0 END AS rise
                        FROM {prefix}_join{k} WINDOW o AS (PARTITION BY {keys} ORDER BY i)) x) y
            GROUP BY {keys}, g"""
    share = lambda c: f"sum({c}) OVER r / sum({c}) OVER g" if balanced else f"sum({c}) OVER r"
    SHARED[f"{prefix}_cum"] = f"""
        SELECT {keys}, lo, hi, i, ({share('n1')})::DOUBLE AS p, ({share('n0')})::DOUBLE AS n
        FROM {prefix}_join6 WINDOW r AS (PARTITION BY {keys} ORDER BY i), g AS (PARTITION BY {keys})"""
    SHARED[f"{prefix}_from"] = f"""
        SELECT {keys}, i + 1 AS j, p, n FROM {prefix}_cum UNION ALL SELECT DISTINCT {keys}, 1, 0.0::DOUBLE, 0.0::DOUBLE FROM {prefix}_cum"""
    SHARED[f"{prefix}_fit"] = f"""
        SELECT {keys}, unnest(list_distinct([lo, hi])) AS score, y FROM (
          SELECT {keys}, lo, hi, max(m) AS y FROM (
            SELECT {keys}, c.lo, c.hi, c.i, f.j, min((c.p - f.p) / (c.p - f.p + c.n - f.n)) OVER (PARTITION BY {keys}, f.j ORDER BY c.i DESC) AS m
            FROM {prefix}_cum c JOIN {prefix}_from f USING ({keys}) WHERE f.j <= c.i) x
          GROUP BY {keys}, lo, hi) z"""


def isotonic_at(prefix, rows, keys):
    """CTE `<prefix>_at`: the fit at every score of `rows`, on the line between its neighbours."""
    both = lambda name: " AND ".join(f"{name}.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    SHARED[f"{prefix}_at"] = f"""
        SELECT s.*, round(CASE WHEN b.score IS NULL THEN a.y WHEN a.score IS NULL OR a.score = b.score THEN b.y
                               ELSE b.y + (s.score - b.score) / (a.score - b.score) * (a.y - b.y) END, 12) AS y
        FROM (SELECT DISTINCT {keys}, score FROM {rows}) s
        ASOF LEFT JOIN {prefix}_fit b ON {both('b')} AND s.score >= b.score
        ASOF LEFT JOIN {prefix}_fit a ON {both('a')} AND s.score <= a.score"""


platt_parts("platt_plain", False)
platt_parts("platt_even", True)
isotonic_parts("iso_plain", False)
isotonic_parts("iso_even", True)
isotonic_at("iso_plain", "predictions", "method")
isotonic_at("iso_even", "predictions", "method")
_LINE = f"1 / (1 + exp(-(slope * ln({Q} / (1 - {Q})) + intercept)))"
_SPREAD = "SELECT method, y_true, count(*) AS n, r9(avg(c)) AS mean, r9(min(c)) AS low, r9(max(c)) AS high FROM ({}) x GROUP BY ALL"


def _spread(t, name):
    """Every method's rows under its own fit, as mean and spread per class."""
    rows = t.predictions
    return c.calibrated(name, rows, rows, ["method"]).groupBy("method", "y_true").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("calibrated").alias("mean"),
        F.min("calibrated").alias("low"),
        F.max("calibrated").alias("high"),
    )


for _key, _name, _fit in (
    ("q_K04_platt_fit", "platt", "platt_plain"),
    ("q_K05_platt_balanced", "platt_balanced", "platt_even"),
    ("q_K06_isotonic_fit", "isotonic", "iso_plain"),
    ("q_K07_isotonic_balanced", "isotonic_balanced", "iso_even"),
):
    _value = f"SELECT method, y_true, {_LINE} AS c FROM predictions JOIN {_fit}_fit USING (method)"
    if _fit.startswith("iso"):
        _value = f"SELECT method, y_true, y AS c FROM predictions JOIN {_fit}_at USING (method, score)"
    case(_key, _SPREAD.format(_value))(lambda t, name=_name: _spread(t, name))


CAL = "1 / (1 + exp(-greatest(least(ln({q} / (1 - {q})) / temperature, 60.0::DOUBLE), -60.0::DOUBLE)))".format(q=Q)


@case(
    "q_K08_calibrated_apply",
    f"""SELECT id, method, r9({CAL}) AS calibrated FROM predictions JOIN temp_plain_fit USING (method)""",
)
def _(t):
    fitted = c.temperature_fit(t.predictions, ["method"])
    return c.temperature_apply(t.predictions, fitted, ["method"]).select("id", "method", "calibrated")


SHARED["cal_rows"] = "SELECT * FROM predictions WHERE seed <> 29"
SHARED["cal_test"] = "SELECT * FROM predictions WHERE seed = 29"


def calibrated_sql(prefix, fit_rows, rows, keys, extra):
    """`rows` under all six calibrators fitted on `fit_rows`: keys, calibrator, temperature, `extra` and cal."""
    own = f"{keys}, {extra}"
    forms = []
    for tag, balanced in (("plain", False), ("even", True)):
        ending = "_balanced" if balanced else ""
        for kind, make in (("temp", temperature_parts), ("platt", platt_parts), ("iso", isotonic_parts)):
            make(f"{prefix}_{kind}_{tag}", balanced, fit_rows, keys)
        forms.append(f"SELECT {own}, 'temperature{ending}' AS calibrator, temperature, {CAL} AS cal FROM {rows} JOIN {prefix}_temp_{tag}_fit USING ({keys})")
        forms.append(f"SELECT {own}, 'platt{ending}' AS calibrator, NULL::DOUBLE AS temperature, {_LINE} AS cal FROM {rows} JOIN {prefix}_platt_{tag}_fit USING ({keys})")
        isotonic_at(f"{prefix}_iso_{tag}", rows, keys)
        forms.append(f"SELECT {own}, 'isotonic{ending}' AS calibrator, NULL::DOUBLE AS temperature, y AS cal FROM {rows} JOIN {prefix}_iso_{tag}_at USING ({keys}, score)")
    return "\nUNION ALL\n".join(forms)


SHARED["cal_scored"] = calibrated_sql("rep", "cal_rows", "cal_test", "method", "y_true, score")
SHARED["cal_raw"] = bundle("cal_test", "method")
SHARED["cal_new"] = bundle("cal_scored", "method, calibrator", score="cal")
_NAMES = ("accuracy", "f1", "roc_auc", "brier_score", "expected_calibration_error", "maximum_calibration_error")


@case(
    "q_K09_calibration_report",
    "SELECT method, calibrator, r9(f.temperature) AS temperature, r.n_samples AS test_samples, "
    + ", ".join(f"r9({a}.{n}) AS {p}_{n}" for a, p in (("r", "raw"), ("k", "calibrated")) for n in _NAMES)
    + ", "
    + ", ".join(
        f"r9({a}.fp / ({a}.fp + {a}.tn)) AS {p}_real_fpr, r9({a}.tp / ({a}.tp + {a}.fn)) AS {p}_fake_detection"
        for a, p in (("r", "raw"), ("k", "calibrated"))
    )
    + ", "
    + ", ".join(f"r9(k.{n} - r.{n}) AS delta_{n}" for n in ("accuracy", "brier_score", "expected_calibration_error"))
    + " FROM (SELECT DISTINCT method, calibrator, temperature FROM cal_scored) f JOIN cal_raw r USING (method) JOIN cal_new k USING (method, calibrator)",
)
def _(t):
    p = t.predictions
    return c.calibration_report(p.where(F.col("seed") != 29), p.where(F.col("seed") == 29), ["method"])
