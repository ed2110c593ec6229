"""Score fusion."""

from pyspark.sql import functions as F

from sieveline.operators import fusion as u, metrics as m, runstats as r
from sieveline.suite.q_sampling import hash_sql
from sieveline.suite.registry import SHARED, case
from sieveline.suite.sqlparts import audet, bundle, curve, det, point

METHODS = ["alpha", "beta", "gamma"]


def wide(t):
    w = t.predictions_wide
    return w.select("id", "y_true", "type", F.col("s1").alias("alpha"), F.col("s2").alias("beta"), F.col("s3").alias("gamma"))


@case("q_U01_mean_fusion", "SELECT id, r9((s1 + s2 + s3) / 3.0::DOUBLE) AS score FROM predictions_wide")
def _(t):
    return wide(t).select("id", u.mean_fusion(METHODS).alias("score"))


GRID = """(SELECT printf('%.4f,%.4f,%.4f', a * 0.25, b * 0.25, (4 - a - b) * 0.25) AS weights, a * 0.25::DOUBLE AS w1, b * 0.25::DOUBLE AS w2, (4 - a - b) * 0.25::DOUBLE AS w3
           FROM range(5) x(a), range(5) y(b) WHERE a + b <= 4)"""


FINE_GRID = """(SELECT printf('%.4f,%.4f,%.4f', a * 0.05, b * 0.05, (20 - a - b) * 0.05) AS weights, a * 0.05::DOUBLE AS w1, b * 0.05::DOUBLE AS w2, (20 - a - b) * 0.05::DOUBLE AS w3
                FROM range(21) x(a), range(21) y(b) WHERE a + b <= 20)"""


@case(
    "q_U02_weight_grid",
    f"SELECT weights, count(*) AS n_rows, r9(avg(s1 * w1 + s2 * w2 + s3 * w3)) AS mean_score FROM predictions_wide, {FINE_GRID} g GROUP BY weights",
)
def _(t):
    grid = u.weights_column(u.weight_grid(3, 0.05))
    rows = wide(t).withColumn("g", F.explode(grid))
    return rows.groupBy(F.col("g.weights").alias("weights")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(u.weighted_sum(METHODS, F.col("g.w"))).alias("mean_score")
    )


_rank = lambda c: f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE) / count(*) OVER ()"
SHARED["fusion_inputs"] = f"""
    SELECT id, y_true, 'raw' AS normalization, s1 AS a, s2 AS b, s3 AS c FROM predictions_wide
    UNION ALL SELECT id, y_true, 'minmax', (s1 - min(s1) OVER ()) / (max(s1) OVER () - min(s1) OVER ()), (s2 - min(s2) OVER ()) / (max(s2) OVER () - min(s2) OVER ()),
                     (s3 - min(s3) OVER ()) / (max(s3) OVER () - min(s3) OVER ()) FROM predictions_wide
    UNION ALL SELECT id, y_true, 'rank', {_rank('s1')}, {_rank('s2')}, {_rank('s3')} FROM predictions_wide"""
SHARED["fused_rows"] = f"SELECT normalization, weights, y_true, a * w1 + b * w2 + c * w3 AS score FROM fusion_inputs, {GRID} g"
SHARED["fused_runs"] = bundle("fused_rows", "normalization, weights")
SHARED["fused_curve"] = curve("fused_rows", "normalization, weights")
SHARED["fused_det"] = det("fused_curve", "normalization, weights")
SHARED["fused_point"] = point("fused_det", "normalization, weights")
SHARED["fused_audet"] = audet("fused_det", "normalization, weights")
SHARED["fusion_grid"] = """
    SELECT normalization, weights, accuracy, roc_auc, apcer, bpcer, threshold, strict, audet_proxy, brier_score, expected_calibration_error
    FROM fused_runs JOIN fused_point USING (normalization, weights) JOIN fused_audet USING (normalization, weights)"""
_G = "normalization, weights, r9(accuracy) AS accuracy, r9(roc_auc) AS roc_auc, r9(apcer) AS apcer, r9(bpcer) AS bpcer, r9(threshold) AS threshold, strict, r9(audet_proxy) AS audet_proxy, r9(brier_score) AS brier_score, r9(expected_calibration_error) AS expected_calibration_error"


@case("q_U03_weighted_fusion_search", f"SELECT {_G} FROM fusion_grid")
def _(t):
    return u.fusion_search(wide(t), METHODS, 0.25, ("raw", "minmax", "rank"))


@case(
    "q_U03_best_fusion",
    f"SELECT {_G} FROM fusion_grid QUALIFY row_number() OVER (ORDER BY round(apcer, 12), round(audet_proxy, 12), round(roc_auc, 12) DESC, normalization, weights) = 1",
)
def _(t):
    return u.best_fusion(u.fusion_search(wide(t), METHODS, 0.25, ("raw", "minmax", "rank")))


@case(
    "q_U04_apply_fusion",
    f"""SELECT id, r9(a * 0.5::DOUBLE + b * 0.25::DOUBLE + c * 0.25::DOUBLE) AS fraud_score, CASE WHEN a * 0.5::DOUBLE + b * 0.25::DOUBLE + c * 0.25::DOUBLE >= 0.6 THEN 1 ELSE 0 END AS label
        FROM fusion_inputs WHERE normalization = 'rank'""",
)
def _(t):
    recipe = {"source_names": METHODS, "weights": [2, 1, 1], "normalization": "rank", "threshold": 0.6}
    return u.apply_fusion(wide(t), METHODS, recipe).select("id", "fraud_score", "label")


@case(
    "q_U05_rank_ensemble",
    "SELECT id, y_true, r9(a * (2.0::DOUBLE / 3.0::DOUBLE) + b * (1.0::DOUBLE / 3.0::DOUBLE)) AS score FROM fusion_inputs WHERE normalization = 'rank'",
)
def _(t):
    rows = t.predictions.where(F.col("method").isin("alpha", "beta"))
    return u.rank_ensemble(rows, "id", ["alpha", "beta"], [2, 1]).select("id", "y_true", "score")


SHARED["blend_rows"] = """
    SELECT global_weight, y_true, global_weight * global_rank + (1 - global_weight) * group_rank AS score
    FROM ranked, (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) w(global_weight)"""
SHARED["blend_runs"] = bundle("blend_rows", "global_weight")
SHARED["blend_curve"] = curve("blend_rows", "global_weight")
SHARED["blend_det"] = det("blend_curve", "global_weight")
SHARED["blend_point"] = point("blend_det", "global_weight")
SHARED["blend_audet"] = audet("blend_det", "global_weight")


@case(
    "q_U06_group_rank_blend",
    """SELECT global_weight, r9(accuracy) AS accuracy, r9(roc_auc) AS roc_auc, r9(apcer) AS apcer, r9(audet_proxy) AS audet_proxy, r9(audet_proxy + 0.2 * apcer) AS selection_objective
       FROM blend_runs JOIN blend_point USING (global_weight) JOIN blend_audet USING (global_weight)""",
)
def _(t):
    rows = t.predictions_wide.select("y_true", "type", "s1")
    return u.group_rank_blend(rows, "s1", "type", [0.0, 0.25, 0.5, 0.75, 1.0])


@case("q_U07_logistic_fusion")
def _(t):
    w = wide(t)
    scored = u.logistic_fusion(w, METHODS).score(w)
    return m.binary_metrics(scored.withColumn("part", F.lit("train")), ["part"])


def _drawn(c):
    """The draw of a method's score in a copy: the first 13 hex digits of its hash as a share of 2^52."""
    return f"('0x' || substr({hash_sql(f"(CAST(id AS VARCHAR) || ':' || CAST(repeat AS VARCHAR) || ':{c}')", '7')}, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


_LOST = lambda u: f"({u} < 0.4::DOUBLE AND NOT (greatest(ua, ub, uc) < 0.4::DOUBLE AND {u} = greatest(ua, ub, uc)))"


@case(
    "q_U08_branch_dropout_rows",
    f"""SELECT repeat, count(*) AS n, count(*) FILTER (a = 0.5) AS alpha_masked, count(*) FILTER (b = 0.5) AS beta_masked, count(*) FILTER (c = 0.5) AS gamma_masked
        FROM (SELECT repeat, CASE WHEN repeat > 0 AND {_LOST('ua')} THEN 0.5 ELSE s1 END AS a, CASE WHEN repeat > 0 AND {_LOST('ub')} THEN 0.5 ELSE s2 END AS b,
                     CASE WHEN repeat > 0 AND {_LOST('uc')} THEN 0.5 ELSE s3 END AS c
              FROM (SELECT *, {_drawn('alpha')} AS ua, {_drawn('beta')} AS ub, {_drawn('gamma')} AS uc
                    FROM predictions_wide, (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS repeat) k) d) x
        GROUP BY repeat""",
)
def _(t):
    rows = u.branch_dropout_rows(wide(t), "id", METHODS, 0.4, 2, 7)
    gone = lambda c: F.count_if(F.col(c) == 0.5).alias(f"{c}_masked")
    return rows.groupBy("repeat").agg(F.count(F.lit(1)).alias("n"), *[gone(c) for c in METHODS])


@case("q_U09_coefficient_table")
def _(t):
    return u.coefficient_table(t.spark, u.logistic_fusion(wide(t), METHODS))


@case("q_U10_fusion_run")
def _(t):
    p = t.predictions.select("id", "y_true", "method", "score")
    dim = p.withColumn("score", F.col("score") * 0.9)
    table, _ = u.fusion_run(p, {"dimmed": dim}, "id", METHODS, calibrator="temperature_balanced", dropout=(0.2, 1))
    return table
