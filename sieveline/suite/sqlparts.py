"""Pieces of check SQL used by more than one query."""

from __future__ import annotations

from sieveline.suite.registry import SHARED


def cells(threshold: str = "0.5", score: str = "score") -> str:
    return f"""
        count(*) FILTER ({score} < {threshold} AND y_true = 0) AS tn,
        count(*) FILTER ({score} >= {threshold} AND y_true = 0) AS fp,
        count(*) FILTER ({score} < {threshold} AND y_true = 1) AS fn,
        count(*) FILTER ({score} >= {threshold} AND y_true = 1) AS tp"""


EDGES = "[0.1::DOUBLE, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]"


def bin_sql(score: str = "score") -> str:
    return f"len(list_filter({EDGES}, lambda e: e <= {score}))"


def clip_sql(score: str = "score") -> str:
    return f"greatest(least({score}, 1.0::DOUBLE), 0.0::DOUBLE)"


def bundle(table: str, keys: str, threshold: str = "0.5", score: str = "score") -> str:
    """Confusion cells, rates, Brier, ECE, MCE and AUC per `keys` (never empty)."""
    return f"""
    SELECT c.*,
           (tp + tn) / (tn + fp + fn + tp)::DOUBLE AS accuracy,
           CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END AS precision,
           CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END AS recall,
           CASE WHEN 2*tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2*tp + fp + fn)::DOUBLE END AS f1,
           e.expected_calibration_error, e.maximum_calibration_error,
           CASE WHEN a.p = 0 OR a.n = 0 THEN NULL
                ELSE (a.ranks - a.p * (a.p + 1) / 2.0::DOUBLE) / (a.p * a.n::DOUBLE) END AS roc_auc
    FROM (SELECT {keys}, {cells(threshold, score)}, count(*) AS n_samples,
                 avg(pow({clip_sql(score)} - y_true, 2)) AS brier_score
          FROM {table} GROUP BY {keys}) c
    JOIN (SELECT {keys}, sum(m * gap) / sum(m) AS expected_calibration_error,
                 max(gap) AS maximum_calibration_error
          FROM (SELECT {keys}, {bin_sql(clip_sql(score))} AS b, count(*) AS m,
                       abs(avg({clip_sql(score)}) - avg(y_true)) AS gap
                FROM {table} GROUP BY {keys}, b) bb GROUP BY {keys}) e USING ({keys})
    JOIN (SELECT {keys}, sum(y_true) AS p, sum(1 - y_true) AS n,
                 sum(CASE WHEN y_true = 1 THEN rk + (ties - 1) / 2.0::DOUBLE ELSE 0 END) AS ranks
          FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY {score}) AS rk,
                       count(*) OVER (PARTITION BY {keys}, {score}) AS ties FROM {table}) rr
          GROUP BY {keys}) a USING ({keys})"""


def curve(table: str, keys: str, score: str = "score") -> str:
    """Score histogram with the counts strictly below and the totals."""
    return f"""
    SELECT *, coalesce(sum(pos) OVER w, 0) AS pos_below, coalesce(sum(neg) OVER w, 0) AS neg_below,
           sum(pos) OVER (PARTITION BY {keys}) AS pos_all, sum(neg) OVER (PARTITION BY {keys}) AS neg_all
    FROM (SELECT {keys}, {score} AS score, count(*) FILTER (y_true = 1) AS pos,
                 count(*) FILTER (y_true = 0) AS neg FROM {table} GROUP BY ALL) h
    WINDOW w AS (PARTITION BY {keys} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def det(curve_name: str, keys: str) -> str:
    return f"""
    SELECT {keys}, score AS threshold, false AS strict, (neg_all - neg_below) / neg_all::DOUBLE AS bpcer,
           pos_below / pos_all::DOUBLE AS apcer, neg_all, pos_all FROM {curve_name}
    UNION ALL
    SELECT {keys}, score, true, (neg_all - neg_below - neg) / neg_all::DOUBLE,
           (pos_below + pos) / pos_all::DOUBLE, neg_all, pos_all FROM {curve_name}"""


def point(det_name: str, keys: str, target: str = "0.01") -> str:
    return f"""
    SELECT {keys}, threshold, strict, bpcer, apcer, neg_all AS n_bona_fide, pos_all AS n_attack
    FROM {det_name} WHERE bpcer <= {target}
    QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY apcer, bpcer DESC, threshold, strict) = 1"""


def audet(det_name: str, keys: str) -> str:
    """The trapezoid as defined: over sorted distinct points, the end points included."""
    return f"""
    SELECT {keys}, sum((bpcer - pb) * (apcer + pa) * 0.5) AS audet_proxy
    FROM (SELECT *, lag(bpcer) OVER o AS pb, lag(apcer) OVER o AS pa
          FROM (SELECT DISTINCT {keys}, bpcer, apcer FROM {det_name}
                UNION SELECT DISTINCT {keys}, 1.0, 0.0 FROM {det_name}
                UNION SELECT DISTINCT {keys}, 0.0, 1.0 FROM {det_name}) d
          WINDOW o AS (PARTITION BY {keys} ORDER BY bpcer, apcer)) s
    GROUP BY {keys}"""


def candidates(curve_name: str, keys: str) -> str:
    """Every candidate threshold with its confusion cells, for scores in [0, 1]."""
    return f"""
    SELECT {keys}, threshold, any_value(tn) AS tn, any_value(neg_all - tn) AS fp,
           any_value(fn) AS fn, any_value(pos_all - fn) AS tp
    FROM (SELECT {keys}, threshold, max(na) OVER g AS neg_all, max(pa) OVER g AS pos_all,
                 sum(neg) OVER w - neg_here AS tn, sum(pos) OVER w - pos_here AS fn
          FROM (SELECT *, sum(neg) OVER h AS neg_here, sum(pos) OVER h AS pos_here
                FROM (SELECT {keys}, score AS threshold, neg, pos, neg_all AS na, pos_all AS pa FROM {curve_name}
                      UNION ALL
                      SELECT {keys}, (score + nxt) / 2.0::DOUBLE, 0, 0, NULL, NULL
                      FROM (SELECT *, lead(score) OVER (PARTITION BY {keys} ORDER BY score) AS nxt
                            FROM {curve_name}) n
                      WHERE nxt IS NOT NULL AND (score + nxt) / 2.0::DOUBLE > score
                      UNION ALL
                      SELECT {keys}, unnest([0.0::DOUBLE, 0.5, 1.0]), 0, 0, NULL, NULL
                      FROM (SELECT DISTINCT {keys} FROM {curve_name}) u) a
                WINDOW h AS (PARTITION BY {keys}, threshold)) b
          WINDOW g AS (PARTITION BY {keys}), w AS (PARTITION BY {keys} ORDER BY threshold)) z
    GROUP BY {keys}, threshold"""


SHARED["runs"] = bundle("predictions", "method, seed")
SHARED["curve_m"] = curve("predictions", "method")
SHARED["det_m"] = det("curve_m", "method")
SHARED["point_m"] = point("det_m", "method")
SHARED["audet_m"] = audet("det_m", "method")
