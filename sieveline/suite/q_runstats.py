"""Aggregates, ranking and statistics over runs."""

from pyspark.sql import functions as F

from sieveline.operators import audit, metrics as m, runstats as r, sampling
from sieveline.suite.q_audit import split_corpus
from sieveline.suite.q_metrics import BINS
from sieveline.suite.q_sampling import STRATA_SQL
from sieveline.suite.registry import SHARED, case
from sieveline.suite.sqlparts import bin_sql, bundle, cells

RUN = ["method", "seed"]


def runs(t):
    return m.binary_metrics(t.predictions, RUN)


@case(
    "q_A01_class_counts",
    "SELECT split, class_name, label, count(*) AS n_images FROM split_corpus GROUP BY ALL",
)
def _(t):
    return audit.class_counts(split_corpus(t), "split", "class_name", "label")


@case(
    "q_A02_size_profile",
    """WITH s AS (SELECT p_size AS width, CAST(p_partkey % 7 AS INTEGER) AS height, count(*) AS n_images FROM part GROUP BY ALL)
       SELECT width, height, n_images, (SELECT min(width) FROM s) AS width_min, (SELECT max(width) FROM s) AS width_max,
              (SELECT min(height) FROM s) AS height_min, (SELECT max(height) FROM s) AS height_max
       FROM s ORDER BY n_images DESC, width, height LIMIT 10""",
)
def _(t):
    sized = t.part.select(F.col("p_size").alias("width"), (F.col("p_partkey") % 7).cast("int").alias("height"))
    return audit.size_profile(sized, "width", "height")


@case(
    "q_A03_source_slice_metrics",
    """SELECT method, source_label, count(*) AS n, r9(avg(CASE WHEN (score >= 0.5) = (y_true = 1) THEN 1 ELSE 0 END)) AS accuracy,
              r9(avg(score)) AS mean_score, r9(quantile_cont(score, 0.1)) AS score_p10, r9(quantile_cont(score, 0.5)) AS score_p50,
              r9(quantile_cont(score, 0.9)) AS score_p90,
              r9(CASE WHEN source_label = 0 THEN avg(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) END) AS false_positive_rate,
              r9(CASE WHEN source_label <> 0 THEN avg(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) END) AS detection_rate,
              r9(CASE WHEN source_label <> 0 THEN avg(CASE WHEN score >= 0.5 THEN 0 ELSE 1 END) END) AS miss_rate
       FROM predictions GROUP BY method, source_label""",
)
def _(t):
    return r.source_slices(t.predictions, ["method", "source_label"], F.col("source_label") != 0)


@case(
    "q_A03_slice_quantiles_by_prefix_sum",
    """SELECT method, source_label, quantile, r9(value) AS value FROM (
         SELECT method, source_label, unnest([0.1::DOUBLE, 0.5, 0.9]) AS quantile,
                unnest([quantile_cont(score, 0.1), quantile_cont(score, 0.5), quantile_cont(score, 0.9)]) AS value
         FROM predictions GROUP BY method, source_label) x""",
)
def _(t):
    return r.exact_quantiles(t.predictions, ["method", "source_label"], [0.1, 0.5, 0.9])


SHARED["type_runs"] = bundle("predictions", "method, seed, type")


@case(
    "q_A04_group_metrics",
    """SELECT method, seed, type, tn, fp, fn, tp, n_samples, r9(accuracy) AS accuracy, r9(precision) AS precision, r9(recall) AS recall,
              r9(f1) AS f1, r9(brier_score) AS brier_score, r9(expected_calibration_error) AS expected_calibration_error,
              r9(maximum_calibration_error) AS maximum_calibration_error, r9(roc_auc) AS roc_auc, tn + fp AS n_real, fn + tp AS n_fake,
              r9((tp + fp) / n_samples) AS predicted_fake_rate, r9(fp / nullif(tn + fp, 0)) AS real_fpr, r9(tp / nullif(fn + tp, 0)) AS fake_detection
       FROM type_runs""",
)
def _(t):
    return r.group_metrics(t.predictions, ["method", "seed", "type"])


STATS = lambda c: f"r9(avg({c})) AS {c}_mean, r9(coalesce(stddev_samp({c}), 0)) AS {c}_std, r9(min({c})) AS {c}_min, r9(max({c})) AS {c}_max"


@case(
    "q_A05_seed_summary",
    f"SELECT method, count(DISTINCT seed) AS n_seeds, {STATS('accuracy')}, {STATS('roc_auc')}, {STATS('brier_score')} FROM runs GROUP BY method",
)
def _(t):
    return r.seed_summary(runs(t), ["method"], ["accuracy", "roc_auc", "brier_score"])


@case(
    "q_A06_method_calibration_summary",
    """SELECT method, count(*) AS n_runs, r9(avg(accuracy)) AS mean_accuracy, r9(avg(roc_auc)) AS mean_roc_auc, r9(avg(brier_score)) AS mean_brier_score,
              r9(avg(expected_calibration_error)) AS mean_expected_calibration_error, r9(avg(maximum_calibration_error)) AS mean_maximum_calibration_error
       FROM runs GROUP BY method""",
)
def _(t):
    names = ["accuracy", "roc_auc", "brier_score", "expected_calibration_error", "maximum_calibration_error"]
    out = runs(t).groupBy("method").agg(
        F.count(F.lit(1)).alias("n_runs"), *[F.avg(c).alias(f"mean_{c}") for c in names]
    )
    return out.orderBy("mean_expected_calibration_error", "mean_brier_score")


@case(
    "q_A07_value_count_map",
    "SELECT type, n FROM (SELECT type, count(*) AS n FROM predictions_wide GROUP BY type) x",
)
def _(t):
    return r.value_counts(t.predictions_wide, "type").select(F.explode("counts").alias("type", "n"))


@case(
    "q_A08_strata_summary",
    f"""SELECT type, y_true, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) AS total
        FROM ({STRATA_SQL}) s GROUP BY type, y_true""",
)
def _(t):
    return r.strata_summary(sampling.strata_split(t.predictions_wide, "id", ["type", "y_true"], 0.2, 7), ["type", "y_true"])


RANKS = """
    SELECT id, type, y_true, s1, s2, s3,
           (rank() OVER (ORDER BY s1) + (count(*) OVER (PARTITION BY s1) - 1) / 2.0::DOUBLE) / count(*) OVER () AS global_rank,
           (rank() OVER (PARTITION BY type ORDER BY s1) + (count(*) OVER (PARTITION BY type, s1) - 1) / 2.0::DOUBLE)
             / count(*) OVER (PARTITION BY type) AS group_rank
    FROM predictions_wide"""
SHARED["ranked"] = RANKS


def ranked(t):
    wide = t.predictions_wide.select("id", "type", "y_true", "s1")
    return r.pct_rank_average(r.pct_rank_average(wide, [], "s1", "global_rank"), ["type"], "s1", "group_rank")


@case(
    "q_A09_group_rank_summary",
    """SELECT type, count(*) AS n, r9(avg(s1)) AS raw_score_mean, r9(avg(global_rank)) AS global_rank_mean, r9(avg(group_rank)) AS group_rank_mean
       FROM ranked GROUP BY type""",
)
def _(t):
    return ranked(t).groupBy("type").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("s1").alias("raw_score_mean"),
        F.avg("global_rank").alias("global_rank_mean"),
        F.avg("group_rank").alias("group_rank_mean"),
    )


@case(
    "q_A10_feature_frequency",
    """SELECT feature, count(*) AS n_selected, string_agg(run, ';' ORDER BY run) AS runs, CASE WHEN feature IN ('the', 'de', 'der') THEN 'base' ELSE 'extra' END AS kind
       FROM (SELECT DISTINCT lang || '-' || source AS run, unnest(string_split(lower(text), ' ')[1:3]) AS feature FROM documents) x
       GROUP BY feature""",
)
def _(t):
    selected = t.documents.select(
        F.concat_ws("-", "lang", "source").alias("run"), F.slice(F.split(F.lower("text"), " "), 1, 3).alias("selected")
    )
    return r.feature_frequency(selected, "run", "selected", ["the", "de", "der"])


@case(
    "q_A11_wide_score_pivot",
    "SELECT id, r9(s1) AS alpha, r9(s2) AS beta, r9(s3) AS gamma FROM predictions_wide",
)
def _(t):
    return r.score_pivot(t.predictions, "id", ["alpha", "beta", "gamma"])


@case(
    "q_A12_pooled_reliability",
    f"""SELECT method, CAST({bin_sql()} AS INTEGER) AS bin, r9({bin_sql()} / 10.0) AS bin_lower, r9(({bin_sql()} + 1) / 10.0) AS bin_upper,
               count(*) AS count, r9(avg(score)) AS confidence, r9(avg(y_true)) AS accuracy, r9(abs(avg(score) - avg(y_true))) AS abs_gap
        FROM predictions GROUP BY method, {bin_sql()}""",
)
def _(t):
    return r.pooled_reliability(m.calibration_bins(t.predictions, RUN), ["method"])


SHARED["source_modes"] = """
    SELECT *, row_number() OVER (PARTITION BY source_label, seed ORDER BY acc DESC, mode) AS place
    FROM (SELECT source_label, seed, method AS mode, avg(score) - 0.5 AS delta,
                 avg(CASE WHEN (score >= 0.5) = (y_true = 1) THEN 1 ELSE 0 END) AS acc
          FROM predictions GROUP BY source_label, seed, method) g"""


def source_modes(t):
    rows = t.predictions.groupBy("source_label", "seed", F.col("method").alias("mode")).agg(
        (F.avg("score") - 0.5).alias("delta"),
        F.avg(((F.col("score") >= 0.5).cast("int") == F.col("y_true")).cast("double")).alias("acc"),
    )
    return r.select_best(rows, ["source_label", "seed"], [F.desc("acc"), F.asc("mode")])


@case(
    "q_A13_mode_vote",
    """SELECT source_label, mode, n, r9(mean_delta) AS mean_delta FROM (
         SELECT source_label, mode, count(*) AS n, avg(delta) AS mean_delta FROM source_modes WHERE place = 1 GROUP BY ALL) x
       QUALIFY row_number() OVER (PARTITION BY source_label ORDER BY n DESC, mode) = 1""",
)
def _(t):
    return r.mode_vote(source_modes(t), ["source_label"], "mode", "delta")


@case(
    "q_A14_chosen_list",
    "SELECT source_label, string_agg(mode, '; ' ORDER BY seed) AS selected FROM source_modes WHERE place = 1 GROUP BY source_label",
)
def _(t):
    return r.chosen_list(source_modes(t), ["source_label"], "seed", "mode")


@case(
    "q_A15_artifact_type_summary",
    """SELECT lang AS type, count(*) AS artifacts, count(*) FILTER (n_chars < 5000) AS present, count(*) FILTER (n_chars < 5000 AND n_chars > 50) AS hashed,
              coalesce(sum(CASE WHEN n_chars < 5000 THEN n_chars END), 0)::BIGINT AS bytes FROM documents GROUP BY lang""",
)
def _(t):
    there = F.col("n_chars") < 5000
    rows = t.documents.select(
        F.col("doc_id").cast("string").alias("path"),
        F.col("lang").alias("type"),
        there.alias("exists"),
        F.when(there, F.col("n_chars")).alias("size_bytes"),
        F.when(there & (F.col("n_chars") > 50), "hashed").when(there, "index_or_self_skipped").otherwise("missing").alias("hash_status"),
    )
    return r.artifact_summary(rows)


SHARED["policy_folds"] = f"""
    SELECT 'best_auc' AS policy, s.source_label, c.seed, c.method,
           recall AS utility_value, 1 - recall AS miss
    FROM (SELECT seed, method FROM runs QUALIFY row_number() OVER (PARTITION BY seed ORDER BY roc_auc DESC, method) = 1) c
    JOIN (SELECT method, seed, source_label, avg(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) AS recall FROM predictions
          WHERE source_label > 0 GROUP BY ALL) s USING (method, seed)
    UNION ALL
    SELECT 'best_brier', s.source_label, c.seed, c.method, recall, 1 - recall
    FROM (SELECT seed, method FROM runs QUALIFY row_number() OVER (PARTITION BY seed ORDER BY brier_score, method) = 1) c
    JOIN (SELECT method, seed, source_label, avg(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) AS recall FROM predictions
          WHERE source_label > 0 GROUP BY ALL) s USING (method, seed)"""


def policy_folds(t):
    per = runs(t)
    best = r.select_best(per, ["seed"], [F.desc("roc_auc"), F.asc("method")]).select(F.lit("best_auc").alias("policy"), *RUN)
    low = r.select_best(per, ["seed"], [F.asc("brier_score"), F.asc("method")]).select(F.lit("best_brier").alias("policy"), *RUN)
    folds = t.predictions.where("source_label > 0").groupBy(*RUN, "source_label").agg(
        F.avg((F.col("score") >= 0.5).cast("double")).alias("utility_value")
    )
    return folds.withColumn("miss", 1.0 - F.col("utility_value")).join(best.unionByName(low), RUN)


@case(
    "q_A16_policy_source_summary",
    f"""SELECT policy, source_label, count(DISTINCT seed) AS n_seeds, {STATS('utility_value')}, {STATS('miss')},
               string_agg(method, '; ' ORDER BY seed) AS selected_candidates FROM policy_folds GROUP BY policy, source_label""",
)
def _(t):
    return r.policy_source_summary(policy_folds(t), "policy", "source_label", ["utility_value", "miss"], "method")


@case(
    "q_A17_weakest_source",
    """SELECT policy, source_label, r9(u) AS utility_value_mean, r9(k) AS miss_mean FROM (
         SELECT policy, source_label, round(avg(utility_value), 9) AS u, round(avg(miss), 9) AS k FROM policy_folds GROUP BY ALL) x
       QUALIFY row_number() OVER (PARTITION BY policy ORDER BY u, k DESC, source_label) = 1""",
)
def _(t):
    summary = r.policy_source_summary(policy_folds(t), "policy", "source_label", ["utility_value", "miss"], "method")
    out = r.weakest_source(summary, "policy", "utility_value_mean", "miss_mean", "source_label")
    return out.select("policy", "source_label", "utility_value_mean", "miss_mean")


# ---- ranking ----------------------------------------------------------------


@case("q_W01_pct_rank_average", "SELECT id, r9(global_rank) AS global_rank FROM ranked")
def _(t):
    return r.pct_rank_average(t.predictions_wide.select("id", "s1"), [], "s1", "global_rank").select("id", "global_rank")


@case("q_W02_pct_rank_in_group", "SELECT id, type, r9(group_rank) AS group_rank FROM ranked")
def _(t):
    return r.pct_rank_average(t.predictions_wide.select("id", "type", "s1"), ["type"], "s1", "group_rank").drop("s1")


@case(
    "q_W03_minmax_normalise",
    """SELECT id, r9((s1 - a) / (b - a)) AS s1_minmax, r9((s2 - c) / (d - c)) AS s2_minmax
       FROM predictions_wide, (SELECT min(s1) AS a, max(s1) AS b, min(s2) AS c, max(s2) AS d FROM predictions_wide) l""",
)
def _(t):
    return r.minmax(t.predictions_wide, ["s1", "s2"]).select("id", "s1_minmax", "s2_minmax")


@case(
    "q_W04_select_best",
    "SELECT seed, method, r9(accuracy) AS accuracy FROM runs QUALIFY row_number() OVER (PARTITION BY seed ORDER BY accuracy DESC, brier_score, method) = 1",
)
def _(t):
    return r.select_best(runs(t), ["seed"], [F.desc("accuracy"), F.asc("brier_score"), F.asc("method")]).select(
        "seed", "method", "accuracy"
    )


@case(
    "q_W05_winner_and_runner_up",
    """WITH o AS (SELECT seed, method, brier_score, row_number() OVER (PARTITION BY seed ORDER BY brier_score, method) AS n FROM runs)
       SELECT a.seed, a.method AS winner, r9(a.brier_score) AS value, b.method AS runner_up, r9(b.brier_score - a.brier_score) AS margin
       FROM o a JOIN o b ON a.seed = b.seed AND a.n = 1 AND b.n = 2""",
)
def _(t):
    return r.winner_and_runner_up(runs(t), ["seed"], "brier_score", False, "method")


@case(
    "q_W06_multi_objective_choice",
    """SELECT seed, arg_min(method, a) AS best_accuracy, arg_min(method, b) AS best_auc, arg_min(method, c) AS best_brier, arg_min(method, d) AS best_ece
       FROM (SELECT seed, method, row_number() OVER (PARTITION BY seed ORDER BY accuracy DESC, roc_auc DESC, method) AS a,
                    row_number() OVER (PARTITION BY seed ORDER BY roc_auc DESC, accuracy DESC, method) AS b,
                    row_number() OVER (PARTITION BY seed ORDER BY brier_score, accuracy DESC, method) AS c,
                    row_number() OVER (PARTITION BY seed ORDER BY expected_calibration_error, accuracy DESC, method) AS d FROM runs) x GROUP BY seed""",
)
def _(t):
    return r.multi_objective_choice(
        runs(t),
        ["seed"],
        "method",
        {
            "accuracy": [F.desc("accuracy"), F.desc("roc_auc")],
            "auc": [F.desc("roc_auc"), F.desc("accuracy")],
            "brier": [F.asc("brier_score"), F.desc("accuracy")],
            "ece": [F.asc("expected_calibration_error"), F.desc("accuracy")],
        },
    )


@case(
    "q_W07_per_run_wins",
    """SELECT method, count(*) FILTER (a = 1) AS accuracy_wins, count(*) FILTER (b = 1) AS brier_score_wins FROM (
         SELECT method, row_number() OVER (PARTITION BY seed ORDER BY accuracy DESC, method) AS a,
                row_number() OVER (PARTITION BY seed ORDER BY brier_score, method) AS b FROM runs) x GROUP BY method""",
)
def _(t):
    return r.per_run_wins(runs(t), "seed", "method", {"accuracy": True, "brier_score": False})


SHARED["variant_runs"] = bundle("variants", "variant")


@case(
    "q_W08_robustness_rank",
    """SELECT variant, r9(accuracy) AS accuracy, r9(roc_auc) AS roc_auc, r9(da) AS accuracy_delta_vs_clean, r9(du) AS roc_auc_delta_vs_clean,
              CASE WHEN least(da, du) <= -0.045 THEN 'major_drop' WHEN least(da, du) <= -0.02 THEN 'moderate_drop'
                   WHEN da >= 0.005 AND du >= 0.005 THEN 'apparent_gain' ELSE 'stable_or_mild' END AS tier,
              row_number() OVER (ORDER BY round(du, 12), da, variant) AS rank
       FROM (SELECT v.variant, v.accuracy, v.roc_auc, v.accuracy - c.accuracy AS da, v.roc_auc - c.roc_auc AS du
             FROM variant_runs v, variant_runs c WHERE c.variant = 'clean' AND v.variant <> 'clean') x""",
)
def _(t):
    return r.robustness_rank(m.binary_metrics(t.variants, ["variant"]), "variant", "clean")


WIDE3 = "SELECT id, y_true, s1 AS alpha, s2 AS beta, s3 AS gamma FROM predictions_wide"
SPREAD = f"""SELECT *, least(alpha, beta, gamma) AS min_score, greatest(alpha, beta, gamma) AS max_score,
        greatest(alpha, beta, gamma) - least(alpha, beta, gamma) AS score_spread,
        CASE least(alpha, beta, gamma) WHEN alpha THEN 'alpha' WHEN beta THEN 'beta' ELSE 'gamma' END AS lowest_method,
        CASE greatest(alpha, beta, gamma) WHEN alpha THEN 'alpha' WHEN beta THEN 'beta' ELSE 'gamma' END AS highest_method
        FROM ({WIDE3}) w"""
SHARED["spread_rows"] = SPREAD
R_SPREAD = "id, y_true, r9(alpha) AS alpha, r9(beta) AS beta, r9(gamma) AS gamma, r9(min_score) AS min_score, r9(max_score) AS max_score, r9(score_spread) AS score_spread, lowest_method, highest_method"


def spread(t):
    wide = t.predictions_wide.select(
        "id", "y_true", F.col("s1").alias("alpha"), F.col("s2").alias("beta"), F.col("s3").alias("gamma")
    )
    return r.score_spread(wide, ["alpha", "beta", "gamma"])


SHARED["cases"] = """
    SELECT * FROM (SELECT *, 'false_positive' AS "case" FROM spread_rows WHERE alpha >= 0.5 AND y_true = 0 ORDER BY alpha DESC, id LIMIT 20) a
    UNION ALL SELECT * FROM (SELECT *, 'false_negative' FROM spread_rows WHERE alpha < 0.5 AND y_true = 1 ORDER BY alpha, id LIMIT 20) b
    UNION ALL SELECT * FROM (SELECT *, 'disagreement' FROM spread_rows WHERE score_spread >= 0.4 ORDER BY score_spread DESC, id LIMIT 20) c"""


@case("q_W09_sort_limit_topk", f'SELECT "case", {R_SPREAD} FROM cases')
def _(t):
    return r.case_tables(spread(t), "id", "alpha", 0.5, 20, 0.4)


@case("q_W10_score_spread", f"SELECT {R_SPREAD} FROM spread_rows")
def _(t):
    return spread(t)


@case(
    "q_W11_union_runs",
    """SELECT 'first' AS run, id, r9(s1) AS score, NULL AS type FROM predictions_wide
       UNION ALL SELECT 'second', id, r9(s2), type FROM predictions_wide""",
)
def _(t):
    w = t.predictions_wide
    return r.union_runs(
        {"first": w.select("id", F.col("s1").alias("score")), "second": w.select("id", F.col("s2").alias("score"), "type")}
    )


@case(
    "q_W12_intersect_except",
    """SELECT 'both' AS side, user_id FROM (SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase') a
       UNION ALL SELECT 'only_error', user_id FROM (SELECT user_id FROM events WHERE event_type = 'error' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 20) b""",
)
def _(t):
    e = t.events
    error = e.where("event_type = 'error'").select("user_id")
    buy = e.where("event_type = 'purchase'")
    both = error.intersect(buy.select("user_id")).withColumn("side", F.lit("both"))
    only = error.subtract(buy.where("value > 20").select("user_id")).withColumn("side", F.lit("only_error"))
    return both.unionByName(only)


@case("q_W13_distinct", "SELECT DISTINCT source_label, type FROM predictions")
def _(t):
    return t.predictions.select("source_label", "type").distinct()


# ---- statistics -------------------------------------------------------------


@case("q_T01_bootstrap_mean_ci")
def _(t):
    return r.bootstrap_mean_ci(runs(t), ["method"], ["accuracy", "roc_auc"], seed=17)


def _stacked(*names):
    return f"(SELECT method, seed, unnest([{', '.join(repr(n) for n in names)}]) AS metric, unnest([{', '.join(names)}]) AS value FROM runs)"


@case(
    "q_T01_bootstrap_means",
    f"SELECT method, metric, count(*) AS n, r9(avg(value)) AS mean FROM {_stacked('accuracy', 'roc_auc')} l GROUP BY ALL",
)
def _(t):
    return r.bootstrap_mean_ci(runs(t), ["method"], ["accuracy", "roc_auc"], seed=17).drop("ci_low", "ci_high")


@case("q_T01_poisson_bootstrap_rows")
def _(t):
    return r.poisson_bootstrap(t.predictions, ["method"], "id", "score", replicates=50)


@case("q_T02_summary_with_ci")
def _(t):
    return r.summary_with_ci(runs(t), ["method"], ["accuracy", "roc_auc", "brier_score"], seed=5)


@case(
    "q_T02_summary_spread",
    f"""SELECT method, metric, count(*) AS n, r9(avg(value)) AS mean, r9(coalesce(stddev_samp(value), 0)) AS std, r9(min(value)) AS min, r9(max(value)) AS max
        FROM {_stacked('accuracy', 'roc_auc', 'brier_score')} l GROUP BY ALL""",
)
def _(t):
    return r.summary_with_ci(runs(t), ["method"], ["accuracy", "roc_auc", "brier_score"], seed=5).drop("ci_low", "ci_high")


SUPPORT = {"accuracy": "higher", "brier_score": "lower", "recall": "diagnostic"}


@case(
    "q_T03_paired_counts",
    f"""WITH l AS {_stacked(*SUPPORT)},
        d AS (SELECT metric, c.value AS c, b.value AS b, (c.value - b.value) * CASE WHEN metric = 'brier_score' THEN -1 ELSE 1 END AS gain
              FROM (SELECT * FROM l WHERE method = 'beta') c JOIN (SELECT * FROM l WHERE method = 'alpha') b USING (metric, seed))
        SELECT metric, CASE metric WHEN 'accuracy' THEN 'higher' WHEN 'brier_score' THEN 'lower' ELSE 'diagnostic' END AS direction, count(*) AS n_pairs,
               r9(avg(c)) AS candidate_mean, r9(avg(b)) AS baseline_mean, r9(avg(c - b)) AS raw_delta_mean, r9(avg(gain)) AS favorable_delta_mean,
               CASE WHEN metric <> 'recall' THEN count(*) FILTER (gain > 0) END AS candidate_wins,
               CASE WHEN metric <> 'recall' THEN count(*) FILTER (gain < 0) END AS candidate_losses,
               CASE WHEN metric <> 'recall' THEN count(*) FILTER (abs(gain) <= 1e-8) END AS ties
        FROM d GROUP BY metric""",
)
def _(t):
    return r.paired_support(runs(t), "method", "beta", "alpha", SUPPORT).drop("ci_low", "ci_high", "raw_ci_low", "raw_ci_high", "support_label")


@case("q_T03_paired_support")
def _(t):
    return r.paired_support(runs(t), "method", "beta", "alpha", SUPPORT)


@case(
    "q_T04_mean_delta_table",
    """WITH l AS (SELECT method, unnest(['accuracy', 'roc_auc', 'f1']) AS metric, unnest([accuracy, roc_auc, f1]) AS value FROM runs),
       a AS (SELECT method, metric, avg(value) AS v FROM l GROUP BY ALL)
       SELECT x.method, x.metric, r9(x.v) AS mean_value, r9(b.v) AS baseline_mean, r9(x.v - b.v) AS mean_delta
       FROM a x JOIN a b ON x.metric = b.metric AND b.method = 'alpha' WHERE x.method <> 'alpha'""",
)
def _(t):
    return r.mean_delta_table(runs(t), "method", "alpha", ["accuracy", "roc_auc", "f1"])


SHARED["method_runs"] = bundle("predictions", "method")


@case(
    "q_T05_compare_methods",
    """SELECT method, r9(accuracy) AS accuracy, r9(roc_auc) AS roc_auc, r9(f1) AS f1, row_number() OVER (ORDER BY roc_auc DESC, method) AS rank FROM method_runs""",
)
def _(t):
    return r.compare_methods(m.binary_metrics(t.predictions, ["method"]), ["accuracy", "roc_auc", "f1"])


@case(
    "q_T06_anchor_gap",
    """WITH a AS (SELECT * FROM (VALUES ('alpha', 0.7::DOUBLE, true), ('beta', 0.6::DOUBLE, false)) v(method, anchor_value, same_protocol))
       SELECT method, r9(roc_auc) AS value, r9(anchor_value) AS anchor_value, same_protocol, r9(roc_auc - anchor_value) AS gap,
              CASE WHEN anchor_value IS NULL THEN 'no_anchor' WHEN NOT same_protocol THEN 'context_only'
                   WHEN roc_auc >= anchor_value THEN 'at_or_above' ELSE 'below' END AS comparison
       FROM method_runs LEFT JOIN a USING (method)""",
)
def _(t):
    results = m.roc_auc(t.predictions, ["method"]).withColumnRenamed("roc_auc", "value")
    anchors = t.spark.createDataFrame(
        [("alpha", 0.7, True), ("beta", 0.6, False)], "method string, anchor_value double, same_protocol boolean"
    )
    return r.anchor_gap(results, anchors, ["method"])


from sieveline.suite.sqlparts import audet, curve, det, point  # noqa: E402

SHARED["curve_v2"] = curve("variants", "variant")
SHARED["det_v"] = det("curve_v2", "variant")
SHARED["point_v"] = point("det_v", "variant")
SHARED["audet_v"] = audet("det_v", "variant")


@case(
    "q_T07_robustness_by_variant",
    """WITH j AS (SELECT variant, accuracy, roc_auc, apcer, audet_proxy FROM variant_runs JOIN point_v USING (variant) JOIN audet_v USING (variant))
       SELECT j.variant, r9(j.accuracy) AS accuracy, r9(j.roc_auc) AS roc_auc, r9(j.apcer) AS apcer, r9(j.audet_proxy) AS audet_proxy, """
    + ", ".join(
        f"r9(j.{c} - b.{c}) AS {c}_delta_vs_clean, round(j.{c} - b.{c}, 12) {'<' if c in ('apcer', 'audet_proxy') else '>'} 0 AS {c}_improved_vs_clean"
        for c in ("accuracy", "roc_auc", "apcer", "audet_proxy")
    )
    + " FROM j, j b WHERE b.variant = 'clean'",
)
def _(t):
    rows = m.running(t.variants, ["variant"])
    both = m.join_groups(m.summarise_running(rows, ["variant"]), m.operating_metrics_of(rows, ["variant"]), ["variant"])
    names = ["accuracy", "roc_auc", "apcer", "audet_proxy"]
    # sums over tasks differ in the last digits: compare what the report shows
    shown = both.select("variant", *[F.round(c, 12).alias(c) for c in names])
    from sieveline.operators.joins import baseline_deltas

    return baseline_deltas(shown, [], F.col("variant") == "clean", names, ["apcer", "audet_proxy"], "clean")
