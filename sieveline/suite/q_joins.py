"""Joins."""

from pyspark.sql import functions as F

from sieveline.functions.scalar import path_key, source_name
from sieveline.operators import audit, joins as j, metrics as m, neighbours
from sieveline.suite.registry import SHARED, case
from sieveline.suite.sqlparts import curve

METHODS = ["alpha", "beta", "gamma"]


@case(
    "q_J01_align_scores",
    """SELECT lower(path) AS path_key, y_true, r9(s1) AS alpha, r9(s2) AS beta, r9(s3) AS gamma FROM predictions_wide""",
)
def _(t):
    return j.align_scores(t.predictions.withColumn("path_key", path_key("path")), "path_key", METHODS)


@case("q_J02_strict_1to1_join", "SELECT id, y_true, r9(s1) AS first, r9(s2) AS second FROM predictions_wide")
def _(t):
    one = lambda name, out: t.predictions.where(F.col("method") == name).select("id", "y_true", F.col("score").alias(out))
    return j.strict_one_to_one(one("alpha", "first"), one("beta", "second"), "id", "y_true")


@case(
    "q_J03_metadata_join",
    """SELECT p.id, p.method, r9(p.score) AS score, m.source_id, m.caption
       FROM predictions p JOIN metadata m ON lower(p.path) = m.path_key""",
)
def _(t):
    p = t.predictions.withColumn("path_key", path_key("path"))
    out = j.metadata_join(p, t.metadata, "path_key")
    return out.select("id", "method", "score", "source_id", "caption")


@case(
    "q_J04_enrich_many_to_one",
    """SELECT id, method, CASE source_label WHEN 0 THEN 'real' WHEN 1 THEN 'sd21' WHEN 2 THEN 'sdxl' WHEN 3 THEN 'sd3'
              WHEN 4 THEN 'dalle3' ELSE 'midjourney6' END AS source FROM predictions""",
)
def _(t):
    names = t.predictions_wide.select("source_label").distinct().withColumn("source", source_name("source_label"))
    return j.enrich(t.predictions, names, "source_label", "source").select("id", "method", "source")


@case(
    "q_J05_paired_delta_join",
    """SELECT a.seed, r9(a.accuracy) AS candidate_accuracy, r9(b.accuracy) AS baseline_accuracy, r9(a.accuracy - b.accuracy) AS delta_accuracy,
              r9(a.roc_auc) AS candidate_roc_auc, r9(b.roc_auc) AS baseline_roc_auc, r9(a.roc_auc - b.roc_auc) AS delta_roc_auc
       FROM runs a JOIN runs b ON a.seed = b.seed WHERE a.method = 'beta' AND b.method = 'alpha'""",
)
def _(t):
    runs = m.binary_metrics(t.predictions, ["method", "seed"])
    return j.paired_deltas(runs, "method", "beta", "alpha", ["seed"], ["accuracy", "roc_auc"])


@case(
    "q_J06_baseline_row_join",
    """SELECT r.method, r.seed, r9(r.accuracy) AS accuracy, r9(r.accuracy - b.accuracy) AS accuracy_delta_vs_baseline,
              r.accuracy - b.accuracy > 0 AS accuracy_improved_vs_baseline, r9(r.brier_score) AS brier_score,
              r9(r.brier_score - b.brier_score) AS brier_score_delta_vs_baseline,
              r.brier_score - b.brier_score < 0 AS brier_score_improved_vs_baseline
       FROM runs r JOIN runs b ON r.seed = b.seed AND b.method = 'alpha'""",
)
def _(t):
    runs = m.binary_metrics(t.predictions, ["method", "seed"]).select("method", "seed", "accuracy", "brier_score")
    return j.baseline_deltas(
        runs, ["seed"], F.col("method") == "alpha", ["accuracy", "brier_score"], lower_is_better=["brier_score"]
    )


def _tiles(t):
    wide = t.predictions_wide.select("id", "path", "y_true", "s1", "s2")
    return wide, wide.select(
        F.lower("path").alias("path_key"), "id", "y_true", F.col("s1").alias("global_score"), F.greatest("s1", "s2").alias("tile_max")
    )


@case(
    "q_J07_tile_score_replace",
    """SELECT lower(path) AS path_key, id, y_true, r9(greatest(s1, s2)) AS s1, r9(s2) AS s2 FROM predictions_wide""",
)
def _(t):
    wide, detail = _tiles(t)
    target = wide.select(F.lower("path").alias("path_key"), "id", "y_true", "s1", "s2")
    return j.replace_by_key(target, detail, "path_key", "s1", "tile_max")


@case(
    "q_J07_tile_score_replace_by_position",
    "SELECT id, path, y_true, r9(greatest(s1, s2)) AS s1, r9(s2) AS s2 FROM predictions_wide",
)
def _(t):
    wide, detail = _tiles(t)
    return j.replace_by_position(wide, detail, "id", "s1", "tile_max", "global_score")


BITS_A = """list_sum(list_transform(range(64), lambda k: CASE WHEN pixels[k + 1]::DOUBLE >= list_avg(pixels::DOUBLE[]) THEN (1::HUGEINT << (63 - k)) ELSE 0::HUGEINT END))::UBIGINT"""
BITS_D = """list_sum(list_transform(range(56), lambda k: CASE WHEN pixels[k + k // 7 + 1] > pixels[k + k // 7 + 2] THEN (1::HUGEINT << (55 - k)) ELSE 0::HUGEINT END))::UBIGINT"""
SHA = "sha256(array_to_string(list_transform(pixels, lambda x: CAST(round_even(x::DOUBLE * 1000000, 0)::BIGINT AS VARCHAR)), ','))"
SHARED["prints"] = f"SELECT id, path, split, class_name, {SHA} AS digest, {BITS_A} AS a, {BITS_D} AS d FROM pictures"


def prints(t):
    whole = F.array_join(F.transform("pixels", lambda x: F.rint(x.cast("double") * 1e6).cast("long").cast("string")), ",")
    return t.pictures.select(
        "id",
        "path",
        "split",
        "class_name",
        audit.content_hash(whole).alias("digest"),
        audit.average_hash(F.col("pixels")).alias("a"),
        audit.difference_hash(F.col("pixels"), 8).alias("d"),
    )


HEX = lambda c: f"lpad(lower(to_hex({c})), 16, '0')"


@case(
    "q_J08_hamming_join",
    f"""WITH u AS (SELECT DISTINCT a, d FROM prints)
        SELECT least({HEX('l.a')} || {HEX('l.d')}, {HEX('r.a')} || {HEX('r.d')}) AS low,
               greatest({HEX('l.a')} || {HEX('l.d')}, {HEX('r.a')} || {HEX('r.d')}) AS high,
               bit_count(xor(l.a, r.a)::UBIGINT) AS average_distance, bit_count(xor(l.d, r.d)::UBIGINT) AS difference_distance
        FROM u l JOIN u r ON (l.a < r.a OR (l.a = r.a AND l.d < r.d))
        WHERE bit_count(xor(l.a, r.a)) <= 4 AND bit_count(xor(l.d, r.d)) <= 4""",
)
def _(t):
    from sieveline.plans.banded import hamming_pairs

    pairs = hamming_pairs(prints(t).select("a", "d").distinct(), "a", "d", 4, 4)
    name = lambda side: F.concat(audit.hash_text(F.col(f"{side}_first")), audit.hash_text(F.col(f"{side}_second")))
    return pairs.select(
        F.least(name("left"), name("right")).alias("low"),
        F.greatest(name("left"), name("right")).alias("high"),
        F.col("first_distance").alias("average_distance"),
        F.col("second_distance").alias("difference_distance"),
    )


SHARED["unit_vectors"] = """
    SELECT vec_id, CAST(label % 2 AS INTEGER) AS label,
           list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v
    FROM embeddings"""
SHARED["knn10"] = """
    SELECT q.vec_id AS query_id, b.vec_id AS base_id, list_inner_product(q.v, b.v) AS similarity, b.label
    FROM unit_vectors q JOIN unit_vectors b ON q.vec_id <> b.vec_id
    QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, b.v) DESC, b.vec_id) <= 10"""


def unit_vectors(t):
    return t.embeddings.select(
        "vec_id", (F.col("label") % 2).cast("int").alias("label"), neighbours.unit(F.col("embedding")).alias("vector")
    )


def knn10(t):
    u = unit_vectors(t)
    return neighbours.nearest(
        u.select(F.col("vec_id").alias("query_id"), "vector"),
        u.select(F.col("vec_id").alias("base_id"), "vector", "label"),
        10,
        skip_self=True,
    )


@case("q_J09_knn_join", "SELECT query_id, base_id, r9(similarity) AS similarity, label FROM knn10")
def _(t):
    return knn10(t).drop("place")


@case(
    "q_J09_knn_scores",
    """SELECT query_id, k, temperature::DOUBLE AS temperature, r9(sum(exp((similarity - 1) * temperature) * label) / sum(exp((similarity - 1) * temperature))) AS score
       FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, base_id) AS place FROM knn10) n,
            (VALUES (1), (5), (10)) a(k), (VALUES (5.0::DOUBLE), (20.0::DOUBLE)) b(temperature)
       WHERE place <= k GROUP BY query_id, k, temperature""",
)
def _(t):
    return neighbours.vote(knn10(t), [1, 5, 10], [5.0, 20.0])


SHARED["expected_ids"] = "SELECT id FROM predictions_wide WHERE type <> 'view'"
SHARED["actual_ids"] = "SELECT id FROM predictions_wide WHERE type <> 'click'"


@case(
    "q_J10_coverage_anti_join",
    """SELECT id, 'missing' AS status FROM expected_ids WHERE id NOT IN (SELECT id FROM actual_ids)
       UNION ALL SELECT id, 'extra' FROM actual_ids WHERE id NOT IN (SELECT id FROM expected_ids)""",
)
def _(t):
    w = t.predictions_wide
    return j.coverage(w.where("type <> 'view'"), w.where("type <> 'click'"), "id")


@case(
    "q_J11_membership_semi_join",
    """SELECT id, method, r9(score) AS score FROM predictions
       WHERE id IN (SELECT id FROM predictions WHERE method = 'beta' AND score >= 0.75)""",
)
def _(t):
    chosen = t.predictions.where("method = 'beta' AND score >= 0.75")
    return j.membership(t.predictions, chosen, "id").select("id", "method", "score")


@case(
    "q_J12_fallback_override_join",
    """SELECT id, id AS row_no, r9(CASE WHEN type = 'error' THEN s1 ELSE s2 END) AS score, type = 'error' AS from_prediction
       FROM predictions_wide""",
)
def _(t):
    w = t.predictions_wide
    sample = w.select("id", F.col("id").alias("row_no"))
    scores = w.where("type = 'error'").select("id", F.col("s1").alias("score"))
    return j.fallback_override(sample, scores, w.select("id", F.col("s2").alias("score")), "id", "score", "row_no")


@case(
    "q_J13_grid_cross_join",
    """SELECT method, r9(threshold) AS threshold, r9(penalty) AS penalty,
              r9(tp / p - penalty * fp / n) AS utility
       FROM (SELECT method, threshold, sum(CASE WHEN score >= threshold THEN pos ELSE 0 END) AS tp, sum(pos) AS p,
                    sum(CASE WHEN score >= threshold THEN neg ELSE 0 END) AS fp, sum(neg) AS n
             FROM curve_m, (VALUES (0.2::DOUBLE), (0.4::DOUBLE), (0.5::DOUBLE), (0.6::DOUBLE), (0.8::DOUBLE)) g(threshold)
             GROUP BY method, threshold) x, (VALUES (1.0::DOUBLE), (4.0::DOUBLE)) h(penalty)""",
)
def _(t):
    cells = j.with_grid(m.histogram(t.predictions, ["method"]), threshold=[0.2, 0.4, 0.5, 0.6, 0.8])
    counts = cells.groupBy("method", "threshold").agg(*m.confusion_aggregates(F.col("threshold")))
    grid = j.with_grid(counts, penalty=[1.0, 4.0])
    tpr, fpr = F.col("tp") / (F.col("tp") + F.col("fn")), F.col("fp") / (F.col("fp") + F.col("tn"))
    return grid.select("method", "threshold", "penalty", (tpr - F.col("penalty") * fpr).alias("utility"))


@case(
    "q_J14_policy_fold_join",
    """WITH best AS (SELECT seed, method FROM runs QUALIFY row_number() OVER (PARTITION BY seed ORDER BY roc_auc DESC, method) = 1)
       SELECT 'auc' AS policy, f.method, f.seed, f.source_label, count(*) AS n
       FROM predictions f JOIN best USING (seed, method) GROUP BY ALL""",
)
def _(t):
    from pyspark.sql import Window

    runs = m.binary_metrics(t.predictions, ["method", "seed"])
    order = Window.partitionBy("seed").orderBy(F.desc("roc_auc"), "method")
    best = runs.withColumn("r", F.row_number().over(order)).where("r = 1").withColumn("policy", F.lit("auc"))
    folds = t.predictions.groupBy("method", "seed", "source_label").agg(F.count(F.lit(1)).alias("n"))
    return j.policy_folds(folds, best, ["method", "seed"], "policy").select("policy", "method", "seed", "source_label", "n")
