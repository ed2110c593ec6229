"""Models on feature tables, and the held-out-source grids that fit them."""

from pyspark.sql import functions as F

from sieveline.functions.scalar import id_hex_features, stable_hash, with_size_features
from sieveline.operators import metrics as m, models as g, neighbours, runstats as r, sampling
from sieveline.session import cut_lineage, scratch_path
from sieveline.suite.q_joins import knn10
from sieveline.suite.registry import SHARED, case
from sieveline.suite.sqlparts import audet, bundle, curve, det, point

FEATURES = [f"f{i}" for i in range(64)]


def vectors(t):
    """Embedding columns with a seeded split; label 1 is every odd class."""
    rows = t.embeddings.select(
        "vec_id",
        (F.col("label") % 2).cast("int").alias("y_true"),
        *[F.get("embedding", i).cast("double").alias(f) for i, f in enumerate(FEATURES)],
    )
    part = F.when(F.substring(stable_hash("vec_id", 7), 1, 1) < "4", "test").otherwise("train")
    return rows.withColumn("part", part)


def quality(model_or_scored, by="part"):
    return m.binary_metrics(model_or_scored, [by])


@case(
    "q_F17_standardise_features",
    """WITH l AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
       s AS (SELECT i, avg(x) AS mu, stddev_pop(x) AS sd FROM l GROUP BY i)
       SELECT vec_id, r9(sum(z)) AS total, r9(max(z)) AS top FROM (SELECT vec_id, (x - mu) / CASE WHEN sd < 1e-6 THEN 1 ELSE sd END AS z FROM l JOIN s USING (i)) q GROUP BY vec_id""",
)
def _(t):
    rows = vectors(t)
    scaled = g.standardise(rows, rows, FEATURES)
    return scaled.select("vec_id", sum((F.col(f) for f in FEATURES[1:]), F.col("f0")).alias("total"), F.greatest(*FEATURES).alias("top"))


@case("q_G01_logistic_baseline")
def _(t):
    rows = vectors(t)
    model = g.fit_scaled_logistic(rows.where("part = 'train'"), FEATURES, "y_true")
    return quality(model.score(rows))


def _classifier(t, estimator):
    rows = vectors(t)
    model = g.fit_classifier(rows.where("part = 'train'"), FEATURES, "y_true", estimator)
    return quality(g.classifier_score(model, rows))


@case("q_G02_random_forest_baseline")
def _(t):
    return _classifier(t, g.random_forest("y_true", trees=60))


@case("q_G03_boosting_baseline")
def _(t):
    return _classifier(t, g.boosting("y_true", rounds=8))


@case("q_G04_mlp_baseline")
def _(t):
    return _classifier(t, g.perceptron("y_true", 64, rounds=30))


SHARED["long_features"] = "SELECT vec_id, CAST(label % 2 AS INTEGER) AS label, unnest(range(64)) AS feature, unnest(embedding)::DOUBLE AS value FROM embeddings"
SHARED["anova"] = """
    SELECT feature, ((sum(s * s / n) - pow(sum(s), 2) / sum(n)) / (count(*) - 1)) / ((sum(q) - sum(s * s / n)) / (sum(n) - count(*))) AS f_value
    FROM (SELECT feature, label, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM long_features GROUP BY ALL) c GROUP BY feature"""


def long(t):
    rows = t.embeddings.withColumn("y", (F.col("label") % 2).cast("int")).drop("label")
    return g.long_features(rows, "vec_id", "y", "embedding")


@case("q_G05_select_k_anova", "SELECT feature, r9(f_value) AS f_value FROM anova ORDER BY f_value DESC, feature LIMIT 20")
def _(t):
    return g.select_k(g.anova_f(long(t)), "f_value", 20)


@case(
    "q_G06_select_k_mutual_info",
    """WITH b AS (SELECT feature, label, CAST(floor(rk * 10.0 / n) AS INTEGER) AS bin, n FROM (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) - 1 AS rk, count(*) OVER (PARTITION BY feature) AS n FROM long_features) x),
       c AS (SELECT feature, bin, label, any_value(n) AS total, count(*) AS k FROM b GROUP BY feature, bin, label),
       d AS (SELECT *, sum(k) OVER (PARTITION BY feature, bin) AS kb, sum(k) OVER (PARTITION BY feature, label) AS kl FROM c)
       SELECT feature, r9(sum(k / total * ln(k * total / (kb * kl)))) AS mutual_information FROM d GROUP BY feature ORDER BY 2 DESC, 1 LIMIT 20""",
)
def _(t):
    return g.select_k(g.binned_mutual_information(long(t)), "mutual_information", 20)


@case(
    "q_G07_selected_names",
    """SELECT 'f' || CAST(feature AS VARCHAR) AS feature, 1 AS n_selected, 'anova' AS runs, CASE WHEN feature < 32 THEN 'base' ELSE 'extra' END AS kind
       FROM anova ORDER BY f_value DESC, feature LIMIT 20""",
)
def _(t):
    rows = vectors(t)
    kept = g.anova_selector(rows, FEATURES, "y_true", 20)
    names = t.spark.createDataFrame([(k,) for k in kept], "feature string")
    return r.feature_frequency(
        names.agg(F.lit("anova").alias("run"), F.collect_list("feature").alias("selected")), "run", "selected", FEATURES[:32]
    )


@case("q_G08_cross_dataset_score")
def _(t):
    rows = vectors(t)
    model = g.fit_classifier(rows.where("part = 'train'"), FEATURES, "y_true", g.random_forest("y_true", trees=20))
    folder = scratch_path(t.spark, "model")
    model.save(folder)
    return quality(g.cross_dataset_score(folder, rows, FEATURES))


SHARED["blend_knn"] = """
    SELECT v.k, v.temperature, w.head_weight, b.label AS y_true, w.head_weight * h.head + (1 - w.head_weight) * v.score AS score
    FROM (SELECT query_id, k, temperature, sum(exp((similarity - 1) * temperature) * label) / sum(exp((similarity - 1) * temperature)) AS score
          FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, base_id) AS place FROM knn10) n,
               (VALUES (3), (10)) a(k), (VALUES (5.0::DOUBLE), (20.0::DOUBLE)) b(temperature) WHERE place <= k GROUP BY query_id, k, temperature) v
    JOIN (SELECT vec_id, 1 / (1 + exp(-10 * embedding[1]::DOUBLE)) AS head FROM embeddings) h ON h.vec_id = v.query_id
    JOIN (SELECT vec_id, CAST(label % 2 AS INTEGER) AS label FROM embeddings) b ON b.vec_id = v.query_id, (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) w(head_weight)"""
SHARED["blend_shown"] = "SELECT k, temperature, head_weight, y_true, round(score, 12) AS score FROM blend_knn"
_K = "k, temperature, head_weight"
SHARED["knn_runs"] = bundle("blend_shown", _K)
SHARED["knn_curve"] = curve("blend_shown", _K)
SHARED["knn_det"] = det("knn_curve", _K)
SHARED["knn_point"] = point("knn_det", _K)
SHARED["knn_audet"] = audet("knn_det", _K)


@case(
    "q_G09_knn_head_blend",
    f"""SELECT {_K}, r9(accuracy) AS accuracy, r9(roc_auc) AS roc_auc, r9(apcer) AS apcer, r9(audet_proxy) AS audet_proxy, r9(audet_proxy + 0.2 * apcer) AS selection_objective
        FROM knn_runs JOIN knn_point USING ({_K}) JOIN knn_audet USING ({_K})""",
)
def _(t):
    votes = cut_lineage(neighbours.vote(knn10(t), [3, 10], [5.0, 20.0]))  # read more than once; one search
    heads = t.embeddings.select(
        F.col("vec_id").alias("query_id"),
        (F.col("label") % 2).cast("int").alias("y_true"),
        (1.0 / (1.0 + F.exp(-10.0 * F.get("embedding", 0).cast("double")))).alias("head_score"),
    )
    return g.knn_head_blend(votes, heads, [0.0, 0.5, 1.0])


META = ["log_size", "sqrt_size", "size_mod_997", "size_mod_4096", "log_size_abs_centered", "id_hex_0", "id_hex_1", "id_first_byte"]


def metadata(t):
    d = t.corpus.withColumn("hex_id", F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 32))
    d = d.select("doc_id", F.col("label").alias("y_true"), "class_name", "hex_id", F.col("n_chars").alias("size"))
    sized = with_size_features(d, "hex_id", "size", 7)
    return sized.withColumns(id_hex_features("hex_id")).select("doc_id", "y_true", "class_name", *META)


@case("q_G10_metadata_model")
def _(t):
    rows = cut_lineage(metadata(t))
    fit = lambda train: g.fit_scaled_logistic(train, META, "y_true")
    split = cut_lineage(sampling.strata_split(rows, "doc_id", ["class_name", "y_true"], 0.2, 7))
    holdout = fit(split.where("split = 'train'")).score(split.where("split = 'val'"))
    folds = sampling.stratified_kfold(rows.select("doc_id", "y_true"), "doc_id", "y_true", 5, 7)
    oof = g.out_of_fold_scores(rows, "doc_id", META, "y_true", folds, 5, fit)
    both = holdout.select(F.lit("holdout").alias("part"), "y_true", "score").unionByName(
        oof.select(F.lit("out_of_fold").alias("part"), "y_true", "score")
    )
    counts = cut_lineage(m.running(both, ["part"]))
    return m.join_groups(m.summarise_running(counts, ["part"]), m.operating_metrics_of(counts, ["part"]), ["part"])


def seeded(t):
    rows = vectors(t).withColumnRenamed("part", "first_part")
    return sampling.stratified_split(rows, "vec_id", "y_true", 0.25, [7, 17], "vec_id").withColumnRenamed("split_seed", "seed")


@case("q_G11_ablation_grid")
def _(t):
    rows = cut_lineage(seeded(t))
    tables = {
        name: (rows.where("split = 'train'"), rows.where("split = 'test'"), cols)
        for name, cols in (("low", FEATURES[:16]), ("all", FEATURES))
    }
    return g.ablation_grid(tables, "y_true", [0.1, 1.0], [7, 17])


@case("q_G12_seed_repeat")
def _(t):
    rows = cut_lineage(seeded(t))
    table = g.ablation_grid({"all": (rows.where("split = 'train'"), rows.where("split = 'test'"), FEATURES)}, "y_true", [1.0], [7, 17])
    return r.seed_summary(table, ["feature_set"], ["accuracy", "roc_auc", "f1"])
