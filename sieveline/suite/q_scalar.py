"""Row-level rules."""

from pyspark.sql import functions as F

from sieveline.functions import scalar as s
from sieveline.suite.q_sampling import hash_sql
from sieveline.suite.registry import SHARED, case

# folder names made from the documents' own words: kind words come up through the language names
SHARED["folder_names"] = """
    SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'ai-' || lang WHEN 1 THEN 'Human ' || source WHEN 2 THEN 'machine_generated'
        WHEN 3 THEN 'REAL_' || lang WHEN 4 THEN 'human-vs-ai' WHEN 5 THEN 'Photograph ' || lang WHEN 6 THEN lang ELSE 'ai_human' END AS name
    FROM documents"""


def folder_names(t):
    return t.documents.selectExpr(
        "doc_id",
        """CASE doc_id % 8 WHEN 0 THEN 'ai-' || lang WHEN 1 THEN 'Human ' || source WHEN 2 THEN 'machine_generated'
           WHEN 3 THEN 'REAL_' || lang WHEN 4 THEN 'human-vs-ai' WHEN 5 THEN 'Photograph ' || lang WHEN 6 THEN lang ELSE 'ai_human' END AS name""",
    )


_lst = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


@case(
    "q_P01_class_kind",
    f"""WITH x AS (SELECT doc_id, name, replace(replace(lower(name), '-', '_'), ' ', '_') AS n FROM folder_names),
        y AS (SELECT *, list_append(string_split(n, '_'), n) AS tokens FROM x)
        SELECT doc_id, CASE WHEN list_has_any(tokens, {_lst(s.HUMAN_TOKENS)}) AND NOT list_has_any(tokens, {_lst(s.HUMAN_OVERRIDES)}) THEN 'real'
                            WHEN list_has_any(tokens, {_lst(s.FAKE_TOKENS)}) THEN 'fake' WHEN list_has_any(tokens, {_lst(s.REAL_TOKENS)}) THEN 'real' END AS kind FROM y""",
)
def _(t):
    return folder_names(t).select("doc_id", s.class_kind("name").alias("kind"))


@case(
    "q_P02_path_key",
    """SELECT page_id, lower(replace(replace(url, '/', '\\'), '\\', '/')) AS path_key,
              lower(split_part(replace(url, '\\', '/'), '/', -1)) AS file_key FROM pages""",
)
def _(t):
    p = t.pages.withColumn("windows", F.translate("url", "/", "\\"))
    return p.select("page_id", s.path_key("windows").alias("path_key"), s.file_key("windows").alias("file_key"))


SHARED["image_values"] = """
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN 'train/' || CAST(doc_id AS VARCHAR) || '.jpeg'
        WHEN 2 THEN 'public_test\\' || CAST(doc_id AS VARCHAR) ELSE 'other/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.v2.png' END AS value FROM documents"""


def image_values(t):
    d = F.col("doc_id").cast("string")
    value = (
        F.when(F.col("doc_id") % 4 == 0, d)
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("train/"), d, F.lit(".jpeg")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("public_test\\"), d))
        .otherwise(F.concat(F.lit("other/"), "lang", F.lit("/"), d, F.lit(".v2.png")))
    )
    return t.documents.select("doc_id", value.alias("value"))


@case(
    "q_P03_competition_path",
    """WITH x AS (SELECT doc_id, replace(value, '\\', '/') AS v FROM image_values),
       y AS (SELECT doc_id, split_part(v, '/', -1) AS name, CASE WHEN split_part(v, '/', 1) IN ('train', 'public_test') THEN split_part(v, '/', 1) ELSE 'public_test' END AS part FROM x)
       SELECT doc_id, part || '/' || part || '/' || CASE WHEN contains(name, '.') THEN name ELSE name || '.jpeg' END AS path FROM y""",
)
def _(t):
    return image_values(t).select("doc_id", s.competition_path("value").alias("path"))


@case(
    "q_P04_image_id",
    """SELECT doc_id, value AS by_path, split_part(replace(value, '\\', '/'), '/', -1) AS by_name,
              regexp_replace(split_part(replace(value, '\\', '/'), '/', -1), '(.)[.][^.]+$', '\\1') AS by_stem FROM image_values""",
)
def _(t):
    return image_values(t).select(
        "doc_id", *[s.image_id("value", m).alias(f"by_{m}") for m in ("path", "name", "stem")]
    )


SHARED["category_paths"] = """
    SELECT id, 'Data/' || CASE id % 4 WHEN 0 THEN 'AI_Humans/x' WHEN 1 THEN 'real_' || type WHEN 2 THEN 'misc/ai_' || type || '_big' ELSE 'plain' END || '/' || id || '.png' AS path
    FROM predictions_wide"""


@case(
    "q_P05_path_category",
    """SELECT id, CASE id % 4 WHEN 0 THEN 'human' WHEN 1 THEN type WHEN 2 THEN type || '_big' ELSE 'unknown' END AS category FROM predictions_wide""",
)
def _(t):
    path = F.expr(
        "'Data/' || CASE id % 4 WHEN 0 THEN 'AI_Humans/x' WHEN 1 THEN 'real_' || type WHEN 2 THEN 'misc/ai_' || type || '_big' ELSE 'plain' END || '/' || id || '.png'"
    )
    return t.predictions_wide.select("id", s.path_category(path).alias("category"))


@case(
    "q_P06_source_name",
    """SELECT event_id, CASE WHEN k IS NULL THEN 'source_missing' WHEN k = '0' THEN 'real' WHEN k = '1' THEN 'sd21' WHEN k = '2' THEN 'sdxl' WHEN k = '3' THEN 'sd3'
              WHEN k = '4' THEN 'dalle3' WHEN k = '5' THEN 'midjourney6' ELSE 'source_' || k END AS name
       FROM (SELECT event_id, CASE WHEN user_id % 11 = 0 THEN NULL ELSE CAST(user_id % 9 AS VARCHAR) END AS k FROM events) x""",
)
def _(t):
    # numbers as a float column reads them: 3 becomes '3.0'
    label = F.when(F.col("user_id") % 11 != 0, (F.col("user_id") % 9).cast("double"))
    return t.events.select("event_id", s.source_name(label).alias("name"))


@case(
    "q_P07_seed_from_path",
    "SELECT id, method, seed FROM predictions",
)
def _(t):
    path = F.concat_ws("/", F.lit("runs"), F.concat(F.lit("seed"), F.col("seed").cast("string")), "method", F.lit("seedless.json"))
    return t.predictions.select("id", "method", s.seed_from_path(path).alias("seed"))


@case(
    "q_P08_logit_sigmoid_clip",
    """SELECT id, r9(ln(q / (1 - q))) AS logit, r9(1 / (1 + exp(-ln(q / (1 - q)) / 2.0))) AS halved
       FROM (SELECT id, greatest(least(s1, 0.999999::DOUBLE), 1e-6::DOUBLE) AS q FROM predictions_wide) x""",
)
def _(t):
    z = s.logit(F.col("s1"))
    return t.predictions_wide.select("id", z.alias("logit"), s.sigmoid(z / 2.0).alias("halved"))


TRIAGE = "CASE WHEN s1 <= 0.2 THEN 'likely_real' WHEN s1 >= 0.8 THEN 'likely_fake' ELSE 'uncertain' END"


@case("q_P09_triage_decision", f"SELECT id, {TRIAGE} AS decision FROM predictions_wide")
def _(t):
    return t.predictions_wide.select("id", s.triage_decision(F.col("s1"), 0.2, 0.8).alias("decision"))


SHARED["submission"] = f"""
    SELECT CAST(id AS VARCHAR) AS image_id, round_even(s1 * 1000000, 0) / 1000000 AS fake_score, CASE WHEN s1 >= 0.5 THEN 1 ELSE 0 END AS predicted_label,
           CASE WHEN s1 >= 0.5 THEN 'fake' ELSE 'real' END AS predicted_label_name, round_even(abs(s1 - 0.5) * 2 * 1000000, 0) / 1000000 AS confidence, {TRIAGE} AS triage_decision
    FROM predictions_wide"""
SUBMISSION = "image_id, r9(fake_score) AS fake_score, predicted_label, predicted_label_name, r9(confidence) AS confidence, triage_decision"


@case("q_P10_submission_projection", f"SELECT {SUBMISSION} FROM submission")
def _(t):
    columns = [c.alias(n) for n, c in s.submission_columns(F.col("s1")).items()]
    return t.predictions_wide.select(F.col("id").cast("string").alias("image_id"), *columns)


HEXES = """(SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 32) AS h FROM documents)"""
_num = lambda e: f"CAST(('0x' || {e})::UBIGINT AS DOUBLE)"


@case(
    "q_P11_id_hex_features",
    "SELECT doc_id, "
    + ", ".join(f"r9({_num(f'substr(h, {1 + 8 * i}, 8)')} / 4294967295.0) AS id_hex_{i}" for i in range(4))
    + f", r9({_num('substr(h, 1, 2)')} / 255.0) AS id_first_byte, r9({_num('substr(h, 31, 2)')} / 255.0) AS id_last_byte FROM {HEXES} x",
)
def _(t):
    ident = F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 32)
    return t.documents.select("doc_id", *[c.alias(n) for n, c in s.id_hex_features(ident).items()])


@case(
    "q_P12_size_features",
    f"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE size END AS raw, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE size::DOUBLE END AS s FROM sizes),
        m AS (SELECT quantile_cont(s, 0.5) AS med FROM x),
        f AS (SELECT doc_id, raw, coalesce(s, med) AS size_filled FROM x, m), c AS (SELECT avg(ln(1 + size_filled)) AS mean_log FROM f)
        SELECT doc_id, r9(size_filled) AS size_filled, r9(ln(1 + size_filled)) AS log_size, r9(sqrt(size_filled)) AS sqrt_size, r9(size_filled / 1024) AS size_kb,
               r9((trunc(size_filled)::BIGINT % 997) / 997.0) AS size_mod_997, r9((trunc(size_filled)::BIGINT % 4096) / 4096.0) AS size_mod_4096,
               CASE WHEN raw IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS has_released_size,
               {_num(hash_sql('doc_id', '7'))} AS path_score_seed, {_num(hash_sql('doc_id', '1016'))} AS path_score_seed_alt,
               r9(ln(1 + size_filled) - mean_log) AS log_size_centered, r9(abs(ln(1 + size_filled) - mean_log)) AS log_size_abs_centered
        FROM f, c""",
)
def _(t):
    rows = t.sizes.select("doc_id", F.when(F.col("doc_id") % 13 != 0, F.col("size")).alias("size"))
    return s.with_size_features(rows, "doc_id", "size", 7).drop("size")


@case(
    "q_P13_stress_tier",
    """SELECT id, CASE WHEN least(a, b) <= -0.045 THEN 'major_drop' WHEN least(a, b) <= -0.02 THEN 'moderate_drop' WHEN a >= 0.005 AND b >= 0.005 THEN 'apparent_gain' ELSE 'stable_or_mild' END AS tier
       FROM (SELECT id, (s1 - s2) / 10 AS a, (s1 - s3) / 10 AS b FROM predictions_wide) x""",
)
def _(t):
    a, b = (F.col("s1") - F.col("s2")) / 10, (F.col("s1") - F.col("s3")) / 10
    return t.predictions_wide.select("id", s.stress_tier(a, b).alias("tier"))


METHOD_NAMES = """CASE id % 9 WHEN 0 THEN 'Score-Fusion ' || type WHEN 1 THEN 'Frozen CLIP ' || type WHEN 2 THEN 'DINOv2 + fusion' WHEN 3 THEN 'Physics-Guided ResNet'
    WHEN 4 THEN 'ResNet-18' WHEN 5 THEN 'combined_v3' WHEN 6 THEN 'Source-threshold' WHEN 7 THEN 'ConvNeXt ' || type ELSE type END"""


@case(
    "q_P14_method_family",
    f"""SELECT id, CASE WHEN m LIKE '%fusion%' OR m LIKE '%source-%' OR m LIKE '%source %' THEN 'score/source fusion' WHEN m LIKE '%clip%' OR m LIKE '%dinov2%' OR m LIKE '%convnext%' THEN 'frozen foundation'
             WHEN m LIKE '%physics-guided%' THEN 'physics-guided neural' WHEN m LIKE '%resnet%' THEN 'task-trained neural' WHEN contains(m, 'combined_v') THEN 'physical/signal conventional' ELSE 'other' END AS family
        FROM (SELECT id, lower({METHOD_NAMES}) AS m FROM predictions_wide) x""",
)
def _(t):
    return t.predictions_wide.select("id", s.method_family(F.expr(METHOD_NAMES)).alias("family"))


@case(
    "q_P15_policy_label",
    """SELECT method, seed, policy FROM runs, (VALUES ('uncapped_fd1_rc1_rfp4_fmp1p5'), ('cap0p48_fd1_rc1_rfp4_fmp1p5'), ('cap0p5_fd0p25_rc2_rfpm1_fmp0')) g(policy)""",
)
def _(t):
    labels = [s.policy_label(*p) for p in ((None, 1, 1, 4, 1.5), (0.48, 1, 1, 4, 1.5), (0.5, 0.25, 2, -1, 0))]
    runs = t.predictions.select("method", "seed").distinct()
    return runs.withColumn("policy", F.explode(F.array(*[F.lit(x) for x in labels])))


@case(
    "q_P16_score_validity",
    """SELECT count(*) AS n_rows, count(*) FILTER (v IS NULL) AS n_missing, 0::BIGINT AS n_not_finite, count(*) FILTER (v < 0 OR v > 1) AS n_out_of_range, 0::BIGINT AS n_bad_label, false AS valid
       FROM (SELECT CASE WHEN event_id % 101 = 0 THEN NULL ELSE value / 40 END AS v FROM events) x""",
)
def _(t):
    rows = t.events.select(
        F.when(F.col("event_id") % 101 != 0, F.col("value") / 40).alias("score"),
        F.col("event_type").isin("error", "purchase").cast("int").alias("y_true"),
    )
    return s.score_validity(rows)


@case(
    "q_P17_canonical_label",
    "SELECT id, CASE WHEN type IN ('error', 'purchase') THEN 'ai_generated' ELSE 'real' END AS label FROM predictions_wide",
)
def _(t):
    kinds = s.canonical_label("type", ["click", "view", "scroll", "login", "signup"], ["error", "purchase"])
    return t.predictions_wide.select("id", kinds.alias("label"))


@case(
    "q_P18_split_name_score",
    """SELECT doc_id, CASE WHEN n IN ('train', 'training') THEN 3 WHEN n LIKE '%train%' THEN 2 ELSE 0 END AS train_score,
              CASE WHEN n IN ('test', 'testing', 'val', 'valid', 'validation') THEN 3 WHEN n LIKE '%test%' OR n LIKE '%val%' THEN 2 ELSE 0 END AS test_score
       FROM (SELECT doc_id, lower(CASE doc_id % 5 WHEN 0 THEN 'Train' WHEN 1 THEN 'my_training_' || lang WHEN 2 THEN 'Validation' WHEN 3 THEN 'old-test' ELSE lang END) AS n FROM documents) x""",
)
def _(t):
    name = F.expr("CASE doc_id % 5 WHEN 0 THEN 'Train' WHEN 1 THEN 'my_training_' || lang WHEN 2 THEN 'Validation' WHEN 3 THEN 'old-test' ELSE lang END")
    return t.documents.select(
        "doc_id",
        s.split_name_score(name, s.TRAIN_NAMES).alias("train_score"),
        s.split_name_score(name, s.TEST_NAMES).alias("test_score"),
    )


SLUG = "CASE WHEN z = '' THEN 'image' ELSE z END"


@case(
    "q_P19_slug_unique_id",
    f"""WITH x AS (SELECT doc_id, regexp_replace(regexp_replace(lower(trim(lang || '_' || source || ' - ' || (doc_id % 7))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS z FROM documents),
        y AS (SELECT doc_id, {SLUG} AS s FROM x)
        SELECT doc_id, s || CASE WHEN n = 1 THEN '' ELSE '_' || CAST(n AS VARCHAR) END AS image_id
        FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id) AS n FROM y) w""",
)
def _(t):
    name = F.concat("lang", F.lit("_"), "source", F.lit(" - "), (F.col("doc_id") % 7).cast("string"))
    from sieveline.operators.packaging import unique_slugs

    return unique_slugs(t.documents.select("doc_id", s.slug(name).alias("slug")), "slug", "doc_id").select("doc_id", "image_id")


@case(
    "q_P20_default_image_path",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || '/x.png' ELSE 'public_test/' || CAST(doc_id AS VARCHAR) || '.jpeg' END AS image_path FROM documents",
)
def _(t):
    given = F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit("/x.png")))
    return t.documents.select("doc_id", s.default_image_path("doc_id", given).alias("image_path"))


FEATURES = """['recon_half_abs_mean', 'recon_quarter_laplacian_abs_mean', 'recon_fft20_abs_p95', 'recon_svd8_tile16_std_p90', 'recon_fft20_fft35_abs_mean_delta', 'recon_fft20_svd8_abs_mean_ratio']"""


@case(
    "q_P21_feature_family",
    f"""WITH x AS (SELECT doc_id, ({FEATURES})[1 + doc_id % 6] AS name FROM documents)
        SELECT doc_id, name, CASE WHEN name LIKE 'recon_half%' OR name LIKE 'recon_quarter%' THEN 'resize_residual' WHEN name LIKE 'recon_fft%' AND name NOT LIKE '%delta%' AND name NOT LIKE '%ratio%' THEN 'fft_lowpass_residual'
               WHEN name LIKE 'recon_svd%' AND name NOT LIKE '%delta%' AND name NOT LIKE '%ratio%' THEN 'svd_lowrank_residual' ELSE 'cross_reconstructor_delta' END AS family FROM x""",
)
def _(t):
    names = F.expr(f"array{FEATURES.replace('[', '(').replace(']', ')')}")
    rows = t.documents.select("doc_id", F.get(names, (F.col("doc_id") % 6).cast("int")).alias("name"))
    return rows.withColumn("family", s.reconstruction_feature_family(F.col("name")))
