"""Result packaging, table checks, text scans and integrity."""

from pyspark.sql import functions as F

from sieveline.functions.scalar import path_key
from sieveline.operators import metrics as m, packaging as q, runstats as r, textscan as v
from sieveline.suite.q_runstats import R_SPREAD
from sieveline.suite.q_scalar import SUBMISSION
from sieveline.suite.registry import SHARED, case
from sieveline.suite.sqlparts import bundle


def submission(t):
    return q.package_submission(t.predictions_wide, "path", "s1")


@case("q_Q01_package_submission", f"SELECT {SUBMISSION} FROM submission")
def _(t):
    return submission(t)


@case(
    "q_Q01_submission_manifest",
    """SELECT count(*) AS n_rows, r9(min(fake_score)) AS score_min, r9(max(fake_score)) AS score_max, count(*) FILTER (predicted_label = 1) AS n_fake,
              count(*) FILTER (predicted_label = 0) AS n_real, count(*) FILTER (triage_decision = 'likely_real') AS n_likely_real,
              count(*) FILTER (triage_decision = 'uncertain') AS n_uncertain, count(*) FILTER (triage_decision = 'likely_fake') AS n_likely_fake FROM submission""",
)
def _(t):
    return q.submission_manifest(submission(t))


def sample(t):
    return t.predictions_wide.select(F.col("id").cast("string").alias("id"), F.col("id").alias("row_no"))


@case(
    "q_Q02_package_binary_labels",
    "SELECT CAST(id AS VARCHAR) AS id, id AS row_no, CASE WHEN s2 >= 0.6 THEN 1 ELSE 0 END AS label FROM predictions_wide",
)
def _(t):
    scored = t.predictions_wide.select(F.col("id").cast("string").alias("id"), "s2")
    return q.package_binary_labels(sample(t), "row_no", scored, "s2", 0.6)


SHARED["packed_scores"] = """
    SELECT CAST(id AS VARCHAR) AS id, id AS row_no, CASE WHEN type = 'error' THEN s1 ELSE s3 END AS label, type = 'error' AS from_prediction FROM predictions_wide"""


def packed(t):
    w = t.predictions_wide.withColumn("id", F.col("id").cast("string"))
    return q.package_scores(
        sample(t), "row_no", w.where("type = 'error'").select("id", F.col("s1").alias("score")), w.select("id", F.col("s3").alias("score")), "score"
    )


@case("q_Q03_package_scores", "SELECT id, row_no, r9(label) AS label, from_prediction FROM packed_scores")
def _(t):
    return packed(t)


@case(
    "q_Q03_score_package_stats",
    """SELECT count(*) AS n_rows, count(*) FILTER (from_prediction) AS n_prediction_rows, count(*) FILTER (NOT from_prediction) AS n_fallback_rows,
              r9(min(label)) AS label_min, r9(max(label)) AS label_max, r9(avg(label)) AS label_mean FROM packed_scores""",
)
def _(t):
    return q.score_package_stats(packed(t))


@case(
    "q_Q04_lint_submission",
    """WITH c AS (SELECT (SELECT count(*) FROM submission WHERE predicted_label <> CASE WHEN fake_score >= 0.5 THEN 1 ELSE 0 END) AS bad_label,
                        (SELECT count(*) FROM submission WHERE abs(confidence - abs(fake_score - 0.5) * 2) > 1e-6 + 1e-5 * abs(fake_score - 0.5) * 2) AS bad_conf,
                        (SELECT count(*) FROM predictions_wide WHERE type = 'view') AS extra)
       SELECT * FROM (VALUES ('required_columns', true), ('no_label_leakage_columns', false), ('image_id_nonempty', true), ('image_id_unique', true), ('fake_score_probability', true),
              ('predicted_label_name_consistent', true), ('triage_decision_consistent', true), ('optional_packager_columns', true)) x("check", passed)
       UNION ALL SELECT 'predicted_label_consistent', bad_label = 0 FROM c
       UNION ALL SELECT 'confidence_consistent', bad_conf = 0 FROM c
       UNION ALL SELECT 'expected_id_coverage', extra = 0 FROM c""",
)
def _(t):
    leaky = submission(t).withColumn("label", F.col("predicted_label"))
    expected = t.predictions_wide.where("type <> 'view'").select(F.col("id").cast("string").alias("image_id"))
    return q.lint_submission(leaky, expected).select("check", "passed")


@case(
    "q_Q05_lint_sample_match",
    """SELECT * FROM (VALUES ('row_count', true, 'row counts match'), ('ids_nonempty', true, 'all ids are non-empty'), ('ids_unique', true, 'all ids are unique'),
           ('sample_id_set', true, 'submission id set exactly matches sample'), ('label_values', true, 'all labels are binary 0/1')) x("check", passed, detail)
       UNION ALL SELECT 'sample_id_order', n = 0, CASE WHEN n = 0 THEN 'submission row order matches sample' ELSE n || ' rows are in another place' END
       FROM (SELECT count(*) AS n FROM (SELECT id, row_number() OVER (ORDER BY id) AS a, row_number() OVER (ORDER BY CASE WHEN type = 'error' THEN id + 100000000 ELSE id END) AS b FROM predictions_wide) y WHERE a <> b) z""",
)
def _(t):
    moved = F.when(F.col("type") == "error", F.col("id") + 100000000).otherwise(F.col("id"))
    rows = t.predictions_wide.select(
        F.col("id").cast("string").alias("id"), (F.col("s1") >= 0.5).cast("int").alias("label"), F.col("id").alias("row_no"), moved.alias("moved")
    )
    return q.lint_sample_match(rows.drop("moved"), rows.drop("row_no").withColumnRenamed("moved", "row_no"), "row_no")


SHARED["slice_runs"] = bundle("predictions", "method, seed")


@case(
    "q_Q06_lint_result_table",
    """WITH t AS (SELECT method || '-' || seed AS finding, CASE WHEN seed = 7 THEN accuracy + 0.001 ELSE accuracy END AS accuracy, roc_auc, recall, 1 - recall AS miss FROM slice_runs),
       s AS (SELECT method || '-' || seed AS finding, accuracy, roc_auc FROM slice_runs WHERE method <> 'gamma')
       SELECT 'keys_resolve' AS "check", count(*) = 0 AS passed, CASE WHEN count(*) = 0 THEN 'all keys are known' ELSE count(*) || ' unknown keys' END AS detail FROM t WHERE finding NOT IN (SELECT finding FROM s)
       UNION ALL SELECT 'accuracy_matches_source', count(*) = 0, CASE WHEN count(*) = 0 THEN 'all values match' ELSE count(*) || ' values differ' END FROM t JOIN s USING (finding) WHERE abs(t.accuracy - s.accuracy) > 1e-9
       UNION ALL SELECT 'roc_auc_matches_source', count(*) = 0, CASE WHEN count(*) = 0 THEN 'all values match' ELSE count(*) || ' values differ' END FROM t JOIN s USING (finding) WHERE abs(t.roc_auc - s.roc_auc) > 1e-9
       UNION ALL SELECT 'miss_rate_matches_recall', true, 'all miss rates equal 1 - recall'""",
)
def _(t):
    runs = m.binary_metrics(t.predictions, ["method", "seed"]).withColumn("finding", F.concat_ws("-", "method", "seed"))
    table = runs.select(
        "finding", F.when(F.col("seed") == 7, F.col("accuracy") + 0.001).otherwise(F.col("accuracy")).alias("accuracy"), "roc_auc", "recall", (1 - F.col("recall")).alias("miss")
    )
    return q.lint_result_table(table, runs.where("method <> 'gamma'"), "finding", ["accuracy", "roc_auc"], "recall", "miss")


@case(
    "q_Q06_unresolved_references",
    """SELECT key, reference FROM (SELECT c_custkey AS key, unnest([CAST(c_nationkey AS VARCHAR), CAST(c_nationkey + 20 AS VARCHAR)]) AS reference FROM customer) x
       WHERE reference NOT IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation)""",
)
def _(t):
    refs = F.concat(F.col("c_nationkey").cast("string"), F.lit(", "), (F.col("c_nationkey") + 20).cast("string"), F.lit(","))
    table = t.customer.select(F.col("c_custkey").alias("key"), refs.alias("refs"))
    return q.unresolved_references(table, "key", "refs", t.nation, "n_nationkey")


SHARED["variant_bundle"] = bundle("variants", "variant")


@case(
    "q_Q07_core_result_table",
    """SELECT 'same_domain' AS setting, method, NULL AS variant, r9(accuracy) AS accuracy, r9(roc_auc) AS roc_auc FROM slice_runs WHERE seed = 7
       UNION ALL SELECT 'robustness', NULL, variant, r9(accuracy), r9(roc_auc) FROM variant_bundle WHERE variant <> 'clean'""",
)
def _(t):
    runs = m.binary_metrics(t.predictions, ["method", "seed"]).where("seed = 7")
    shifted = m.binary_metrics(t.variants, ["variant"]).where("variant <> 'clean'")
    return q.core_result_table([("same_domain", runs), ("robustness", shifted)], ["method", "variant", "accuracy", "roc_auc"])


SHARED["keyed_spread"] = """
    SELECT s.* EXCLUDE (id), lower(w.path) AS path_key FROM spread_rows s JOIN predictions_wide w USING (id)"""
SHARED["keyed_cases"] = """
    SELECT * FROM (SELECT *, 'false_positive' AS "case" FROM keyed_spread WHERE alpha >= 0.5 AND y_true = 0 ORDER BY alpha DESC, path_key LIMIT 20) a
    UNION ALL SELECT * FROM (SELECT *, 'false_negative' FROM keyed_spread WHERE alpha < 0.5 AND y_true = 1 ORDER BY alpha, path_key LIMIT 20) b
    UNION ALL SELECT * FROM (SELECT *, 'disagreement' FROM keyed_spread WHERE score_spread >= 0.4 ORDER BY score_spread DESC, path_key LIMIT 20) c"""


@case(
    "q_Q08_failure_case_select",
    f"""SELECT "case", path_key, m.caption, {R_SPREAD.replace('id, ', '', 1)} FROM keyed_cases c JOIN metadata m USING (path_key)""",
)
def _(t):
    p = t.predictions.withColumn("path_key", path_key("path"))
    return q.failure_cases(p, t.metadata, "path_key", ["alpha", "beta", "gamma"], "alpha", 0.5, 20, 0.4)


# ---- text scans ---------------------------------------------------------------

# the SQL engine's patterns have no lookahead; a user in angle brackets is left out by the characters a name may have
SQL_SECRET = r"""(?i)\b(?:api[_-]?key|secret|token|password|aws_access_key_id|github_token|kaggle_key)\b\s*[:=]\s*['"]?[A-Za-z0-9_\-]{12,}"""
SQL_USER_PATH = r"""(?i)[A-Z]:[\\/]+Users[\\/]+[^\\/,\s;:"'<>]+[\\/]+[^\s,;"'<>]*"""
SQL_EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
SQL_REPOSITORY = r"(?i)https?://(?:www\.)?github\.com/[^\s)\]}]+"


def scan_sql(issue, pattern, severity, around=60):
    p = pattern.replace("'", "''")
    return f"""
    SELECT doc_id, '{issue}' AS issue, '{severity}' AS severity, len(head) - len(replace(head, chr(10), '')) + 1 AS line,
           replace(replace(substr(text, greatest(start - {around}, 0) + 1, start + len(hit) + {around} - greatest(start - {around}, 0)), chr(10), ' '), chr(13), ' ') AS example
    FROM (SELECT *, CAST(start_at AS BIGINT) AS start, substr(text, 1, CAST(start_at AS BIGINT)) AS head FROM (
            SELECT doc_id, text, hits[i] AS hit,
                   list_sum(list_transform(gaps[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: len(h))), 0) AS start_at
            FROM (SELECT doc_id, text, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS gaps FROM documents
                  WHERE regexp_matches(text, '{p}')) a, unnest(range(1, len(hits) + 1)) u(i)) b) c"""


@case(
    "q_V01_privacy_scan",
    scan_sql("secret_like_assignment", SQL_SECRET, "blocker")
    + " UNION ALL "
    + scan_sql("local_absolute_path", SQL_USER_PATH, "blocker"),
)
def _(t):
    return v.scan(t.documents, "doc_id", "text", v.PRIVACY_RULES)


@case(
    "q_V01_placeholder_counts",
    r"""SELECT doc_id, CAST(1 + doc_id % 3 AS INTEGER) AS n_placeholders FROM documents WHERE doc_id % 7 = 0""",
)
def _(t):
    # the given texts name no such folder: a seventh of them gets one to three
    noted = F.when(F.col("doc_id") % 7 == 0, F.repeat(F.lit(" C:\\Users\\<you>\\data"), (1 + F.col("doc_id") % 3).cast("int")))
    marked = t.documents.withColumn("text", F.concat("text", F.coalesce(noted, F.lit(""))))
    return v.placeholder_counts(marked, "doc_id", "text")


NAMES = ("marie", "bank", "license")


@case(
    "q_V02_identity_scan",
    scan_sql("email_address", SQL_EMAIL, "blocker", 70)
    + " UNION ALL "
    + scan_sql("github_url", SQL_REPOSITORY, "blocker", 70)
    + " UNION ALL "
    + scan_sql("personal_identifier", r"(?i)\b(?:" + "|".join(NAMES) + r")\b", "blocker", 70),
)
def _(t):
    return v.scan(t.documents, "doc_id", "text", [*v.IDENTITY_RULES, v.personal_rule(NAMES)], around=70)


BENCH, CLAIM, NOT = r"(?i)\b(?:the|der|les)\b", r"(?i)\b(?:and|und|que)\b", r"(?i)\b(?:of|von|pas)\b"


def words_sql(pattern):
    """Word limits that know accented letters, which the SQL engine's own do not."""
    limit = r"[^\p{L}\p{N}_]"
    return "(?i)(?:^|" + limit + ")" + pattern[6:-2] + "(?:$|" + limit + ")"




@case(
    "q_V03_unsafe_claim_scan",
    f"""SELECT doc_id, CAST(i AS INTEGER) AS line, trim(lines[i]) AS line_text FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS lines FROM documents) d, unnest(range(1, len(lines) + 1)) u(i)
        WHERE regexp_matches(lines[i], '{words_sql(BENCH)}') AND regexp_matches(lines[i], '{words_sql(CLAIM)}') AND NOT regexp_matches(lines[i], '{words_sql(NOT)}')""",
)
def _(t):
    return v.unsafe_claims(t.documents, "doc_id", "text", BENCH, CLAIM, NOT)


@case(
    "q_V04_prefix_redaction",
    """SELECT doc_id, sha256(replace(replace(text, 'eron', '<repo>'), 'ent', '<repo>')) AS redacted_sha,
              CAST((len(text) - len(replace(text, 'eron', ''))) // 4 + (len(replace(text, 'eron', '<repo>')) - len(replace(replace(text, 'eron', '<repo>'), 'ent', ''))) // 3 AS INTEGER) AS n_replaced
       FROM documents""",
)
def _(t):
    out = v.redact_prefixes(t.documents, "text", ["ent", "eron"])
    return out.select("doc_id", F.sha2("redacted", 256).alias("redacted_sha"), "n_replaced")


SHARED["hash_rows"] = """
    SELECT 'doc/' || a.doc_id AS path, a.kind, d.doc_id IS NOT NULL AS exists, d.n_chars AS size_bytes,
           CASE WHEN d.doc_id IS NULL THEN 'missing' ELSE 'hashed' END AS hash_status, sha256(d.text) AS sha256
    FROM (SELECT doc_id, 'table' AS kind FROM labels UNION ALL SELECT item_id + 100000000, 'planning' FROM benchmark) a LEFT JOIN documents d ON a.doc_id = d.doc_id"""


def doc_files(t):
    return t.documents.select(
        F.concat(F.lit("doc/"), "doc_id").alias("path"), F.col("n_chars").alias("size_bytes"), F.sha2("text", 256).alias("sha256")
    )


def manifest(t):
    wanted = t.labels.select("doc_id", F.lit("table").alias("kind")).unionByName(
        t.benchmark.select((F.col("item_id") + 100000000).alias("doc_id"), F.lit("planning").alias("kind"))
    )
    return wanted.select(F.concat(F.lit("doc/"), "doc_id").alias("path"), "kind")


@case("q_V05_hash_manifest", "SELECT * FROM hash_rows")
def _(t):
    return v.hash_manifest(manifest(t), doc_files(t))


@case(
    "q_V06_hash_verify",
    """WITH h AS (SELECT CAST(substr(path, 5) AS BIGINT) AS doc_id, * FROM hash_rows), now AS (SELECT doc_id, text || CASE WHEN lang = 'de' THEN '!' ELSE '' END AS text, n_chars FROM documents WHERE lang <> 'es'),
       j AS (SELECT h.*, now.doc_id IS NOT NULL AS there, sha256(now.text) AS now_sha, now.n_chars AS now_size FROM h LEFT JOIN now USING (doc_id))
       SELECT 'hash statuses valid' AS "check", true AS passed, 0::BIGINT AS n_problems
       UNION ALL SELECT 'hashed artifacts exist', count(*) = 0, count(*) FROM j WHERE hash_status = 'hashed' AND NOT there
       UNION ALL SELECT 'sha256 values match', count(*) = 0, count(*) FROM j WHERE hash_status = 'hashed' AND there AND sha256 <> now_sha
       UNION ALL SELECT 'size values match', count(*) = 0, count(*) FROM j WHERE hash_status = 'hashed' AND there AND size_bytes <> now_size
       UNION ALL SELECT 'missing artifacts still absent', count(*) = 0, count(*) FROM j WHERE hash_status = 'missing' AND there""",
)
def _(t):
    changed = F.concat("text", F.when(F.col("lang") == "de", "!").otherwise(""))
    now = t.documents.where("lang <> 'es'").select(
        F.concat(F.lit("doc/"), "doc_id").alias("path"), F.col("n_chars").alias("size_bytes"), F.sha2(changed, 256).alias("sha256")
    )
    return v.hash_verify(v.hash_manifest(manifest(t), doc_files(t)), now)
