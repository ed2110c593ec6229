"""Corpus audit and duplicates."""

from pyspark.sql import functions as F

from sieveline.operators import audit
from sieveline.suite.q_joins import HEX, prints
from sieveline.suite.registry import SHARED, case

# file tree over the documents: source/<train|test>/<class folder>/<id>.png
SHARED["files"] = """
    SELECT doc_id, source || '/' || CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END || '/' ||
           CASE WHEN lang IN ('en', 'de') THEN 'REAL photos' ELSE 'ai-generated' END || '/' || CAST(doc_id AS VARCHAR) || '.png' AS path
    FROM documents"""


def files(t):
    part = F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train")
    cls = F.when(F.col("lang").isin("en", "de"), "REAL photos").otherwise("ai-generated")
    return t.documents.select(
        "doc_id", F.concat_ws("/", "source", part, cls, F.concat(F.col("doc_id").cast("string"), F.lit(".png"))).alias("path")
    )


FOLDERS = """
    WITH p AS (SELECT string_split(path, '/') AS p FROM files),
    x AS (SELECT i - 1 AS depth, array_to_string(p[1:i - 1], '/') AS folder, p[i] AS child
          FROM p, unnest([1, 2, 3, 4]) u(i)),
    k AS (SELECT folder, depth, child, count(*) AS n,
                 CASE WHEN child = 'REAL photos' THEN 'real' WHEN child = 'ai-generated' THEN 'fake' END AS kind
          FROM x GROUP BY ALL),
    c AS (SELECT folder, depth, sum(CASE WHEN kind IS NOT NULL THEN n ELSE 0 END)::BIGINT AS n_files,
                 split_part(folder, '/', -1) AS name
          FROM k GROUP BY folder, depth HAVING count(DISTINCT kind) = 2)
"""


@case(
    "q_D01_layout_candidates",
    FOLDERS
    + """SELECT folder, depth, n_files, CASE WHEN name = 'train' THEN 3 ELSE 0 END AS train_score,
                CASE WHEN name = 'test' THEN 3 ELSE 0 END AS test_score FROM c""",
)
def _(t):
    return audit.layout_candidates(files(t), "path")


LAYOUT = """
    l AS (SELECT 'train' AS role, min(folder) AS folder FROM c WHERE name = 'train'
          UNION ALL SELECT 'test', min(folder) FROM c WHERE name = 'test')
"""


@case("q_D01_layout_discovery", FOLDERS + "," + LAYOUT + "SELECT role, folder FROM l")
def _(t):
    return audit.discover_layout(files(t), "path")


@case(
    "q_D02_labelled_records",
    FOLDERS
    + ","
    + LAYOUT
    + """SELECT path, CASE WHEN contains(path, '/ai-generated/') THEN 1 ELSE 0 END AS label,
                split_part(path, '/', 3) AS class_name, role
         FROM files, l WHERE starts_with(path, folder || '/')""",
)
def _(t):
    f = files(t)
    return audit.labelled_records(f, "path", audit.discover_layout(f, "path"))


@case("q_D03_content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(t):
    return t.documents.select("doc_id", audit.content_hash("text").alias("sha256"))


@case("q_D04_average_hash", f"SELECT id, {HEX('a')} AS average_hash FROM prints")
def _(t):
    return t.pictures.select("id", audit.hash_text(audit.average_hash(F.col("pixels"))).alias("average_hash"))


@case("q_D05_difference_hash", f"SELECT id, {HEX('d')} AS difference_hash FROM prints")
def _(t):
    return t.pictures.select("id", audit.hash_text(audit.difference_hash(F.col("pixels"), 8)).alias("difference_hash"))


SHARED["split_corpus"] = """
    SELECT doc_id, path, class_name, label, n_chars, sha256(content) AS digest,
           CASE WHEN substr(sha256('7:' || path), 1, 1) < '4' THEN 'test' ELSE 'train' END AS split FROM corpus"""


def split_corpus(t):
    first = F.substring(F.sha2(F.concat(F.lit("7:"), F.col("path")), 256), 1, 1)
    return t.corpus.select(
        "doc_id",
        "path",
        "class_name",
        "label",
        "n_chars",
        audit.content_hash("content").alias("digest"),
        F.when(first < "4", "test").otherwise("train").alias("split"),
    )


SHARED["dup_groups"] = """
    SELECT digest AS sha256, count(*) AS n_images, list_sort(list(DISTINCT split)) AS splits, list_sort(list(DISTINCT class_name)) AS classes,
           count(DISTINCT split) > 1 AS cross_split, count(DISTINCT class_name) > 1 AS cross_class
    FROM split_corpus GROUP BY digest HAVING count(*) > 1"""


def groups(t):
    return audit.exact_duplicate_groups(split_corpus(t), "digest", "split", "class_name")


@case("q_D06_exact_duplicate_groups", "SELECT * FROM dup_groups")
def _(t):
    return groups(t)


@case(
    "q_D06_duplicate_members",
    """SELECT digest, path, split, class_name, n_images FROM split_corpus JOIN dup_groups ON digest = sha256""",
)
def _(t):
    return audit.duplicate_members(split_corpus(t), "digest", ["path", "split", "class_name"])


SHARED["near_rows"] = """
    SELECT l.a AS la, l.d AS ld, r.a AS ra, r.d AS rd, bit_count(xor(l.a, r.a)) AS da, bit_count(xor(l.d, r.d)) AS dd,
           l.split <> r.split AS cs, l.class_name <> r.class_name AS cc, l.path AS lp, r.path AS rp
    FROM prints l JOIN prints r ON l.id < r.id AND l.digest <> r.digest
     AND bit_count(xor(l.a, r.a)) <= 4 AND bit_count(xor(l.d, r.d)) <= 4"""


@case(
    "q_D07_near_duplicate_pairs",
    f"""SELECT least({HEX('la')} || {HEX('ld')}, {HEX('ra')} || {HEX('rd')}) AS low,
               greatest({HEX('la')} || {HEX('ld')}, {HEX('ra')} || {HEX('rd')}) AS high,
               any_value(da) AS average_distance, any_value(dd) AS difference_distance, count(*) AS n_pairs,
               count(*) FILTER (cs) AS n_cross_split, count(*) FILTER (cc) AS n_cross_class
        FROM near_rows GROUP BY low, high""",
)
def _(t):
    pairs = audit.near_duplicate_pairs(prints(t))
    name = lambda side: F.concat(audit.hash_text(F.col(f"{side}_average")), audit.hash_text(F.col(f"{side}_difference")))
    return pairs.select(
        F.least(name("left"), name("right")).alias("low"),
        F.greatest(name("left"), name("right")).alias("high"),
        "average_distance",
        "difference_distance",
        "n_pairs",
        "n_cross_split",
        "n_cross_class",
    )


SHARED["audit_row"] = """
    SELECT * FROM (SELECT count(*) AS n_images, count(DISTINCT digest) AS n_unique_sha256 FROM prints) a,
      (SELECT count(*) AS n_duplicate_groups, coalesce(sum(n), 0)::BIGINT AS n_duplicate_images, count(*) FILTER (s > 1) AS n_cross_split_duplicate_groups,
              count(*) FILTER (c > 1) AS n_cross_class_duplicate_groups
       FROM (SELECT count(*) AS n, count(DISTINCT split) AS s, count(DISTINCT class_name) AS c FROM prints GROUP BY digest HAVING count(*) > 1) g) b,
      (SELECT count(*) AS n_near_duplicate_pairs, count(*) FILTER (cs) AS n_cross_split_near_duplicate_pairs,
              count(*) FILTER (cc) AS n_cross_class_near_duplicate_pairs FROM near_rows) n"""


def summary(t):
    rows = prints(t)
    return audit.audit_summary(
        rows, audit.exact_duplicate_groups(rows, "digest", "split", "class_name"), audit.near_duplicate_pairs(rows)
    )


@case("q_D08_audit_summary", "SELECT * FROM audit_row")
def _(t):
    return summary(t)


@case(
    "q_D09_leakage_gate",
    """WITH g AS (SELECT unnest([
            {'place': 0, 'gate': 'cross_split_duplicates', 'n': n_cross_split_duplicate_groups, 'reason': n_cross_split_duplicate_groups || ' cross-split exact duplicate groups'},
            {'place': 1, 'gate': 'cross_split_near_duplicates', 'n': n_cross_split_near_duplicate_pairs, 'reason': n_cross_split_near_duplicate_pairs || ' cross-split near-duplicate pairs'},
            {'place': 2, 'gate': 'cross_class_duplicates', 'n': n_cross_class_duplicate_groups, 'reason': n_cross_class_duplicate_groups || ' cross-class exact duplicate groups'},
            {'place': 3, 'gate': 'cross_class_near_duplicates', 'n': n_cross_class_near_duplicate_pairs, 'reason': n_cross_class_near_duplicate_pairs || ' cross-class near-duplicate pairs'}
       ]) AS x FROM audit_row)
       SELECT x.place, x.gate, x.n, x.reason FROM g WHERE x.n > 0""",
)
def _(t):
    return audit.leakage_reasons(summary(t))
