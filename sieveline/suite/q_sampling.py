"""Seeded splits and samples."""

from pyspark.sql import functions as F

from sieveline.operators import sampling as s
from sieveline.functions import scalar
from sieveline.suite.registry import case


def hash_sql(text, seed):
    return f"substr(sha256({seed} || ':' || lower(replace(CAST({text} AS VARCHAR), '\\', '/'))), 1, 16)"


def tie_sql(c):
    return f"sha256(CAST({c} AS VARCHAR)), {c}"


WIDE = "predictions_wide"


@case("q_L01_stable_hash", f"SELECT id, {hash_sql('path', '7')} AS hash FROM {WIDE}")
def _(t):
    return t.predictions_wide.select("id", scalar.stable_hash("path", 7).alias("hash"))


@case(
    "q_L02_stratified_split",
    f"""SELECT id, split_seed, CASE WHEN row_number() OVER (PARTITION BY split_seed, y_true ORDER BY h, {tie_sql('id')})
                 <= greatest(1, round_even(n * 0.2::DOUBLE, 0)) THEN 'test' ELSE 'train' END AS split
        FROM (SELECT id, split_seed, y_true, {hash_sql('path', 'split_seed')} AS h,
                     count(*) OVER (PARTITION BY split_seed, y_true) AS n
              FROM {WIDE}, (VALUES (7), (17), (29)) s(split_seed)) x""",
)
def _(t):
    out = s.stratified_split(t.predictions_wide, "path", "y_true", 0.2, [7, 17, 29], "id")
    return out.select("id", "split_seed", "split")


STRATA_SQL = f"""
    SELECT id, type, y_true, CASE WHEN row_number() OVER (PARTITION BY type, y_true ORDER BY h, {tie_sql('id')})
             <= least(n - 1, greatest(1, round_even(n * 0.2::DOUBLE, 0))) THEN 'val' ELSE 'train' END AS split
    FROM (SELECT id, type, y_true, {hash_sql('id', '7')} AS h, count(*) OVER (PARTITION BY type, y_true) AS n FROM {WIDE}) x"""


@case("q_L03_strata_split", f"SELECT id, split FROM ({STRATA_SQL}) s")
def _(t):
    return s.strata_split(t.predictions_wide, "id", ["type", "y_true"], 0.2, 7).select("id", "split")


@case(
    "q_L04_leave_one_group_out",
    """WITH g AS (SELECT source, count(*) FILTER (label = 0) AS val_real, count(*) FILTER (label = 1) AS val_fake
                  FROM corpus GROUP BY source),
       a AS (SELECT sum(val_real) AS r, sum(val_fake) AS f FROM g)
       SELECT source, val_real, val_fake, CAST(r - val_real AS BIGINT) AS train_real, CAST(f - val_fake AS BIGINT) AS train_fake,
              val_real > 0 AND val_fake > 0 AND r > val_real AND f > val_fake AS usable FROM g, a""",
)
def _(t):
    return s.leave_one_group_out_folds(t.corpus, "source")


@case(
    "q_L04_leave_one_group_out_rows",
    "SELECT id, y_true, seed, CASE WHEN seed = 17 THEN 'val' ELSE 'train' END AS split FROM predictions_wide",
)
def _(t):
    rows = t.predictions_wide.select("id", "y_true", "seed")
    return s.leave_one_group_out(rows, "seed", 17, "y_true")


LIMIT = 1001


@case(
    "q_L05_balanced_limit",
    f"""WITH x AS (SELECT id, y_true, {hash_sql('path', '7')} AS h, {hash_sql('path', '24')} AS h2 FROM {WIDE}),
        q AS (SELECT greatest(1, {LIMIT} // count(DISTINCT y_true)) AS k FROM x),
        r AS (SELECT x.*, row_number() OVER (PARTITION BY y_true ORDER BY h, {tie_sql('id')}) <= k AS first FROM x, q),
        m AS (SELECT {LIMIT} - count(*) AS missing FROM r WHERE first)
        SELECT id FROM r WHERE first
        UNION ALL
        SELECT id FROM (SELECT id, row_number() OVER (ORDER BY h2, {tie_sql('id')}) AS n FROM r WHERE NOT first) z, m
        WHERE n <= missing""",
)
def _(t):
    return s.balanced_limit(t.predictions_wide, "path", "y_true", LIMIT, 7, "id").select("id")


@case(
    "q_L06_round_robin_limit",
    f"""SELECT id FROM (SELECT id, type, y_true, row_number() OVER (PARTITION BY type, y_true ORDER BY h, {tie_sql('id')}) AS turn
                        FROM (SELECT *, {hash_sql('id', '7')} AS h FROM {WIDE}) x) y
        ORDER BY turn, type, y_true LIMIT {LIMIT + 6}""",
)
def _(t):
    return s.round_robin_limit(t.predictions_wide, "id", ["type", "y_true"], LIMIT + 6, 7).select("id")


@case(
    "q_L07_group_head_limit",
    f"""WITH x AS (SELECT id, type, y_true, {hash_sql('id', '7')} AS h FROM {WIDE}),
        q AS (SELECT greatest(1, {LIMIT} // count(*)) AS k FROM (SELECT DISTINCT type, y_true FROM x) g),
        r AS (SELECT x.*, row_number() OVER (PARTITION BY type, y_true ORDER BY h, {tie_sql('id')}) <= k AS first FROM x, q),
        m AS (SELECT {LIMIT} - count(*) AS missing FROM r WHERE first)
        SELECT id FROM r WHERE first
        UNION ALL
        SELECT id FROM (SELECT id, row_number() OVER (ORDER BY h, {tie_sql('id')}) AS n FROM r WHERE NOT first) z, m
        WHERE n <= missing""",
)
def _(t):
    return s.group_head_limit(t.predictions_wide, "id", ["type", "y_true"], LIMIT, 7).select("id")


@case("q_L08_hash_head", f"SELECT id FROM {WIDE} ORDER BY {hash_sql('id', '7')}, {tie_sql('id')} LIMIT 500")
def _(t):
    return s.hash_head(t.predictions_wide, "id", 500, 7).select("id")


@case(
    "q_L09_key_holdout",
    f"""WITH k AS (SELECT DISTINCT lower(path) AS path_key FROM {WIDE} WHERE y_true = 0)
        SELECT path_key FROM (SELECT path_key, count(*) OVER () AS n,
                                     row_number() OVER (ORDER BY {hash_sql('path_key', '11')}, {tie_sql('path_key')}) AS r FROM k) x
        WHERE r <= least(n - 1, greatest(1, round_even(n * 0.3::DOUBLE, 0)))""",
)
def _(t):
    real = t.predictions.where("y_true = 0").select(scalar.path_key("path").alias("path_key"))
    return s.key_holdout(real, "path_key", 0.3, 11)


@case(
    "q_L10_calibration_split",
    f"""SELECT id, CASE WHEN row_number() OVER (PARTITION BY y_true ORDER BY h, {tie_sql('id')})
                 <= least(n - 1, greatest(1, round_even(n * 0.25::DOUBLE, 0))) THEN 'calibration' ELSE 'fit' END AS split
        FROM (SELECT id, y_true, {hash_sql('path', '5')} AS h, count(*) OVER (PARTITION BY y_true) AS n FROM {WIDE}) x""",
)
def _(t):
    return s.calibration_split(t.predictions_wide, "path", "y_true", 0.25, 5, "id").select("id", "split")


@case(
    "q_L11_source_capped_sample",
    f"""WITH x AS (SELECT id, source_label, y_true, row_number() OVER (PARTITION BY source_label ORDER BY id) AS n FROM {WIDE}),
        f AS (SELECT id, row_number() OVER (ORDER BY id) AS m FROM x WHERE y_true = 1 AND source_label IN (1, 2, 4) AND n <= 100)
        SELECT id FROM x WHERE y_true = 0 AND n <= 500
        UNION ALL SELECT id FROM f WHERE m <= 250""",
)
def _(t):
    kind = F.when(F.col("y_true") == 0, "real").otherwise("ai_generated")
    rows = t.predictions_wide.withColumn("kind", kind)
    return s.source_capped_sample(rows, "kind", "source_label", "id", 500, 250, 100, [1, 2, 4]).select("id")


@case(
    "q_L12_download_plan",
    f"""WITH p AS (SELECT DISTINCT 'public_test/public_test/' || CAST(user_id AS VARCHAR) || '.jpeg' AS path FROM events)
        SELECT path, row_number() OVER (ORDER BY {hash_sql('path', '7')}) AS place FROM p""",
)
def _(t):
    return s.download_plan(t.events, "user_id", 7, "public_test")


@case(
    "q_L13_inverse_frequency_resample",
    """WITH g AS (SELECT type, y_true, count(*) AS size FROM predictions_wide GROUP BY type, y_true),
       m AS (SELECT type, y_true, share / size AS mean, ceil(share / size) AS parts FROM g, (SELECT sum(size) / count(*) AS share FROM g) t),
       p AS (SELECT w.id, m.type, m.y_true, mean / parts AS rate, unnest(range(0, CAST(parts AS BIGINT))) AS part
             FROM predictions_wide w JOIN m ON w.type = m.type AND w.y_true = m.y_true),
       h AS (SELECT *, CAST('0x' || substr(sha256('7:' || part || ':' || id), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM p),
       c AS (SELECT type, y_true, id, sum(len([k FOR k IN range(0, 18)
                IF exp(-rate) * list_sum([pow(rate, j) / factorial(CAST(j AS INTEGER))::DOUBLE FOR j IN range(0, k + 1)]) <= u])) AS n
             FROM h GROUP BY type, y_true, id)
       SELECT type, y_true, CAST(sum(n) AS BIGINT) AS n_drawn, count(*) AS n_rows, CAST(max(n) AS BIGINT) AS most_copies
       FROM c WHERE n > 0 GROUP BY type, y_true""",
)
def _(t):
    drawn = s.inverse_frequency_resample(t.predictions_wide, "id", ["type", "y_true"], 7)
    return drawn.groupBy("type", "y_true", "id").count().groupBy("type", "y_true").agg(
        F.sum("count").alias("n_drawn"), F.count(F.lit(1)).alias("n_rows"), F.max("count").alias("most_copies")
    )


@case(
    "q_L14_stratified_kfold",
    f"""SELECT id, CAST((row_number() OVER (PARTITION BY y_true ORDER BY {hash_sql('id', '7')}, {tie_sql('id')}) - 1) % 5 AS INTEGER) AS fold
        FROM {WIDE}""",
)
def _(t):
    return s.stratified_kfold(t.predictions_wide, "id", "y_true", 5, 7).select("id", "fold")
