"""Evaluation tables derived from the given ones, as the same SQL text for Spark and the SQL check.

`predictions_wide` turns every event into a scored row, `predictions` is its long
form, `corpus` labels every document, `grid8` reads an embedding as an 8x8
picture, `variants` shifts one score the way an altered input would, and
`sizes` gives each document an id and a size.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

_SCORE = (
    "CAST({w} AS DOUBLE)*y + CAST({rest} AS DOUBLE)"
    " * (CAST((event_id*{prime}) % 1009 AS DOUBLE)/CAST(1009 AS DOUBLE)) AS {name}"
)

VIEWS: dict[str, str] = {
    "predictions_wide": f"""
        SELECT event_id AS id,
               'Val/' || CASE WHEN y = 1 THEN 'ai_' ELSE 'real_' END || event_type || '/'
                 || CAST(event_id AS STRING) || '.PNG' AS path,
               y AS y_true,
               CAST(CASE WHEN y = 1 THEN 1 + user_id % 5 ELSE 0 END AS INT) AS source_label,
               event_type AS type,
               CASE event_id % 3 WHEN 0 THEN 7 WHEN 1 THEN 17 ELSE 29 END AS seed,
               {_SCORE.format(w=0.2, rest=0.8, prime=7919, name="s1")},
               {_SCORE.format(w=0.3, rest=0.7, prime=104729, name="s2")},
               {_SCORE.format(w=0.1, rest=0.9, prime=1299709, name="s3")}
        FROM (SELECT *, CASE WHEN event_type IN ('error', 'purchase') THEN 1 ELSE 0 END AS y
              FROM events) e""",
    "predictions": """
        SELECT id, path, y_true, source_label, type, seed, 'alpha' AS method, s1 AS score
        FROM predictions_wide
        UNION ALL
        SELECT id, path, y_true, source_label, type, seed, 'beta' AS method, s2 AS score
        FROM predictions_wide
        UNION ALL
        SELECT id, path, y_true, source_label, type, seed, 'gamma' AS method, s3 AS score
        FROM predictions_wide""",
    "variants": """
        SELECT id, y_true, seed, 'clean' AS variant, s1 AS score FROM predictions_wide
        UNION ALL
        SELECT id, y_true, seed, 'dimmed' AS variant, s1 * CAST(0.9 AS DOUBLE) AS score FROM predictions_wide
        UNION ALL
        SELECT id, y_true, seed, 'squared' AS variant, s1 * s1 AS score FROM predictions_wide
        UNION ALL
        SELECT id, y_true, seed, 'lifted' AS variant,
               CAST(1 AS DOUBLE) - (CAST(1 AS DOUBLE) - s1) * CAST(0.8 AS DOUBLE) AS score
        FROM predictions_wide""",
    "corpus": """
        SELECT d.doc_id, d.source || '/' || d.lang || '/' || CAST(d.doc_id AS STRING) AS path,
               d.lang AS class_name, d.source, d.text AS content, d.n_chars,
               l.quality, l.toxic, CAST(CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END AS INT) AS label
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "grid8": """
        SELECT vec_id, label, embedding AS pixels FROM embeddings""",
    "pictures": """
        SELECT vec_id AS id, 'train/' || CAST(vec_id AS VARCHAR) AS path, 'train' AS split,
               CASE WHEN label % 2 = 1 THEN 'fake' ELSE 'real' END AS class_name, embedding AS pixels
        FROM embeddings
        UNION ALL
        SELECT vec_id + 10000000, 'test/' || CAST(vec_id AS VARCHAR), 'test',
               CASE WHEN label % 3 = 1 THEN 'fake' ELSE 'real' END,
               CASE WHEN vec_id % 3 = 0 THEN embedding
                    ELSE list_concat(list_reverse(embedding[1:3]), embedding[4:64]) END
        FROM embeddings""",
    "metadata": """
        SELECT lower(path) AS path_key, 'val' AS split, y_true AS label, source_label AS source_id,
               'event ' || type AS caption FROM predictions_wide""",
    "sizes": """
        SELECT doc_id, n_chars AS size FROM documents""",
}

# The long forms as one scan with a generator; same rows as the unions above.
SPARK_FORMS: dict[str, str] = {
    "predictions": """
        SELECT id, path, y_true, source_label, type, seed,
               stack(3, 'alpha', s1, 'beta', s2, 'gamma', s3) AS (method, score)
        FROM predictions_wide""",
    "variants": """
        SELECT id, y_true, seed,
               stack(4, 'clean', s1, 'dimmed', s1 * CAST(0.9 AS DOUBLE), 'squared', s1 * s1,
                     'lifted', CAST(1 AS DOUBLE) - (CAST(1 AS DOUBLE) - s1) * CAST(0.8 AS DOUBLE)) AS (variant, score)
        FROM predictions_wide""",
}
SPARK_FORMS["pictures"] = """
    SELECT id, path, split, class_name, pixels FROM (
        SELECT vec_id, label, embedding,
               CASE WHEN vec_id % 3 = 0 THEN embedding
                    ELSE concat(reverse(slice(embedding, 1, 3)), slice(embedding, 4, 61)) END AS altered
        FROM embeddings) e
    LATERAL VIEW stack(2,
        vec_id, 'train/' || CAST(vec_id AS STRING), 'train', CASE WHEN label % 2 = 1 THEN 'fake' ELSE 'real' END, embedding,
        vec_id + 10000000, 'test/' || CAST(vec_id AS STRING), 'test', CASE WHEN label % 3 = 1 THEN 'fake' ELSE 'real' END, altered
    ) s AS id, path, split, class_name, pixels"""


def _uses(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", sql)]


class Tables:
    """The given tables and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._frames:
            if name in VIEWS:
                sql = SPARK_FORMS.get(name, VIEWS[name])
                used = _uses(sql, [*TABLES, *(v for v in VIEWS if v != name)])
                frames = {u: getattr(self, u) for u in used if re.search(rf"(FROM|JOIN) {u}\b", sql)}
                for u in frames:
                    sql = re.sub(rf"(FROM|JOIN) {u}\b", rf"\1 {{{u}}}", sql)
                self._frames[name] = self.spark.sql(sql, **frames)
            elif name in TABLES:
                self._frames[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._frames[name]


def _rounded(sql: str) -> str:
    """`r9(expr)` in a check query means: round to 9 digits, without a negative zero."""
    while (at := sql.find("r9(")) >= 0:
        depth, end = 0, at + 2
        for end in range(at + 2, len(sql)):
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if depth == 0:
                break
        sql = f"{sql[:at]}(round(CAST({sql[at + 3:end]} AS DOUBLE), 9) + 0.0){sql[end + 1:]}"
    return sql


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix the view definitions a check query refers to."""
    known = {**VIEWS, **(extra or {})}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _uses(text, known):
            if name not in needed:
                visit(known[name])
                if name not in needed:
                    needed.append(name)

    body = sql.strip()
    visit(body)
    views = [
        f"{n} AS {'MATERIALIZED ' if extra and n in extra else ''}({re.sub(r'\bINT\b', 'INTEGER', known[n]).strip()})"
        for n in needed
    ]
    if body.upper().startswith("WITH "):
        body = body[5:]
        return _rounded("WITH " + ",\n".join([*views, body]))
    return _rounded(("WITH " + ",\n".join(views) + "\n" if views else "") + body)
