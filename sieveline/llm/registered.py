"""One query per operator over its whole table, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import bpe, collocations, conversation_repair, html_extract, license_scan, media, ngram_join, packing, pii, suffix_dedup, token_planes, topk, toxicity
from sieveline.llm.common import pick, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


@query("op6_bpe_encode_decode")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


TOP_K_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum([coalesce(p[1], 0) * coalesce(p[2], 0) FOR p IN list_zip(q.w, c.w)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""


@query("op7_exact_top_k", TOP_K_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").filter(topk.usable(F.col("embedding")))
    weighted = vectors.select("vec_id", topk.weights(F.col("embedding")).alias("weights"))
    return topk.top_k(weighted, F.col("vec_id") % 50 == 0, each_row=True)


@query("op8_media_columns")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.load(media.store(table(spark, sf_dir, "documents"))))


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op3_html_extract")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    texts = html_extract.extract(pages, html_extract.train(pages))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


@query("op5_license_scan", license_scan.check_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(table(spark, sf_dir, "documents")))


@query("op10_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    texts = toxicity.store(docs)
    scored = toxicity.judge(texts, toxicity.learn(texts, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")
    held_out = F.coalesce(toxicity.fold(F.col("doc_id")) == toxicity.HELD_OUT, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op2_ngram_jaccard_join")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op1_suffix_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_all(table(spark, sf_dir, "documents"))


@query("op11_token_planes")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = token_planes.read(token_planes.store(table(spark, sf_dir, "documents")), as_bytes=True)
    return coded.select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the damage that their conversation and turn name: dropped, emptied, cut, repeated, or given to the user."""
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = rows.withColumn("_fault", fault).where("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    times = F.when(F.col("_fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("_fault") == 4, "user").otherwise(space("role")).alias("role"),
        text.alias("text"),
        F.explode(times).alias("_copy"),
    ).drop("_copy")


@query("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.digests(damaged(rows), rows)


@query("op13_collocations", collocations.check_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
