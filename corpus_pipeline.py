"""The corpus pipeline: from `documents` to packed training sequences, stage by stage.

Every stage takes what its predecessor kept, written as Parquet and read again,
and all but the last return the columns of `documents`. What a stage wrote for
itself goes when it is done, and what it read goes with it, unless given. Columns named `n_chars`
are brought up to date where a stage changes texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import ngram_join, packing, pii, suffix_dedup, toxicity
from sieveline.llm.common import table
from sieveline.session import delete_scratch, freed_shuffles, passing_scratch, scratch_path

REJECT = 0.5
"""Documents of this toxicity or more go."""


PASSAGE, PASSAGE_GRAM = 200, 100
"""Bytes of a repeated passage, and of its anchors: 51 words of three letters hold 203."""


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity, learned from the labelled ones among them, lies below REJECT."""
    names = docs.columns
    others = [n for n in names if n not in ("doc_id", "text")]
    texts = toxicity.store(docs, keep=tuple(others))
    scored = toxicity.judge(texts, toxicity.learn(texts, table(spark, sf_dir, "labels")), with_text=True)
    held = scored.toDF("doc_id", "text", *others, "toxicity")
    return held.filter(F.col("toxicity") < REJECT).select(*names)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies."""
    return ngram_join.keep_one(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document, or an earlier place, holds already."""
    return _counted(suffix_dedup.keep_first(docs, length=PASSAGE, gram=PASSAGE_GRAM))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return _counted(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes in the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_near_copies),
    ("suffix_dedup", drop_repeats),
    ("pii", redact_pii),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    with freed_shuffles(spark):
        for name, stage in STAGES:
            path = scratch_path(spark, name)
            with passing_scratch(spark):
                stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                delete_scratch(spark, before)  # no later stage reads it
            before = path
    return docs
