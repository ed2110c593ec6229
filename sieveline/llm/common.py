"""Helpers shared by the training-data operators: exact-case column picking, row blocks, text keys."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 4 << 20
"""Text handled at once inside a task; a single longer text is a block of its own."""


_KEPT: list[dict] = []


def kept_in_worker() -> dict:
    """A dict that outlives a task in a reused worker, until an operator makes room."""
    _KEPT.append({})
    return _KEPT[-1]


def make_room() -> None:
    """Let go what other operators left in this worker; they load it again if they come back."""
    for held in _KEPT:
        held.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by exact name.

    Extra columns never clash with what an operator adds, not even those
    whose name differs from a wanted one by case alone.
    """
    at = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(at))])
    return plain.select(*[plain[f"c{at.index(n)}"].alias(n) for n in names])


def with_fields(df: DataFrame, **kinds: str) -> T.StructType:
    """The schema of `df` and further fields."""
    schema = T.StructType(list(df.schema.fields))
    for name, kind in kinds.items():
        schema = schema.add(name, kind)
    return schema


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one block hold `most` bytes, or are a single text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text, as two longs `k1` and `k2`."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]
