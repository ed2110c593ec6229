"""Writers, and stores that are written and read again."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators.neighbours import unit
from sieveline.session import cut_lineage


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per variant: path, y_true, fake_score, raw_fake_score."""
    rows = df.select("variant", "path", "y_true", "fake_score", "raw_fake_score")
    rows.write.mode("overwrite").option("header", "true").partitionBy("variant").format(fmt).save(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """Small JSON manifest, keys sorted."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def write_files(df: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """Every row's bytes as a file of its own below `folder`; `path` and `length` of what was written.

    Names may hold folders. A file is written aside and moved into place, so
    attempts of tasks that are lost or run twice leave whole files only. The folder
    must be one that all executors reach.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if folder.startswith("file:") or "://" not in folder:
            store, root = pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
        else:
            store, root = pafs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))
        made = set()
        for batch in batches:
            paths = [posixpath.join(root, n) for n in batch.column("name").to_pylist()]
            lengths = []
            for path, data in zip(paths, batch.column("content")):
                parent = posixpath.dirname(path)
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                aside = posixpath.join(parent, f"_{uuid.uuid4().hex}")
                with store.open_output_stream(aside) as out:
                    out.write(data.as_buffer())
                store.move(aside, path)
                lengths.append(data.as_buffer().size)
            yield pa.record_batch([pa.array(paths, pa.string()), pa.array(lengths, pa.int64())], names=["path", "length"])

    rows = df.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content"))
    return cut_lineage(rows.mapInArrow(run, "path string, length long"))


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored features, or an empty table before the first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:  # noqa: BLE001 - only the missing path is expected
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


STORE_KEY = ["content_sha", "feature_set", "image_size"]


def feature_store_pass(
    work: DataFrame, path: str, extract: Callable[[DataFrame], DataFrame], schema: str
) -> DataFrame:
    """Extract what the store lacks, append it, and return the work rows with their features and hit/miss.

    The key is the content hash, the feature set and the image size, so copies of a
    file are extracted once. `extract` gets rows that are distinct in the key.
    """
    spark = work.sparkSession
    before = read_store(spark, path, schema)
    # what counts as stored is fixed before anything is appended
    known = before.select(*STORE_KEY).withColumn("_hit", F.lit(True))
    flagged = work.join(known, STORE_KEY, "left").withColumn(
        "cache", F.when(F.col("_hit"), "hit").otherwise("miss")
    ).drop("_hit")
    status = path + "-status"
    flagged.write.mode("overwrite").parquet(status)
    flagged = spark.read.parquet(status)
    new = flagged.where("cache = 'miss'").dropDuplicates(STORE_KEY).drop("cache")
    extract(new).select(*before.columns).write.mode("append").parquet(path)
    return flagged.join(spark.read.schema(schema).parquet(path), STORE_KEY)


def write_embeddings(df: DataFrame, path: str, ident: str, label: str, vector: str) -> None:
    """Id, label and the L2-normalised vector as floats."""
    rows = df.select(ident, label, F.transform(unit(F.col(vector)), lambda x: x.cast("float")).alias("embedding"))
    rows.write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
