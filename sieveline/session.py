"""Session helpers: local sessions for tests and bench, and reliable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "sieveline") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SIEVELINE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and continue from the files.

    The folder is the cluster's `spark.checkpoint.dir`; one is made here only
    for a local session that names none.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared_folder(spark, "checkpoint"))
    return df.checkpoint(eager=True)


def _shared_folder(spark: SparkSession, name: str) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return tempfile.mkdtemp(prefix=f"sieveline-{name}-")


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query go when it has run, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions; 200 where it is not a number."""
    value = spark.conf.get("spark.sql.shuffle.partitions", "200")
    return int(value) if value.isdigit() else 200


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name next to the checkpoints, on storage every executor reaches."""
    path = f"{_shared_folder(spark, 'scratch')}/{name}-{uuid.uuid4().hex}"
    for noted in _NOTED:
        noted.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared scratch folder: smaller than a checkpoint of the same rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_NOTED: list[list[str]] = []


@contextmanager
def passing_scratch(spark: SparkSession) -> Iterator[None]:
    """What is written to a `scratch_path` handed out within goes at the end; nothing may read it after."""
    _NOTED.append([])
    try:
        yield
    finally:
        for path in _NOTED.pop():
            delete_scratch(spark, path)


def delete_scratch(spark: SparkSession, path: str) -> None:
    """Delete a folder that `scratch_path` named, and the table of that name if there is one."""
    spark.sql(f"DROP TABLE IF EXISTS {path.rsplit('/', 1)[1].replace('-', '_')}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
