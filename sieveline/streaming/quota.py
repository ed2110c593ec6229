"""One pass over arriving files that keeps rows until quotas are full.

Each micro-batch takes its first rows in order, up to what is left of the quotas, with
the same distributed cut as the batch sample: no source is ranked in one task. What was
taken so far is read back from the output itself. A batch writes to a folder named
after its id, so a repeated batch replaces its own rows and nothing is taken twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.plans.ordered import take_first
from sieveline.session import cut_lineage

POLL_SECONDS = 1


@dataclass(frozen=True)
class Quotas:
    """Row limits; None means no limit."""

    real: int | None = None
    fake: int | None = None
    per_source: int | None = None
    wanted_sources: Sequence = ()


def taken(spark: SparkSession, out: str, schema, before: int | None = None) -> DataFrame:
    """Rows taken by earlier batches."""
    try:
        rows = spark.read.schema(f"{schema}, batch bigint").option("basePath", out).parquet(out)
    except Exception as error:  # noqa: BLE001 - only the missing path is expected
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], f"{schema}, batch bigint")
    return rows if before is None else rows.where(F.col("batch") < before)


def quota_batch(batch: DataFrame, so_far: DataFrame, quotas: Quotas, kind: str, source: str, order: str) -> DataFrame:
    """The rows of one batch that fit into what is left of the quotas."""
    number = F.col(order).cast("double")
    left = lambda cap, rows: F.lit(max(cap - rows.count(), 0))
    is_real = F.col(kind) == "real"
    real, fake = batch.where(is_real), batch.where(~is_real)
    if quotas.real is not None:
        real = take_first(real, [], order, order, left(quotas.real, so_far.where(is_real)), number)
    if quotas.per_source is not None:
        if quotas.wanted_sources:
            fake = fake.where(F.col(source).isin(*quotas.wanted_sources))
        counts = so_far.where(~is_real).groupBy(source).agg(F.count(F.lit(1)).alias("_n"))
        room = fake.select(source).distinct().join(counts, source, "left").select(
            source, F.greatest(F.lit(quotas.per_source) - F.coalesce("_n", F.lit(0)), F.lit(0)).alias("quota")
        )
        fake = take_first(fake, [source], order, order, room, number)
    if quotas.fake is not None:
        fake = take_first(fake, [], order, order, left(quotas.fake, so_far.where(~is_real)), number)
    return real.unionByName(fake)


def all_full(so_far: DataFrame, quotas: Quotas, kind: str, source: str) -> bool:
    """Whether no further row can be taken."""
    is_real = F.col(kind) == "real"
    wanted = list(quotas.wanted_sources)
    per_source = [F.count_if(~is_real & (F.col(source) == w)).alias(f"s{i}") for i, w in enumerate(wanted)]
    row = so_far.agg(F.count_if(is_real).alias("real"), F.count_if(~is_real).alias("fake"), *per_source).first()
    real_done = quotas.real is not None and row["real"] >= quotas.real
    if quotas.fake is not None and row["fake"] >= quotas.fake:
        return real_done
    if quotas.per_source is not None and wanted:
        return real_done and all(row[f"s{i}"] >= quotas.per_source for i in range(len(wanted)))
    return False


def quota_sample(
    stream: DataFrame, out: str, checkpoint: str, quotas: Quotas, kind: str, source: str, order: str
) -> DataFrame:
    """Run the stream until it has nothing more or every quota is full; returns the rows taken."""
    spark = stream.sparkSession
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields)
    full = {"yes": False}

    def step(batch: DataFrame, batch_id: int) -> None:
        if full["yes"]:
            return
        before = cut_lineage(taken(spark, out, schema, batch_id))
        rows = quota_batch(batch, before, quotas, kind, source, order)
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        full["yes"] = all_full(taken(spark, out, schema), quotas, kind, source)

    query = (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    while query.isActive and not full["yes"]:
        query.awaitTermination(POLL_SECONDS)
    if query.isActive:
        query.stop()
    if query.exception() is not None and not full["yes"]:
        raise query.exception()
    return taken(spark, out, schema).drop("batch")
