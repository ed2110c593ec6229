"""Readers: files, pictures, predictions, metadata, run metrics, catalogs and inventories."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline import schemas
from sieveline.functions.scalar import (
    IMAGE_SUFFIXES,
    competition_path,
    default_image_path,
    file_stem,
    path_key,
    seed_from_path,
    source_key,
    source_name,
)
from sieveline.plans.guards import by_key, guarded, holding, no_nulls, not_empty, unique_on
from sieveline.plans.ordered import positions


def file_scan(spark: SparkSession, root: str, suffixes: Sequence[str] = IMAGE_SUFFIXES, content: bool = False) -> DataFrame:
    """Files below a folder with one of the suffixes, any case. Content is read only when asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    pattern = "(?i)(" + "|".join(s.replace(".", "[.]") for s in suffixes) + ")$"
    columns = ["path", "length", "modificationTime", *(["content"] if content else [])]
    return files.where(F.col("path").rlike(pattern)).select(*columns)


def resize_matrix(old: int, new: int, kernel: str = "bilinear") -> np.ndarray:
    """One-dimensional resampling weights (new x old): the kernel widens when shrinking."""
    support, weight = {
        "bilinear": (1.0, lambda x: np.maximum(1.0 - np.abs(x), 0.0)),
        "bicubic": (
            2.0,
            lambda x: np.where(
                np.abs(x) < 1.0,
                1.5 * np.abs(x) ** 3 - 2.5 * np.abs(x) ** 2 + 1.0,
                np.where(np.abs(x) < 2.0, -0.5 * np.abs(x) ** 3 + 2.5 * np.abs(x) ** 2 - 4.0 * np.abs(x) + 2.0, 0.0),
            ),
        ),
        "lanczos": (3.0, lambda x: np.where(np.abs(x) < 3.0, np.sinc(x) * np.sinc(x / 3.0), 0.0)),
    }[kernel]
    scale = old / new
    stretch = max(scale, 1.0)
    centre = (np.arange(new) + 0.5) * scale
    offset = (np.arange(old) + 0.5)[None, :] - centre[:, None]
    table = np.where(np.abs(offset) < support * stretch, weight(offset / stretch), 0.0)
    return table / table.sum(axis=1, keepdims=True)


def resize(pixels: np.ndarray, height: int, width: int, kernel: str = "bilinear") -> np.ndarray:
    """Separable resize of pictures shaped (..., h, w)."""
    rows = resize_matrix(pixels.shape[-2], height, kernel)
    cols = resize_matrix(pixels.shape[-1], width, kernel)
    return rows @ pixels @ cols.T


SLICE_PIXELS = 1 << 16
"""Pixels of a plane resized at once; a single larger picture is a slice of its own."""
PICTURE = "path string, height int, width int, r array<double>, g array<double>, b array<double>"


def decoded_images(spark: SparkSession, root: str, image_size: int) -> DataFrame:
    """Pictures as three planes in [0, 1] of image_size x image_size; files the decoder refuses are dropped rows with an error.

    Decoding is Spark's `image` source; only the resize runs in Python, batch by batch.
    """
    raw = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(root)
    rows = raw.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, h, w, n, data in batch.itertuples(index=False):
                grid = np.frombuffer(data, dtype=np.uint8).reshape(h, w, n).astype(np.float64) / 255.0
                bgr = np.repeat(grid, 3, axis=2) if n == 1 else grid[:, :, :3]
                planes = resize(np.moveaxis(bgr[:, :, ::-1], 2, 0), image_size, image_size)
                out.append((path, image_size, image_size, *[p.ravel() for p in planes]))
            yield pd.DataFrame(out, columns=["path", "height", "width", "r", "g", "b"])

    return rows.mapInPandas(convert, PICTURE)


def resized_planes(df: DataFrame, size: int, width: int, image_size: int, kernel: str = "bilinear") -> DataFrame:
    """Resize planes that are already pixels: `path, r, g, b` of `size` values, `width` per row."""

    step = max(1, SLICE_PIXELS // max(size, image_size * image_size))

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.iloc[at : at + step]
                planes = {
                    c: list(
                        resize(
                            np.stack(part[c].to_numpy()).reshape(-1, size // width, width), image_size, image_size, kernel
                        ).reshape(len(part), -1)
                    )
                    for c in ("r", "g", "b")
                }
                yield pd.DataFrame({"path": part["path"], "height": image_size, "width": image_size, **planes})

    return df.select("path", "r", "g", "b").mapInPandas(convert, PICTURE)


def need_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def prediction_scan(spark: SparkSession, paths: str | Sequence[str], method: str | None = None) -> DataFrame:
    """Prediction CSVs with a declared schema; the header names decide, a missing column fails."""
    raw = spark.read.option("header", "true").csv(paths)
    need_columns(raw, ["path", "y_true", "fake_score"])
    return typed_predictions(raw.withColumn("file", F.col("_metadata.file_path")), method)


def typed_predictions(raw: DataFrame, method: str | None = None) -> DataFrame:
    """Text columns to the prediction schema; a value that does not parse fails the job."""
    need_columns(raw, ["path", "y_true", "fake_score"])
    strict = lambda c, kind: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"missing {c}")).cast(kind)).otherwise(
        F.col(c).cast(kind)
    )
    out = raw.select(
        "path",
        path_key("path").alias("path_key"),
        strict("y_true", "int").alias("y_true"),
        strict("fake_score", "double").alias("score"),
        *[F.col(c) for c in raw.columns if c not in ("path", "y_true", "fake_score")],
    )
    return out if method is None else out.withColumn("method", F.lit(method))


def renames(columns: Sequence[str], wanted: dict[str, tuple[Sequence[str], str | None]]) -> dict[str, str]:
    """Which column takes which standard name: for each, the asked-for column or the first of its aliases in the table."""
    present = set(columns)
    found = {name: [c for c in ([asked] if asked else aliases) if c in present] for name, (aliases, asked) in wanted.items()}
    missing = {name: wanted[name] for name, here in found.items() if not here}
    if missing:
        said = "; ".join(f"{name}: {asked or ' or '.join(aliases)}" for name, (aliases, asked) in missing.items())
        raise ValueError(f"the table lacks columns ({said}); it has {', '.join(columns)}")
    return {here[0]: name for name, here in found.items()}


def detect_column(columns: Sequence[str], candidates: Sequence[str], kind: str, requested: str | None = None) -> str:
    """The column that stands for one kind of value."""
    return next(iter(renames(columns, {kind: (candidates, requested)})))


def with_detected(df: DataFrame, id_column: str | None = None, score_column: str | None = None) -> DataFrame:
    """Rename the detected id and score columns to `image_id` and `score`."""
    wanted = {"image_id": (schemas.ID_COLUMNS, id_column), "score": (schemas.SCORE_COLUMNS, score_column)}
    return df.withColumnsRenamed(renames(df.columns, wanted))


def metadata_of_split(df: DataFrame, split: str) -> DataFrame:
    """Metadata rows of one split with key and source name; none is an error."""
    need_columns(df, ["path", "split", "label", "source_label"])
    rows = df.where(F.col("split") == split)
    out = rows.withColumns(
        {
            "path_key": path_key("path"),
            "source_key": source_key("source_label"),
            "source_name": source_name("source_label"),
        }
    )
    found = df.agg(F.count_if(F.col("split") == split).alias("n")).scalar()
    present = F.assert_true(found > 0, F.lit(f"no metadata rows for split {split}")).isNull()
    return out.where(present)


def metadata_scan(spark: SparkSession, paths: str | Sequence[str], split: str) -> DataFrame:
    return metadata_of_split(spark.read.option("header", "true").schema(schemas.METADATA).csv(paths), split)


def run_metrics(texts: DataFrame) -> DataFrame:
    """Rows `path, text` of metrics files to typed columns; seed and run come from the path."""
    clean = F.translate("path", "\\", "/")
    return texts.select(
        "path",
        seed_from_path("path").alias("seed"),
        F.regexp_extract(clean, "([^/]+)/[^/]+$", 1).alias("run"),
        F.from_json("text", schemas.RUN_METRICS).alias("m"),
    ).select("path", "seed", "run", "m.*")


def run_metrics_scan(spark: SparkSession, glob: str) -> DataFrame:
    """Every metrics.json below a glob, one row per file."""
    text = spark.read.option("wholetext", "true").text(glob)
    return run_metrics(text.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def dataset_catalog(texts: DataFrame, text: str = "text") -> DataFrame:
    """A JSON object keyed by dataset, as one row per dataset."""
    entries = F.from_json(text, f"map<string, {schemas.CATALOG_ENTRY}>")
    rows = texts.select(F.explode(entries).alias("key", "e")).select("key", "e.*")
    return rows.withColumn("notes", F.coalesce("notes", F.lit("")))


def local_inventory(reference: DataFrame, files: DataFrame, ident: str = "id") -> DataFrame:
    """Reference rows that have a file, by file stem; a stem that occurs twice fails."""
    local = files.select(file_stem("path").alias(ident), F.col("path").alias("local_path"), F.col("length").alias("size_bytes"))
    sides = by_key(reference, ident, "_row", "_n").join(by_key(local, ident, "_file", "_files"), ident, "full_outer")
    once = lambda c: F.coalesce(F.col(c), F.lit(1)) == 1
    sound = holding(sides, (once("_n") & once("_files"), f"duplicate keys on {ident}"))
    found = sound.where(F.col("_n").isNotNull() & F.col("_files").isNotNull())
    joined = found.select(
        ident, *[f"_row.{c}" for c in reference.columns if c != ident], *[f"_file.{c}" for c in local.columns if c != ident]
    )
    checked = guarded(joined, [not_empty(joined, "no file matches the reference")])
    return checked.withColumn("competition_path", competition_path("image_path"))


def inventory_report(reference: DataFrame, files: DataFrame, ident: str = "id") -> DataFrame:
    """Counts on both sides of the inventory and the sizes of the matched files."""
    from sieveline.operators.runstats import exact_quantiles

    stems = files.select(file_stem("path").alias(ident), F.col("length").alias("size_bytes"))
    sides = reference.select(ident, F.lit(1).alias("_r")).join(
        stems.withColumn("_l", F.lit(1)), ident, "full_outer"
    )
    matched = F.col("_r").isNotNull() & F.col("_l").isNotNull()
    middle = exact_quantiles(sides.where(matched), [], [0.5], "size_bytes").select(F.col("value").cast("double").alias("v"))
    return sides.agg(
        F.count("_r").alias("n_reference_rows"),
        F.count("_l").alias("n_local_images"),
        F.count_if(matched).alias("n_matched_rows"),
        F.count_if(F.col("_r").isNull()).alias("n_unmatched_local_images"),
        F.count_if(F.col("_l").isNull()).alias("n_missing_reference_images"),
        F.min(F.when(matched, F.col("size_bytes"))).alias("size_min"),
        F.max(F.when(matched, F.col("size_bytes"))).alias("size_max"),
    ).withColumn("size_median", middle.scalar())


def manifest_rows(manifest: DataFrame, labels: DataFrame, statuses: Sequence[str]) -> DataFrame:
    """Labels of the manifest rows with a wanted status, with their manifest position.

    `manifest` has (position, status, competition_path). Repeated and unknown ids fail.
    """
    wanted = manifest.where(
        F.col("status").isin(*statuses) & (F.coalesce("competition_path", F.lit("")) != "")
    ).select("position", file_stem("competition_path").alias("id"))
    joined = wanted.join(labels.withColumn("_known", F.lit(True)), "id", "left")
    checks = [
        not_empty(wanted, "no manifest rows of the wanted statuses"),
        unique_on(wanted, "id"),
        unique_on(labels, "id"),
        no_nulls(joined, "_known"),
    ]
    return guarded(joined, checks).drop("_known")


def manifest_entries(texts: DataFrame, text: str = "text") -> DataFrame:
    """`rows` of a JSON manifest document as `position, status, competition_path`."""
    schema = "struct<rows: array<struct<status: string, competition_path: string>>>"
    return texts.select(F.posexplode(F.from_json(text, schema)["rows"]).alias("position", "r")).select("position", "r.*")


def manifest_sizes(df: DataFrame, manifest: DataFrame, local: DataFrame, name: str = "name") -> DataFrame:
    """File size from the manifest, else from local disk; a row with neither fails."""
    listed = manifest.select(name, F.col("size").alias("_listed"))
    disk = local.select(name, F.col("size").alias("_disk"))
    joined = df
    for source, column in ((listed, "_listed"), (disk, "_disk")):
        joined = joined.join(by_key(source, name, "_row", "_n"), name, "left")
        joined = holding(joined, (F.coalesce("_n", F.lit(1)) == 1, f"duplicate keys on {name}"))
        joined = joined.withColumn(column, F.col(f"_row.{column}")).drop("_row", "_n")
    joined = joined.withColumn("size", F.coalesce("_listed", "_disk"))
    return holding(joined, (F.col("size").isNotNull(), "missing values in size")).withColumn(
        "size_source", F.when(F.col("_listed").isNotNull(), "manifest").otherwise("disk")
    ).drop("_listed", "_disk")


def restore_paths(predictions: DataFrame, paths: DataFrame, order: str, path_order: str) -> DataFrame:
    """Attach paths to predictions by row number when both have the same number of rows.

    Spark rows have no order of their own: both sides name a numeric order column.
    """
    if order not in predictions.columns or path_order not in paths.columns:
        raise ValueError("positional matching needs an order column on both sides")
    left = positions(predictions, [], order, order, "_at", F.col(order).cast("double"))
    right = positions(paths, [], path_order, path_order, "_at", F.col(path_order).cast("double")).select("_at", "path")
    rows = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    same = (predictions, F.count(F.lit(1)) == rows(paths), "row counts differ: paths cannot be restored by position")
    return guarded(left, [same]).join(right, "_at").drop("_at")


def with_default_path(df: DataFrame, ident: str = "id") -> DataFrame:
    present: Column | None = F.col("image_path") if "image_path" in df.columns else None
    return df.withColumn("image_path", default_image_path(ident, present))
