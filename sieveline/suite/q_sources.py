"""Scans, sources and sinks. File round trips go through a fresh folder next to the checkpoints."""

import struct

from pyspark.sql import functions as F

from sieveline import schemas
from sieveline.functions.scalar import file_name, file_stem
from sieveline.operators import metrics as m, neighbours
from sieveline.session import scratch_path
from sieveline.sources import scans, sinks
from sieveline.suite.registry import SHARED, case


@case("q_S01_image_file_scan")
def _(t):
    # the given tables' own files; pictures differ only in the suffix list
    files = scans.file_scan(t.spark, t.sf_dir, (".parquet",))
    return files.select(file_stem("path").alias("name"), "length")


def unit_grid(t):
    """An 8x8 embedding as three planes in [0, 1]: grey, mirrored, turned upside down."""
    low, high = F.array_min("embedding").cast("double"), F.array_max("embedding").cast("double")
    flat = F.transform("embedding", lambda x: (x.cast("double") - low) / (high - low))
    rows = t.embeddings.select(F.col("vec_id").cast("string").alias("path"), flat.alias("r"))
    mirrored = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("r", i - F.pmod(i, F.lit(8)) + 7 - F.pmod(i, F.lit(8))))
    return rows.select("path", "r", mirrored.alias("g"), F.reverse("r").alias("b"))


def bitmap_bytes(side):
    """An uncompressed 24-bit bitmap of `side` x `side` from the planes r, g, b in [0, 1]: header, then rows from the bottom up."""
    size = 3 * side * side
    header = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + size, 0, 0, 54, 40, side, side, 1, 24, 0, size, 2835, 2835, 0, 0)
    byte = lambda c, i: F.lpad(F.hex(F.floor(F.get(c, i) * 255 + 0.5).cast("long")), 2, "0")
    row = lambda j: F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda i: F.concat(*[byte(c, j * side + i) for c in "bgr"]))
    text = F.array_join(F.flatten(F.transform(F.sequence(F.lit(side - 1), F.lit(0), F.lit(-1)), row)), "")
    return F.concat(F.lit(header), F.unhex(text))


_BYTE = "list_transform(embedding, lambda x: floor((x::DOUBLE - lo) / (hi - lo) * 255 + 0.5) / 255)"


@case(
    "q_S02_decoded_image_scan",
    f"""SELECT CAST(vec_id AS VARCHAR) || '.bmp' AS name, 16 AS height, 16 AS width, 256 AS n_pixels,
               r9(list_sum(p) / 64) AS r_mean, r9(list_sum(p) / 64) AS g_mean, r9(list_sum(p) / 64) AS b_mean,
               r9(p[1]) AS r_first, r9(p[8]) AS g_first, r9(p[64]) AS b_first
        FROM (SELECT vec_id, {_BYTE} AS p FROM (SELECT vec_id, embedding, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings) e) x""",
)
def _(t):
    folder = scratch_path(t.spark, "pictures")
    named = unit_grid(t).select(F.concat("path", F.lit(".bmp")).alias("name"), bitmap_bytes(8).alias("content"))
    sinks.write_files(named, folder, "name", "content")
    out = scans.decoded_images(t.spark, folder, 16)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
    return out.select(
        file_name("path").alias("name"),
        "height",
        "width",
        F.size("r").alias("n_pixels"),
        *[total(c).alias(f"{c}_mean") for c in ("r", "g", "b")],
        *[F.get(c, 0).alias(f"{c}_first") for c in ("r", "g", "b")],
    )


@case("q_S02_resized_planes")
def _(t):
    out = scans.resized_planes(unit_grid(t), 64, 8, 16)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
    return out.select("path", "height", "width", *[total(c).alias(f"{c}_mean") for c in ("r", "g", "b")], F.size("r").alias("n_pixels"))


@case(
    "q_S03_prediction_scan",
    "SELECT path, lower(path) AS path_key, y_true, r9(s1) AS score, 'alpha' AS method FROM predictions_wide",
)
def _(t):
    folder = scratch_path(t.spark, "predictions")
    t.predictions_wide.select("path", "y_true", F.col("s1").alias("fake_score")).write.option("header", "true").csv(folder)
    return scans.prediction_scan(t.spark, folder, "alpha").drop("file")


@case("q_S04_detect_column", "SELECT id AS image_id, r9(s1) AS score, type FROM predictions_wide")
def _(t):
    return scans.with_detected(t.predictions_wide.select("id", F.col("s1").alias("prob_fake"), "type"))


@case(
    "q_S05_metadata_scan",
    """SELECT path, lower(path) AS path_key, CAST(source_label AS VARCHAR) AS source_key,
              ['real', 'sd21', 'sdxl', 'sd3', 'dalle3', 'midjourney6'][source_label + 1] AS source_name
       FROM predictions_wide WHERE type <> 'view'""",
)
def _(t):
    split = F.when(F.col("type") == "view", "train").otherwise("test")
    rows = t.predictions_wide.select("path", split.alias("split"), F.col("y_true").alias("label"), "source_label")
    return scans.metadata_of_split(rows, "test").select("path", "path_key", "source_key", "source_name")


@case(
    "q_S06_run_metrics_scan",
    """SELECT seed, method AS run, method, r9(accuracy) AS accuracy, r9(roc_auc) AS roc_auc, n_samples FROM runs""",
)
def _(t):
    runs = m.binary_metrics(t.predictions, ["method", "seed"])
    text = F.to_json(F.struct("method", "accuracy", "roc_auc", "n_samples"))
    name = F.concat_ws("/", F.concat(F.lit("seed"), F.col("seed")), "method", F.lit("metrics.json"))
    folder = scratch_path(t.spark, "runs")
    sinks.write_files(runs.select(name.alias("name"), text.alias("text")), folder, "name", "text")
    out = scans.run_metrics_scan(t.spark, f"{folder}/*/*/metrics.json")
    return out.select("seed", "run", "method", "accuracy", "roc_auc", "n_samples")


@case(
    "q_S07_dataset_catalog",
    """SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS title, 'region ' || n_regionkey AS source, lower(n_name) AS ref, NULL AS updated,
              CAST(n_nationkey * 10 AS INTEGER) AS size_mb, '' AS notes FROM nation""",
)
def _(t):
    entry = F.struct(
        F.col("n_name").alias("title"),
        F.concat(F.lit("region "), "n_regionkey").alias("source"),
        F.lower("n_name").alias("ref"),
        (F.col("n_nationkey") * 10).cast("int").alias("size_mb"),
    )
    text = t.nation.agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), entry)))).alias("text")
    )
    return scans.dataset_catalog(text).drop("local_dir")


def reference_and_files(t):
    reference = t.documents.where("lang <> 'fr'").select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("train/"), "doc_id", F.lit(".jpeg")).alias("image_path")
    )
    files = t.documents.where("n_chars > 200").select(
        F.concat(F.lit("/data/train/"), "doc_id", F.lit(".jpeg")).alias("path"), F.col("n_chars").alias("length")
    )
    return reference, files


@case(
    "q_S08_local_inventory_join",
    """SELECT CAST(doc_id AS VARCHAR) AS id, 'train/' || doc_id || '.jpeg' AS image_path, '/data/train/' || doc_id || '.jpeg' AS local_path, n_chars AS size_bytes,
              'train/train/' || doc_id || '.jpeg' AS competition_path FROM documents WHERE lang <> 'fr' AND n_chars > 200""",
)
def _(t):
    return scans.local_inventory(*reference_and_files(t))


@case(
    "q_S08_local_inventory_report",
    """SELECT count(*) FILTER (r) AS n_reference_rows, count(*) FILTER (f) AS n_local_images, count(*) FILTER (r AND f) AS n_matched_rows, count(*) FILTER (f AND NOT r) AS n_unmatched_local_images,
              count(*) FILTER (r AND NOT f) AS n_missing_reference_images, min(n_chars) FILTER (r AND f) AS size_min, max(n_chars) FILTER (r AND f) AS size_max,
              r9(quantile_cont(n_chars::DOUBLE, 0.5) FILTER (r AND f)) AS size_median
       FROM (SELECT *, lang <> 'fr' AS r, n_chars > 200 AS f FROM documents) x""",
)
def _(t):
    return scans.inventory_report(*reference_and_files(t))


@case(
    "q_S09_manifest_materialize",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderkey AS INTEGER) AS position, CAST(o_custkey % 2 AS INTEGER) AS label, o_orderpriority AS type
       FROM orders WHERE o_orderstatus IN ('F', 'P')""",
)
def _(t):
    # one JSON document per block of orders, as a downloader would leave them
    entry = F.struct(
        F.col("o_orderstatus").alias("status"), F.concat(F.lit("train/train/"), "o_orderkey", F.lit(".jpeg")).alias("competition_path")
    )
    texts = t.orders.select("o_orderkey", F.to_json(F.struct(F.array(entry).alias("rows"))).alias("text"))
    entries = texts.select(
        F.col("o_orderkey").cast("int").alias("position"),
        F.explode(F.from_json("text", "rows array<struct<status: string, competition_path: string>>")["rows"]).alias("r"),
    ).select("position", "r.*")
    labels = t.orders.select(
        F.col("o_orderkey").cast("string").alias("id"), (F.col("o_custkey") % 2).cast("int").alias("label"), F.col("o_orderpriority").alias("type")
    )
    return scans.manifest_rows(entries, labels, ["F", "P"])


@case(
    "q_S10_manifest_size_lookup",
    """SELECT CAST(d.doc_id AS VARCHAR) AS name, CASE WHEN l.doc_id IS NOT NULL THEN n_chars * 2 ELSE n_chars END AS size,
              CASE WHEN l.doc_id IS NOT NULL THEN 'manifest' ELSE 'disk' END AS size_source
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(t):
    rows = t.documents.select(F.col("doc_id").cast("string").alias("name"))
    listed = t.documents.join(t.labels, "doc_id", "left_semi").select(
        F.col("doc_id").cast("string").alias("name"), (F.col("n_chars") * 2).alias("size")
    )
    disk = t.documents.select(F.col("doc_id").cast("string").alias("name"), F.col("n_chars").alias("size"))
    return scans.manifest_sizes(rows, listed, disk)


@case(
    "q_S11_positional_path_restore",
    "SELECT id, y_true, r9(s1) AS score, path FROM predictions_wide",
)
def _(t):
    w = t.predictions_wide
    bare = w.select("id", "y_true", F.col("s1").alias("score"))
    return scans.restore_paths(bare, w.select(F.col("id").alias("row_no"), "path"), "id", "row_no")


@case(
    "q_S12_prediction_sink",
    "SELECT variant, CAST(id AS VARCHAR) AS path, y_true, r9(score) AS fake_score, r9(score * score) AS raw_fake_score FROM variants",
)
def _(t):
    folder = scratch_path(t.spark, "variants")
    rows = t.variants.select(
        "variant", F.col("id").cast("string").alias("path"), "y_true", F.col("score").alias("fake_score"), (F.col("score") * F.col("score")).alias("raw_fake_score")
    )
    sinks.write_predictions(rows, folder)
    return t.spark.read.parquet(folder)


@case(
    "q_S13_manifest_sink",
    "SELECT count(*) AS n_rows, r9(min(s1)) AS score_min, r9(max(s1)) AS score_max, 'submission' AS kind FROM predictions_wide",
)
def _(t):
    folder = scratch_path(t.spark, "manifest")
    one = t.predictions_wide.agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("s1").alias("score_min"), F.max("s1").alias("score_max"), F.lit("submission").alias("kind")
    )
    sinks.write_manifest(one, folder)
    return t.spark.read.schema("kind string, n_rows bigint, score_max double, score_min double").json(folder)


STORE = "content_sha string, feature_set string, image_size int, n_chars bigint, n_words bigint"


@case(
    "q_S14_feature_store",
    """SELECT doc_id, CASE WHEN sha256(text) IN (SELECT sha256(text) FROM documents WHERE lang = 'en') THEN 'hit' ELSE 'miss' END AS cache, n_chars,
              len(string_split(text, ' ')) AS n_words FROM documents""",
)
def _(t):
    folder = scratch_path(t.spark, "features")
    work = t.documents.select(
        "doc_id", "lang", "text", F.sha2("text", 256).alias("content_sha"), F.lit("words").alias("feature_set"), F.lit(0).alias("image_size")
    )

    def extract(rows):
        return rows.withColumn("n_chars", F.length("text").cast("long")).withColumn(
            "n_words", F.size(F.split("text", " ")).cast("long")
        )

    sinks.feature_store_pass(work.where("lang = 'en'"), folder, extract, STORE)
    done = sinks.feature_store_pass(work, folder, extract, STORE)
    return done.select("doc_id", "cache", "n_chars", "n_words")


@case(
    "q_S15_embedding_sink_scan",
    """SELECT vec_id, label, len(v) AS n, round(list_sum(v), 5) + 0.0 AS total, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) + 0.0 AS length
       FROM (SELECT vec_id, e.label, v FROM unit_vectors JOIN embeddings e USING (vec_id)) x""",
)
def _(t):
    folder = scratch_path(t.spark, "embeddings")
    sinks.write_embeddings(t.embeddings, folder, "vec_id", "label", "embedding")
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"))
    back = sinks.read_embeddings(t.spark, folder)
    squares = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    return back.select(
        "vec_id", "label", F.size("embedding").alias("n"), F.round(add("embedding"), 5).alias("total"), F.round(F.sqrt(add(squares)), 5).alias("length")
    )
