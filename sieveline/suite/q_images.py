"""Picture features over the embeddings read as small pictures, and tile geometry over the parts table."""

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sieveline.operators import images as im
from sieveline.sources.scans import resized_planes
from sieveline.suite.q_sources import unit_grid
from sieveline.suite.registry import case

W = H = 16


def planes(t):
    """Three 16x16 planes per embedding."""
    return resized_planes(unit_grid(t), 64, 8, W).select("path", "r", "g", "b")


def _family(key, name):
    case(key)(lambda t: im.FAMILIES[name](planes(t), W, H).drop("r", "g", "b"))


_family("q_F01_photometric_features", "photometric")
_family("q_F02_noise_features", "noise")
_family("q_F03_noise_v2_features", "noise_v2_extra")
_family("q_F04_noise_v3_features", "noise_v3_extra")
_family("q_F05_noise_v4_features", "noise_v4_extra")
_family("q_F07_reconstruction_lite", "reconstruction_lite")
_family("q_F08_reconstruction_v2", "reconstruction_v2_extra")


@case("q_F06_block_quantisation_residual")
def _(t):
    return im.quantisation_residual(planes(t), W, H).drop("r", "g", "b")


def png(pixels: np.ndarray) -> bytes:
    """An RGB PNG of (h, w, 3) bytes."""
    h, w, _ = pixels.shape
    raw = b"".join(b"\x00" + row.tobytes() for row in pixels)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def encoded(t):
    """The pictures as PNG files."""

    @F.pandas_udf("binary")
    def encode(r: pd.Series, g: pd.Series, b: pd.Series) -> pd.Series:
        files = []
        for picture in zip(r, g, b):
            rgb = np.stack([c.reshape(H, W) for c in picture], axis=2)
            files.append(png(np.floor(np.clip(rgb * 255, 0, 255)).astype(np.uint8)))
        return pd.Series(files)

    return planes(t).select("path", "r", "g", "b", encode("r", "g", "b").alias("content"))


@case("q_F09_file_signal_features")
def _(t):
    return im.file_signals(encoded(t).select("path", "content"))


@case("q_F10_feature_set")
def _(t):
    return im.feature_set(encoded(t), "combined_v5", W, H)


@case("q_F11_error_tolerant_extract")
def _(t):
    # pictures of odd classes lose their last pixels on the way
    rows = planes(t).join(t.embeddings.select(F.col("vec_id").cast("string").alias("path"), "label"), "path")
    cut = F.when(F.col("label") % 5 == 1, F.slice("g", 1, 100)).otherwise(F.col("g"))
    good, bad = im.extract_tolerant(rows.withColumn("g", cut).drop("label"), "photometric", W, H)
    return good.select("path", F.lit(None).cast("string").alias("error"), "gray_mean").unionByName(bad.withColumn("gray_mean", F.lit(None).cast("double")))


@case("q_F12_variant_fanout")
def _(t):
    out = im.variant_fanout(planes(t), W, H)
    average = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    return out.select("path", "variant", *[average(c).alias(f"{c}_mean") for c in "rgb"])


@case("q_F13_augmented_training_rows")
def _(t):
    part = F.when(F.substring(F.sha2("path", 256), 1, 1) < "4", "test").otherwise("train")
    out = im.augmented_rows(planes(t).withColumn("split", part), W, H, ["jpeg50", "blur1"])
    return out.groupBy("split", "variant").agg(F.count(F.lit(1)).alias("n"), F.avg(F.get("r", 0)).alias("corner"))


SIZED = "SELECT p_partkey, p_size * 20 AS w, CAST((p_partkey % 37 + 3) * 17 AS INTEGER) AS h FROM part"


def sized(t):
    return t.part.select("p_partkey", (F.col("p_size") * 20).alias("w"), ((F.col("p_partkey") % 37 + 3) * 17).cast("int").alias("h"))


@case(
    "q_F14_tile_fanout",
    f"""WITH s AS (SELECT *, least(224, w, h) AS side FROM ({SIZED}) x),
        p AS (SELECT *, list_sort(list_distinct([0, (h - side) // 2, h - side])) AS tops, list_sort(list_distinct([0, (w - side) // 2, w - side])) AS lefts FROM s),
        b AS (SELECT p_partkey, w, h, side, y, x FROM p, unnest(tops) a(y), unnest(lefts) c(x) WHERE greatest(w, h) > 224)
        SELECT p_partkey, w, h, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY y, x) - 1 AS INTEGER) AS tile, x AS "left", y AS top, x + side AS "right", y + side AS bottom FROM b
        UNION ALL SELECT p_partkey, w, h, 0, 0, 0, w, h FROM s WHERE greatest(w, h) <= 224""",
)
def _(t):
    return im.tile_boxes(sized(t), "w", "h", 224)


@case(
    "q_F15_grid_tiles",
    f"""SELECT p_partkey, w, h, r AS grid_row, c AS grid_column,
               CAST(greatest(0, round_even(c * (w / 3.0::DOUBLE) + -1 * (w / 3.0::DOUBLE) * 0.08::DOUBLE, 0)) AS INTEGER) AS "left",
               CAST(greatest(0, round_even(r * (h / 2.0::DOUBLE) + -1 * (h / 2.0::DOUBLE) * 0.08::DOUBLE, 0)) AS INTEGER) AS top,
               CAST(least(w, round_even((c + 1) * (w / 3.0::DOUBLE) + (w / 3.0::DOUBLE) * 0.08::DOUBLE, 0)) AS INTEGER) AS "right",
               CAST(least(h, round_even((r + 1) * (h / 2.0::DOUBLE) + (h / 2.0::DOUBLE) * 0.08::DOUBLE, 0)) AS INTEGER) AS bottom
        FROM ({SIZED}) x, (VALUES (0), (1)) a(r), (VALUES (0), (1), (2)) b(c)""",
)
def _(t):
    return im.grid_boxes(sized(t), "w", "h", 2, 3)


@case(
    "q_F16_tile_score_aggregate",
    """SELECT id, r9(s1) AS global_score, r9((s1 + s2 + s3) / 3) AS tile_mean, r9(greatest(s1, s2, s3)) AS tile_max,
              r9((s1 + s2 + s3 - least(s1, s2, s3)) / 2) AS tile_top2_mean,
              r9(sqrt((pow(s1 - (s1 + s2 + s3) / 3, 2) + pow(s2 - (s1 + s2 + s3) / 3, 2) + pow(s3 - (s1 + s2 + s3) / 3, 2)) / 3)) AS tile_std,
              r9(greatest(s1, s2, s3) - s1) AS tile_max_minus_global FROM predictions_wide""",
)
def _(t):
    rows = t.predictions.join(t.predictions_wide.select("id", F.col("s1").alias("whole")), "id")
    return im.tile_score_modes(rows, ["id"], "score", "whole")
