"""Hamming join by pigeonhole bands.

Two 64-bit values within distance d agree on at least one of d+1 bands. With two
hashes per row a candidate must agree on a band of each, so a bucket is keyed by
about 64/(d1+1) + 64/(d2+1) bits. A bucket that is still large is split again by
bands of the bits its key does not use, where the same argument holds; recall stays exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_BUCKET = 2048


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def band_masks(distance: int, bits: int = 64, within: int = (1 << 64) - 1) -> list[int]:
    """distance+1 masks that share out the `bits` low positions of `within` evenly."""
    places = [i for i in range(bits) if within >> i & 1]
    parts = distance + 1
    cut = [len(places) * i // parts for i in range(parts + 1)]
    return [sum(1 << p for p in places[cut[i] : cut[i + 1]]) for i in range(parts)]


def _agreeing(masks: list[int], diff: Column) -> Column:
    """Index of the first band on which two values agree, given their xor."""
    out = F.lit(None).cast("int")
    for i, mask in reversed(list(enumerate(masks))):
        out = F.when(diff.bitwiseAND(F.lit(_signed(mask))) == 0, F.lit(i)).otherwise(out)
    return out


def hamming_pairs(
    prints: DataFrame,
    first: str,
    second: str,
    first_distance: int,
    second_distance: int,
    hot: int = HOT_BUCKET,
) -> DataFrame:
    """Pairs of distinct rows `(first, second)` within both distances, the smaller pair on the left.

    `prints` holds distinct pairs of 64-bit hashes. Every pair comes out once: it is
    kept only in the bucket of the first bands it agrees on.
    """
    m1, m2 = band_masks(first_distance), band_masks(second_distance)
    band = lambda name, mask, i: F.struct(
        F.lit(i).alias("i"), F.col(name).bitwiseAND(F.lit(_signed(mask))).alias("v")
    )
    keyed = (
        prints.select(F.col(first).alias("a"), F.col(second).alias("b"))
        .withColumn("ka", F.explode(F.array(*[band("a", m, i) for i, m in enumerate(m1)])))
        .withColumn("kb", F.explode(F.array(*[band("b", m, i) for i, m in enumerate(m2)])))
        .select("a", "b", F.col("ka.i").alias("i"), F.col("ka.v").alias("va"), F.col("kb.i").alias("j"), F.col("kb.v").alias("vb"))
    )
    bucket = ["i", "va", "j", "vb"]
    sizes = keyed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"))
    sized = keyed.join(sizes.where(F.col("n") > 1), bucket)
    cold = _compare(sized.where(F.col("n") <= hot), bucket, first_distance, second_distance)
    cold = cold.where(
        (_agreeing(m1, F.col("xa")) == F.col("i")) & (_agreeing(m2, F.col("xb")) == F.col("j"))
    )
    # bands over the bits a bucket's own key leaves free
    every = (1 << 64) - 1
    free1 = [band_masks(first_distance, within=every & ~m) for m in m1]
    free2 = [band_masks(second_distance, within=every & ~m) for m in m2]

    def finer(name, index, table, width):
        rows = [
            F.when(F.col(index) == i, F.array(*[band(name, m, k) for k, m in enumerate(masks)]))
            for i, masks in enumerate(table)
        ]
        return F.explode(F.coalesce(*rows))

    warm = (
        sized.where(F.col("n") > hot)
        .withColumn("ka", finer("a", "i", free1, first_distance + 1))
        .withColumn("kb", finer("b", "j", free2, second_distance + 1))
        .select("a", "b", *bucket, F.col("ka.i").alias("k"), F.col("ka.v").alias("wa"), F.col("kb.i").alias("l"), F.col("kb.v").alias("wb"))
    )
    pairs = _compare(warm, [*bucket, "k", "wa", "l", "wb"], first_distance, second_distance)
    inner = lambda index, table, diff: F.coalesce(
        *[F.when(F.col(index) == i, _agreeing(masks, F.col(diff))) for i, masks in enumerate(table)]
    )
    pairs = pairs.where(
        (_agreeing(m1, F.col("xa")) == F.col("i"))
        & (_agreeing(m2, F.col("xb")) == F.col("j"))
        & (inner("i", free1, "xa") == F.col("k"))
        & (inner("j", free2, "xb") == F.col("l"))
    )
    out = ["left_first", "left_second", "right_first", "right_second", "first_distance", "second_distance"]
    return cold.select(*out).unionByName(pairs.select(*out))


def _compare(rows: DataFrame, bucket: list[str], d1: int, d2: int) -> DataFrame:
    left = rows.select(*bucket, F.col("a").alias("left_first"), F.col("b").alias("left_second"))
    right = rows.select(*bucket, F.col("a").alias("right_first"), F.col("b").alias("right_second"))
    xa = F.col("left_first").bitwiseXOR(F.col("right_first"))
    xb = F.col("left_second").bitwiseXOR(F.col("right_second"))
    return (
        left.join(right, bucket)
        .where(F.struct("left_first", "left_second") < F.struct("right_first", "right_second"))
        .withColumns({"xa": xa, "xb": xb})
        .withColumns({"first_distance": F.bit_count("xa"), "second_distance": F.bit_count("xb")})
        .where((F.col("first_distance") <= d1) & (F.col("second_distance") <= d2))
    )
