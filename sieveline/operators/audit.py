"""Corpus audit: layout, labels, exact and near duplicates, leakage between splits and classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.scalar import TEST_NAMES, TRAIN_NAMES, class_kind, file_name, path_key, split_name_score
from sieveline.plans.banded import hamming_pairs
from sieveline.session import cut_lineage


def layout_candidates(files: DataFrame, path: str, max_depth: int = 4) -> DataFrame:
    """Folders that hold both a real and a fake class folder with files below, with their split-name scores."""
    parts = F.split(F.translate(F.col(path), "\\", "/"), "/")
    depth = F.size("_p") - 2
    folders = files.select(parts.alias("_p")).where(depth >= 0)
    pairs = folders.select(
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.least(depth, F.lit(max_depth))),
                lambda i: F.struct(
                    F.array_join(F.slice("_p", 1, i), "/").alias("folder"),
                    F.get("_p", i).alias("child"),
                    i.alias("depth"),
                ),
            )
        ).alias("x")
    ).select("x.*").where(F.col("child") != "")
    kinds = pairs.groupBy("folder", "depth", "child").agg(F.count(F.lit(1)).alias("n_files"))
    kinds = kinds.withColumn("kind", class_kind("child"))
    both = kinds.groupBy("folder", "depth").agg(
        F.max((F.col("kind") == "fake").cast("int")).alias("_f"),
        F.max((F.col("kind") == "real").cast("int")).alias("_r"),
        F.sum(F.when(F.col("kind").isNotNull(), F.col("n_files")).otherwise(0)).alias("n_files"),
    )
    name = file_name("folder")
    return both.where((F.col("_f") == 1) & (F.col("_r") == 1)).select(
        "folder",
        "depth",
        "n_files",
        split_name_score(name, TRAIN_NAMES).alias("train_score"),
        split_name_score(name, TEST_NAMES).alias("test_score"),
    )


def discover_layout(files: DataFrame, path: str, max_depth: int = 4) -> DataFrame:
    """`(role, folder)`: the best train and test folders when both exist and differ, else the shallowest one."""
    found = layout_candidates(files, path, max_depth)
    best = lambda score: F.min(
        F.when(
            F.col(score) > 0,
            F.struct((-F.col(score)).alias("s"), "depth", "folder"),
        )
    )["folder"]
    chosen = found.agg(
        best("train_score").alias("train"),
        best("test_score").alias("test"),
        F.min(F.struct("depth", "folder"))["folder"].alias("single"),
    )
    fixed = F.col("train").isNotNull() & F.col("test").isNotNull() & (F.col("train") != F.col("test"))
    role = lambda r, c: F.struct(F.lit(r).alias("role"), F.col(c).alias("folder"))
    none = F.col("single").isNull()
    roles = (
        F.when(none, F.raise_error(F.lit("no folder holds both real and fake classes")))
        .when(fixed, F.array(role("train", "train"), role("test", "test")))
        .otherwise(F.array(role("single", "single")))
    )
    return chosen.select(F.explode(roles).alias("r")).select("r.*")


def labelled_records(files: DataFrame, path: str, layout: DataFrame) -> DataFrame:
    """Files below a class folder of the layout: `path, label (fake = 1), class_name, role`."""
    roles = layout.agg(F.collect_list(F.struct("role", "folder")).alias("roles")).scalar()
    clean = F.translate(F.col(path), "\\", "/")
    rows = files.withColumn("_path", clean).withColumn("_r", F.explode(roles))
    root = F.when(F.col("_r.folder") == "", F.lit("")).otherwise(F.concat("_r.folder", F.lit("/")))
    inside = rows.where(F.startswith(F.col("_path"), root)).withColumn(
        "class_name", F.get(F.split(F.substr("_path", F.length(root) + 1), "/"), 0)
    )
    kind = class_kind("class_name")
    return inside.where(kind.isNotNull() & (F.length("_path") > F.length(root) + F.length("class_name"))).select(
        F.col("_path").alias("path"), (kind == "fake").cast("int").alias("label"), "class_name", F.col("_r.role").alias("role")
    )


def content_hash(content: Column | str) -> Column:
    return F.sha2(F.col(content) if isinstance(content, str) else content, 256)


def _bits(flags: Column) -> Column:
    """Boolean array, first flag highest, as one 64-bit value."""
    return F.aggregate(
        flags,
        F.lit(0).cast("long"),
        lambda acc, bit: F.shiftleft(acc, 1).bitwiseOR(F.when(bit, 1).otherwise(0).cast("long")),
    )


def average_hash(pixels: Column) -> Column:
    """Bit per pixel: not darker than the mean. Up to 64 grey pixels, row by row."""
    values = F.transform(pixels, lambda x: x.cast("double"))
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)
    return _bits(F.transform(values, lambda x: x >= mean))


def difference_hash(pixels: Column, width: int) -> Column:
    """Bit per horizontal neighbour pair: left brighter than right."""
    places = F.filter(
        F.sequence(F.lit(0), F.size(pixels) - 2), lambda i: F.pmod(i, F.lit(width)) != width - 1
    )
    return _bits(F.transform(places, lambda i: F.get(pixels, i) > F.get(pixels, i + 1)))


def hash_text(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def exact_duplicate_groups(df: DataFrame, digest: str, split: str, cls: str) -> DataFrame:
    """Groups of equal content with their size and the splits and classes they span; members are `duplicate_members`."""
    cells = df.groupBy(digest, split, cls).agg(F.count(F.lit(1)).alias("n"))
    groups = cells.groupBy(digest).agg(
        F.sum("n").alias("n_images"),
        F.sort_array(F.collect_set(split)).alias("splits"),
        F.sort_array(F.collect_set(cls)).alias("classes"),
    )
    return groups.where(F.col("n_images") > 1).select(
        F.col(digest).alias("sha256"),
        "n_images",
        "splits",
        "classes",
        (F.size("splits") > 1).alias("cross_split"),
        (F.size("classes") > 1).alias("cross_class"),
    )


def duplicate_members(df: DataFrame, digest: str, columns: Sequence[str]) -> DataFrame:
    """Every file that shares its content with another one, one row each."""
    repeated = df.groupBy(digest).agg(F.count(F.lit(1)).alias("n_images")).where(F.col("n_images") > 1)
    return df.select(digest, *columns).join(repeated, digest)


def _counts(cells: DataFrame, column: str) -> DataFrame:
    """Per fingerprint: rows per value of `column`, as a map (splits and classes are few)."""
    per = cells.groupBy("a", "d", column).agg(F.sum("n").alias("n"))
    return per.groupBy("a", "d").agg(
        F.map_from_entries(F.collect_list(F.struct(column, "n"))).alias(f"{column}_n")
    )


def near_duplicate_pairs(
    df: DataFrame, max_average: int = 4, max_difference: int = 4
) -> DataFrame:
    """Pairs of near-equal pictures, counted per pair of fingerprints.

    `df` has `path, split, class_name, digest, a, d` (average and difference hash).
    Copies are counted first: files of one content or of one fingerprint stand for
    each other, so a large group of copies costs one row, and the number of file
    pairs follows by arithmetic. Files of equal content are no near pair.
    """
    cells = df.groupBy("a", "d", "split", "class_name", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path")
    )
    cells = cut_lineage(cells)

    def squares(*by: str) -> DataFrame:
        """Sum of squared group sizes per fingerprint, tagged with what was grouped by."""
        groups = cells.groupBy("a", "d", *by).agg(F.sum("n").alias("n"))
        return groups.groupBy("a", "d").agg(F.sum(F.col("n") * F.col("n")).alias("sq")).withColumn("by", F.lit("_".join(by)))

    prints = cells.groupBy("a", "d").agg(
        F.sum("n").alias("n"), F.min("first_path").alias("first_path"), F.max("first_path").alias("other_path")
    )
    prints = cut_lineage(
        prints.join(_counts(cells, "split"), ["a", "d"]).join(_counts(cells, "class_name"), ["a", "d"])
    )
    kinds = [("digest",), ("split",), ("class_name",), ("digest", "split"), ("digest", "class_name")]
    long = squares(*kinds[0])
    for kind in kinds[1:]:
        long = long.unionByName(squares(*kind))
    pick = lambda kind: F.max(F.when(F.col("by") == "_".join(kind), F.col("sq"))).alias("_sq_" + "_".join(kind))
    inner = prints.where(F.col("n") > 1).join(long.groupBy("a", "d").agg(*[pick(k) for k in kinds]), ["a", "d"])
    n2 = F.col("n") * F.col("n")
    half = lambda c: F.floor(c / 2).cast("long")
    same = inner.select(
        F.col("a").alias("left_average"),
        F.col("d").alias("left_difference"),
        F.col("a").alias("right_average"),
        F.col("d").alias("right_difference"),
        F.lit(0).alias("average_distance"),
        F.lit(0).alias("difference_distance"),
        half(n2 - F.col("_sq_digest")).alias("n_pairs"),
        half(n2 - F.col("_sq_split") - F.col("_sq_digest") + F.col("_sq_digest_split")).alias("n_cross_split"),
        half(n2 - F.col("_sq_class_name") - F.col("_sq_digest") + F.col("_sq_digest_class_name")).alias(
            "n_cross_class"
        ),
        F.col("first_path").alias("left_path"),
        F.col("other_path").alias("right_path"),
    ).where(F.col("n_pairs") > 0)

    near = hamming_pairs(prints.select("a", "d"), "a", "d", max_average, max_difference)
    side = lambda tag: prints.select(
        F.col("a").alias(f"{tag}_first"),
        F.col("d").alias(f"{tag}_second"),
        F.col("n").alias(f"{tag}_n"),
        F.col("split_n").alias(f"{tag}_split"),
        F.col("class_name_n").alias(f"{tag}_class"),
        F.col("first_path").alias(f"{tag}_path"),
    )
    both = near.join(side("left"), ["left_first", "left_second"]).join(side("right"), ["right_first", "right_second"])

    def shared(what: str) -> Column:
        left, right = F.col(f"left_{what}"), F.col(f"right_{what}")
        return F.aggregate(
            F.map_keys(left),
            F.lit(0).cast("long"),
            lambda acc, k: acc + F.element_at(left, k) * F.coalesce(F.element_at(right, k), F.lit(0)),
        )

    total = F.col("left_n") * F.col("right_n")
    apart = both.select(
        F.col("left_first").alias("left_average"),
        F.col("left_second").alias("left_difference"),
        F.col("right_first").alias("right_average"),
        F.col("right_second").alias("right_difference"),
        F.col("first_distance").alias("average_distance"),
        F.col("second_distance").alias("difference_distance"),
        total.alias("n_pairs"),
        (total - shared("split")).alias("n_cross_split"),
        (total - shared("class")).alias("n_cross_class"),
        "left_path",
        "right_path",
    )
    return same.unionByName(apart)


def near_duplicate_examples(pairs: DataFrame, top: int = 20) -> DataFrame:
    """The report's first pairs: across splits first, then the closest."""
    return pairs.orderBy(
        F.col("n_cross_split") == 0, "average_distance", "difference_distance", "left_path", "right_path"
    ).limit(top)


def class_counts(df: DataFrame, split: str, cls: str, label: str) -> DataFrame:
    return df.groupBy(split, cls, label).agg(F.count(F.lit(1)).alias("n_images"))


def size_profile(df: DataFrame, width: str, height: str, top: int = 10) -> DataFrame:
    """The most frequent dimensions, with the overall limits on every row."""
    sizes = df.groupBy(width, height).agg(F.count(F.lit(1)).alias("n_images"))
    limits = sizes.agg(
        F.struct(
            F.min(width).alias("width_min"),
            F.max(width).alias("width_max"),
            F.min(height).alias("height_min"),
            F.max(height).alias("height_max"),
        ).alias("l")
    ).scalar()
    most = sizes.orderBy(F.desc("n_images"), width, height).limit(top)
    return most.withColumn("_l", limits).select(width, height, "n_images", "_l.*")


def audit_summary(df: DataFrame, groups: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row of audit counts from the corpus, its duplicate groups and its near pairs."""
    total = df.agg(F.count(F.lit(1)).alias("n_images"), F.count_distinct("digest").alias("n_unique_sha256"))
    exact = groups.agg(
        F.struct(
            F.count(F.lit(1)).alias("n_duplicate_groups"),
            F.coalesce(F.sum("n_images"), F.lit(0)).alias("n_duplicate_images"),
            F.count_if("cross_split").alias("n_cross_split_duplicate_groups"),
            F.count_if("cross_class").alias("n_cross_class_duplicate_groups"),
        ).alias("x")
    ).scalar()
    out = total.withColumn("_x", exact).select("n_images", "n_unique_sha256", "_x.*")
    if pairs is None:
        return out
    near = pairs.agg(
        F.struct(
            F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_near_duplicate_pairs"),
            F.coalesce(F.sum("n_cross_split"), F.lit(0)).alias("n_cross_split_near_duplicate_pairs"),
            F.coalesce(F.sum("n_cross_class"), F.lit(0)).alias("n_cross_class_near_duplicate_pairs"),
        ).alias("x")
    ).scalar()
    return out.withColumn("_n", near).select(*out.columns, "_n.*")


# Gate name -> (summary column, wording of the reason).
LEAK_GATES = {
    "cross_split_duplicates": ("n_cross_split_duplicate_groups", "cross-split exact duplicate groups"),
    "cross_split_near_duplicates": ("n_cross_split_near_duplicate_pairs", "cross-split near-duplicate pairs"),
    "cross_class_duplicates": ("n_cross_class_duplicate_groups", "cross-class exact duplicate groups"),
    "cross_class_near_duplicates": ("n_cross_class_near_duplicate_pairs", "cross-class near-duplicate pairs"),
}


def leakage_reasons(summary: DataFrame, gates: Sequence[str] = tuple(LEAK_GATES)) -> DataFrame:
    """One row per leak of the chosen kinds: gate, count and reason. No rows means the gate is open."""
    unknown = set(gates) - set(LEAK_GATES)
    if unknown:
        raise ValueError(f"unknown gates: {sorted(unknown)}")
    found = []
    for place, name in enumerate(g for g in LEAK_GATES if g in gates):
        column, wording = LEAK_GATES[name]
        n = F.col(column) if column in summary.columns else F.lit(0).cast("long")
        found.append(
            F.struct(
                F.lit(place).alias("place"),
                F.lit(name).alias("gate"),
                n.cast("long").alias("n"),
                F.concat(n.cast("string"), F.lit(" " + wording)).alias("reason"),
            )
        )
    rows = summary.select(F.explode(F.filter(F.array(*found), lambda g: g["n"] > 0)).alias("g"))
    return rows.select("g.*")
