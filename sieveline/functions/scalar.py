"""Row-level rules as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Class-name tokens and image suffixes that decide labels.
FAKE_TOKENS = (
    "ai",
    "ai_generated",
    "artificial",
    "diffusion",
    "fake",
    "gan",
    "generated",
    "machine",
    "machine_generated",
    "synthetic",
)
REAL_TOKENS = (
    "authentic",
    "human",
    "human_generated",
    "natural",
    "photo",
    "photograph",
    "real",
)
HUMAN_TOKENS = ("human", "human_generated")
HUMAN_OVERRIDES = ("ai", "artificial", "fake", "machine", "synthetic")
IMAGE_SUFFIXES = (".bmp", ".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp")
SOURCE_NAMES = {
    "0": "real",
    "1": "sd21",
    "2": "sdxl",
    "3": "sd3",
    "4": "dalle3",
    "5": "midjourney6",
}
COMPETITION_SPLITS = ("train", "public_test")
TRAIN_NAMES = ("train", "training")
TEST_NAMES = ("test", "testing", "val", "valid", "validation")
SCORE_EPS = 1e-6
LOGIT_LIMIT = 60.0
# end of fixed values


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _words(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def class_kind(name: Column | str) -> Column:
    """'real', 'fake' or null from the words of a folder name; a human word wins unless an AI word is there."""
    plain = F.regexp_replace(F.lower(_col(name)), "[- ]", "_")
    tokens = F.concat(F.split(plain, "_"), F.array(plain))
    has = lambda words: F.arrays_overlap(tokens, _words(words))
    return (
        F.when(has(HUMAN_TOKENS) & ~has(HUMAN_OVERRIDES), "real")
        .when(has(FAKE_TOKENS), "fake")
        .when(has(REAL_TOKENS), "real")
    )


def path_key(path: Column | str) -> Column:
    return F.lower(F.translate(_col(path), "\\", "/"))


def file_key(path: Column | str) -> Column:
    return F.lower(file_name(path))


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(F.translate(_col(path), "\\", "/"), "/"), -1)


def file_stem(path: Column | str) -> Column:
    """File name without its last suffix; leading and trailing dots are no suffix."""
    return F.regexp_replace(file_name(path), "(?<=.)[.][^.]+$", "")


def competition_path(value: Column | str, split: str | None = None) -> Column:
    """`id` or `split/id.ext` to `split/split/name.ext`; empty values and unknown splits fail."""
    if split is not None and split not in COMPETITION_SPLITS:
        raise ValueError(f"unknown split: {split}")
    raw = F.trim(F.translate(_col(value).cast("string"), "\\", "/"))
    name = file_name(raw)
    full = F.when(F.instr(name, ".") > 0, name).otherwise(F.concat(name, F.lit(".jpeg")))
    first = F.element_at(F.split(raw, "/"), 1)
    part = F.lit(split) if split else F.when(first.isin(*COMPETITION_SPLITS), first).otherwise("public_test")
    return F.when(raw == "", F.raise_error(F.lit("image path or id is empty"))).otherwise(
        F.concat_ws("/", part, part, full)
    )


def image_id(value: Column | str, mode: str = "stem") -> Column:
    if mode not in ("path", "name", "stem"):
        raise ValueError(f"unknown id mode: {mode}")
    text = _col(value).cast("string")
    return {"path": text, "name": file_name(text), "stem": file_stem(text)}[mode]


def path_category(path: Column | str) -> Column:
    """Content category of the first `ai_*` or `real_*` folder, else 'unknown'."""
    parts = F.filter(F.split(path_key(path), "/"), lambda p: p.rlike("^(ai|real)_"))
    category = F.regexp_extract(F.get(parts, 0), "^(?:ai|real)_(.*)$", 1)
    return F.when(F.size(parts) == 0, "unknown").when(category == "humans", "human").otherwise(category)


def source_key(label: Column | str) -> Column:
    text = _col(label).cast("string")
    return F.coalesce(F.regexp_replace(text, r"\.0$", ""), F.lit("missing"))


def source_name(label: Column | str, names: dict[str, str] = SOURCE_NAMES) -> Column:
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    key = source_key(label)
    return F.coalesce(F.element_at(known, key), F.concat(F.lit("source_"), key))


def seed_from_path(path: Column | str) -> Column:
    digits = F.regexp_extract(F.translate(_col(path), "\\", "/"), "(?:^|/)seed([0-9]+)(?:/|$)", 1)
    return F.when(digits == "", F.raise_error(F.lit("no seed folder in the path"))).otherwise(digits.cast("int"))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def logit(score: Column) -> Column:
    p = clip(score.cast("double"), SCORE_EPS, 1.0 - SCORE_EPS)
    return F.ln(p / (1.0 - p))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(x, -LOGIT_LIMIT, LOGIT_LIMIT)))


def triage_decision(score: Column, low: Column | float, high: Column | float) -> Column:
    return F.when(score <= low, "likely_real").when(score >= high, "likely_fake").otherwise("uncertain")


def submission_columns(
    score: Column, threshold: float = 0.5, low: float = 0.2, high: float = 0.8, digits: int = 6
) -> dict[str, Column]:
    """Packaged columns of a scored row; rounding is half to even."""
    if low >= high:
        raise ValueError("the real threshold must be below the fake threshold")
    even = lambda c: half_even(c, digits)
    called = score >= threshold
    return {
        "fake_score": even(score),
        "predicted_label": called.cast("int"),
        "predicted_label_name": F.when(called, "fake").otherwise("real"),
        "confidence": even(F.abs(score - 0.5) * 2.0),
        "triage_decision": triage_decision(score, low, high),
    }


def half_even(value: Column, digits: int) -> Column:
    """Round the way numpy does: scale, round the double half to even, scale back."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def hex_number(text: Column) -> Column:
    """Unsigned value of a hex text as a double."""
    return F.conv(text, 16, 10).cast("decimal(20,0)").cast("double")


def id_hex_features(ident: Column | str) -> dict[str, Column]:
    """Four 8-digit chunks over 0xFFFFFFFF, first and last byte over 255; short pieces count as 0."""
    text = _col(ident).cast("string")

    def piece(start: int, width: int) -> Column:
        part = F.substring(text, start, width)
        return F.when(F.length(part) == width, hex_number(part)).otherwise(0.0)

    out = {f"id_hex_{i}": piece(1 + 8 * i, 8) / F.lit(float(0xFFFFFFFF)) for i in range(4)}
    out["id_first_byte"] = piece(1, 2) / 255.0
    out["id_last_byte"] = (
        F.when(F.length(text) >= 2, hex_number(F.substring(text, -2, 2))).otherwise(0.0) / 255.0
    )
    return out


def stable_hash(value: Column | str, seed: int | Column) -> Column:
    """First 16 hex digits of sha256('seed:value'), lower case with forward slashes; text order is number order."""
    prefix = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    text = F.lower(F.translate(_col(value).cast("string"), "\\", "/"))
    return F.substring(F.sha2(F.concat(prefix, F.lit(":"), text), 256), 1, 16)


def with_size_features(df: DataFrame, ident: str, size: str, seed: int, train: DataFrame | None = None) -> DataFrame:
    """File-size features; missing sizes take the training median, the log is centred on this frame's mean."""
    from sieveline.operators.runstats import exact_quantiles

    base = (df if train is None else train).where(F.col(size).isNotNull())
    median = exact_quantiles(base, [], [0.5], size).select(F.col("value").cast("double").alias("m")).scalar()
    raw = F.col(size).cast("double")
    filled = df.withColumn("_fill", median).withColumn(
        "_size",
        F.coalesce(raw, F.col("_fill"), F.raise_error(F.lit("no finite file size"))).cast("double"),
    )
    mean_log = filled.agg(F.avg(F.log1p("_size")).alias("m")).scalar()
    s = F.col("_size")
    whole = s.cast("long")
    return (
        filled.withColumn("_mean", mean_log)
        .withColumns(
            {
                "size_filled": s,
                "log_size": F.log1p(s),
                "sqrt_size": F.sqrt(s),
                "size_kb": s / 1024.0,
                "size_mod_997": F.pmod(whole, F.lit(997)) / 997.0,
                "size_mod_4096": F.pmod(whole, F.lit(4096)) / 4096.0,
                "has_released_size": raw.isNotNull().cast("double"),
                "path_score_seed": hex_number(stable_hash(ident, seed)),
                "path_score_seed_alt": hex_number(stable_hash(ident, seed + 1009)),
                "log_size_centered": F.log1p(s) - F.col("_mean"),
                "log_size_abs_centered": F.abs(F.log1p(s) - F.col("_mean")),
            }
        )
        .drop("_fill", "_size", "_mean")
    )


def stress_tier(delta_accuracy: Column, delta_auc: Column) -> Column:
    worst = F.least(delta_accuracy, delta_auc)
    return (
        F.when(worst <= -0.045, "major_drop")
        .when(worst <= -0.02, "moderate_drop")
        .when((delta_accuracy >= 0.005) & (delta_auc >= 0.005), "apparent_gain")
        .otherwise("stable_or_mild")
    )


# Family name -> substrings, in order of precedence.
METHOD_FAMILIES = (
    ("score/source fusion", ("fusion", "source-", "source ")),
    ("frozen foundation", ("clip", "dinov2", "convnext")),
    ("physics-guided neural", ("physics-guided",)),
    ("task-trained neural", ("resnet",)),
    ("physical/signal conventional", ("combined_v",)),
)


def method_family(method: Column | str, families=METHOD_FAMILIES) -> Column:
    text = F.lower(_col(method).cast("string"))
    out = None
    for family, parts in families:
        hit = F.lit(False)
        for part in parts:
            hit = hit | text.contains(part)
        out = F.when(hit, family) if out is None else out.when(hit, family)
    return out.otherwise("other")


def float_token(value: float) -> str:
    return f"{value:g}".replace("-", "m").replace(".", "p")


def policy_label(cap: float | None, fd: float, rc: float, rfp: float, fmp: float) -> str:
    start = "uncapped" if cap is None else f"cap{float_token(cap)}"
    return f"{start}_fd{float_token(fd)}_rc{float_token(rc)}_rfp{float_token(rfp)}_fmp{float_token(fmp)}"


def score_validity(df: DataFrame, score: str = "score", label: str | None = "y_true") -> DataFrame:
    """One row of counts of rows no metric may be computed on, plus `valid`."""
    s = F.col(score).cast("double")
    off = F.isnan(s) | (F.abs(s) == float("inf"))
    counts = {
        "n_rows": F.count(F.lit(1)),
        "n_missing": F.count_if(s.isNull()),
        "n_not_finite": F.count_if(off),
        "n_out_of_range": F.count_if(~off & ((s < 0.0) | (s > 1.0))),
    }
    if label is not None:
        counts["n_bad_label"] = F.count_if(F.col(label).isNull() | ~F.col(label).isin(0, 1))
    out = df.agg(*[c.alias(n) for n, c in counts.items()])
    clean = F.col("n_rows") > 0
    for name in list(counts)[1:]:
        clean = clean & (F.col(name) == 0)
    return out.withColumn("valid", clean)


def canonical_label(value: Column | str, real: Sequence[str], fake: Sequence[str]) -> Column:
    """'real' or 'ai_generated'; overlapping sets and unknown values fail."""
    both = sorted(set(real) & set(fake))
    if both:
        raise ValueError(f"labels cannot be both real and fake: {both}")
    text = _col(value).cast("string")
    return (
        F.when(text.isin(*real), "real")
        .when(text.isin(*fake), "ai_generated")
        .otherwise(F.raise_error(F.concat(F.lit("unknown label value: "), F.coalesce(text, F.lit("null")))))
    )


def split_name_score(name: Column | str, wanted: Sequence[str]) -> Column:
    text = F.lower(_col(name))
    part = F.lit(False)
    for w in wanted:
        part = part | text.contains(w)
    return F.when(text.isin(*wanted), 3).when(part, 2).otherwise(0)


def slug(value: Column | str) -> Column:
    """Lower case, runs of other than letters and digits as one underscore, none at the ends; 'image' when empty."""
    text = F.regexp_replace(F.lower(F.trim(_col(value).cast("string"))), r"[^\p{L}\p{N}]+", "_")
    text = F.regexp_replace(text, "^_+|_+$", "")
    return F.when(text == "", "image").otherwise(text)


def default_image_path(ident: Column | str, path: Column | str | None = None) -> Column:
    made = F.concat(F.lit("public_test/"), _col(ident).cast("string"), F.lit(".jpeg"))
    return made if path is None else F.coalesce(_col(path), made)


def resize_feature_family(name: Column) -> Column:
    return (
        F.when(name.startswith("recon_half_quarter"), "cross_scale_delta")
        .when(name.startswith("recon_half"), "half_scale_resize_residual")
        .when(name.startswith("recon_quarter"), "quarter_scale_resize_residual")
        .otherwise(F.raise_error(F.concat(F.lit("unexpected feature name: "), name)))
    )


def reconstruction_feature_family(name: Column) -> Column:
    single = ~name.contains("delta") & ~name.contains("ratio")
    return (
        F.when(name.startswith("recon_half") | name.startswith("recon_quarter"), "resize_residual")
        .when(name.startswith("recon_fft") & single, "fft_lowpass_residual")
        .when(name.startswith("recon_svd") & single, "svd_lowrank_residual")
        .otherwise("cross_reconstructor_delta")
    )


# Name ending -> statistic text, in order of precedence.
FEATURE_STATISTICS = (
    ("_abs_mean", "mean absolute RGB residual"),
    ("_abs_p95", "95th percentile absolute RGB residual"),
    ("_luma_chroma_ratio", "luma-to-chroma residual ratio"),
    ("_laplacian_abs_mean", "mean absolute Laplacian of the residual map"),
    ("_tile16_std_mean", "mean 16x16 tile residual standard deviation"),
    ("_tile16_std_p90", "90th percentile 16x16 tile residual standard deviation"),
    ("_delta", "cross-reconstruction delta"),
    ("_ratio", "cross-reconstruction ratio"),
)


def feature_description(name: Column) -> Column:
    """What a reconstruction feature measures, from its ending and its family."""
    statistic = None
    for ending, text in FEATURE_STATISTICS:
        hit = name.endswith(ending)
        statistic = F.when(hit, text) if statistic is None else statistic.when(hit, text)
    statistic = statistic.otherwise("reconstruction residual statistic")
    family = F.translate(reconstruction_feature_family(name), "_", " ")
    return F.concat(statistic, F.lit(" for the "), family, F.lit(" branch."))
