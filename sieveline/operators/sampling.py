"""Seeded splits and samples: any machine gets the same rows for the same seed.

Rows are ordered by sha256('seed:path'). Cuts go through `plans.ordered`, so no
label, stratum or group is ranked in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.scalar import competition_path, stable_hash
from sieveline.plans.guards import both_classes, guarded, unique_on
from sieveline.plans.ordered import hash_unit, mark_first, positions, take_first
from sieveline.session import cut_lineage


def share(fraction: float) -> Column:
    """round(group_size * fraction), half to even."""
    if not 0.0 < fraction < 1.0:
        raise ValueError("the fraction must be between 0 and 1")
    return F.rint(F.col("group_size") * F.lit(float(fraction))).cast("long")


def at_least_one(fraction: float) -> Column:
    return F.greatest(F.lit(1), share(fraction))


def inner_share(fraction: float) -> Column:
    """At least one row, and at least one left over."""
    return F.least(F.col("group_size") - 1, at_least_one(fraction))


def stratified_split(
    df: DataFrame, path: str, label: str, fraction: float, seeds: Sequence[int], tie: str
) -> DataFrame:
    """Per seed and label the first max(1, round(n f)) rows by hash are 'test', the rest 'train'."""
    rows = df.withColumn("split_seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    rows = rows.withColumn("_h", stable_hash(path, F.col("split_seed")))
    out = mark_first(rows, ["split_seed", label], "_h", tie, at_least_one(fraction))
    return out.withColumn("split", F.when(F.col("chosen"), "test").otherwise("train")).drop("chosen", "_h")


def strata_split(df: DataFrame, ident: str, strata: Sequence[str], fraction: float, seed: int) -> DataFrame:
    """Validation share inside every stratum; a stratum of one row stays in training."""
    rows = guarded(df, [unique_on(df, ident)]).withColumn("_h", stable_hash(ident, seed))
    out = mark_first(rows, strata, "_h", ident, inner_share(fraction))
    return out.withColumn("split", F.when(F.col("chosen"), "val").otherwise("train")).drop("chosen", "_h")


def leave_one_group_out(df: DataFrame, group: str, held_out, label: str = "label") -> DataFrame:
    """Split column for one held-out group; both parts need both labels."""
    rows = df.withColumn("split", F.when(F.col(group).eqNullSafe(F.lit(held_out)), "val").otherwise("train"))
    parts = [rows.where(F.col("split") == s) for s in ("val", "train")]
    return guarded(rows, [both_classes(p, label) for p in parts])


def leave_one_group_out_folds(df: DataFrame, group: str, label: str = "label") -> DataFrame:
    """All folds at once: a fold trains on everything but its group, so its counts are totals minus its own."""
    own = df.groupBy(group).agg(
        F.count_if(F.col(label) == 0).alias("val_real"), F.count_if(F.col(label) == 1).alias("val_fake")
    )
    whole = df.agg(
        F.struct(F.count_if(F.col(label) == 0).alias("real"), F.count_if(F.col(label) == 1).alias("fake")).alias("t")
    ).scalar()
    return own.withColumn("_t", whole).select(
        group,
        "val_real",
        "val_fake",
        (F.col("_t.real") - F.col("val_real")).alias("train_real"),
        (F.col("_t.fake") - F.col("val_fake")).alias("train_fake"),
    ).withColumn(
        "usable",
        (F.col("val_real") > 0) & (F.col("val_fake") > 0) & (F.col("train_real") > 0) & (F.col("train_fake") > 0),
    )


def _even_part(df: DataFrame, groups: Sequence[str], limit: int) -> DataFrame:
    """Quota table: max(1, limit // number of groups) for every group."""
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    each = sizes.agg(F.greatest(F.lit(1), F.floor(F.lit(limit) / F.count(F.lit(1)))).alias("q")).scalar()
    return sizes.select(*groups).withColumn("quota", each)


def _topped_up(flagged: DataFrame, limit: int, order: str, tie: str) -> DataFrame:
    """Chosen rows plus the first of the others, up to `limit` in total."""
    # read by the count, the chosen part and every pass of the second cut
    flagged = cut_lineage(flagged)
    taken = flagged.where("chosen").drop("chosen")
    missing = taken.agg((F.lit(limit) - F.count(F.lit(1))).alias("m")).scalar()
    rest = flagged.where(~F.col("chosen")).drop("chosen").withColumn("_missing", missing)
    more = take_first(rest.drop("_missing"), [], order, tie, F.greatest(missing, F.lit(0)))
    return taken.unionByName(more)


def balanced_limit(df: DataFrame, path: str, label: str, limit: int, seed: int, tie: str) -> DataFrame:
    """Equal share per label by hash, topped up from the rest in the order of seed + 17."""
    rows = df.withColumn("_h", stable_hash(path, seed)).withColumn("_h2", stable_hash(path, seed + 17))
    flagged = mark_first(rows, [label], "_h", tie, _even_part(df, [label], limit))
    return _topped_up(flagged, limit, "_h2", tie).drop("_h", "_h2")


def group_head_limit(df: DataFrame, ident: str, groups: Sequence[str], limit: int, seed: int) -> DataFrame:
    """Equal head of every group by hash, then the first of the remainder up to the limit."""
    rows = df.withColumn("_h", stable_hash(ident, seed))
    flagged = mark_first(rows, groups, "_h", ident, _even_part(df, groups, limit))
    return _topped_up(flagged, limit, "_h", ident).drop("_h")


def round_robin_limit(df: DataFrame, ident: str, groups: Sequence[str], limit: int, seed: int) -> DataFrame:
    """Cycle through the groups in key order, one row of each per round, until `limit` rows.

    The number of full rounds follows from the group sizes alone, so no row is
    ranked against another group's rows.
    """
    groups = list(groups)
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    by_size = Window.orderBy("n", *groups)
    filled = sizes.select(
        *groups,
        "n",
        (F.row_number().over(by_size) - 1).alias("_i"),
        F.coalesce(F.sum("n").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_used"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("_groups"),
    )
    left = F.col("_groups") - F.col("_i")
    rounds = F.floor((F.lit(limit) - F.col("_used")) / left)
    level = filled.where(rounds <= F.col("n")).agg(
        F.min(
            F.struct("_i", rounds.alias("rounds"), (F.lit(limit) - F.col("_used") - left * rounds).alias("extra"))
        ).alias("l")
    ).select(F.coalesce("l.rounds", F.lit(limit)).alias("rounds"), F.coalesce("l.extra", F.lit(0)).alias("extra"))
    known = sizes.withColumn("_l", level.select(F.struct("*")).scalar())
    longer = F.when(F.col("n") > F.col("_l.rounds"), 1).otherwise(0)
    turn = F.sum(longer).over(Window.orderBy(*groups).rowsBetween(Window.unboundedPreceding, 0))
    quotas = known.select(
        *groups,
        (
            F.least(F.col("n"), F.col("_l.rounds"))
            + F.when((longer == 1) & (turn <= F.col("_l.extra")), 1).otherwise(0)
        ).alias("quota"),
    )
    rows = df.withColumn("_h", stable_hash(ident, seed))
    return take_first(rows, groups, "_h", ident, quotas).drop("_h")


def hash_head(df: DataFrame, ident: str, limit: int, seed: int) -> DataFrame:
    """First `limit` rows by hash."""
    rows = df.withColumn("_h", stable_hash(ident, seed))
    return take_first(rows, [], "_h", ident, F.lit(limit)).drop("_h")


def key_holdout(keys: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Held-out share of the unique keys: at least one, and one left over; a single key is held out."""
    unique = keys.select(key).distinct().withColumn("_h", stable_hash(key, seed))
    quota = F.when(F.col("group_size") <= 1, F.col("group_size")).otherwise(inner_share(fraction))
    return take_first(unique, [], "_h", key, quota).drop("_h")


def calibration_split(df: DataFrame, path: str, label: str, fraction: float, seed: int, tie: str) -> DataFrame:
    """'calibration' or 'fit' per row; every class keeps rows on both sides."""
    rows = guarded(df, [both_classes(df, label)]).withColumn("_h", stable_hash(path, seed))
    quota = F.when(F.col("group_size") >= 2, inner_share(fraction)).otherwise(
        F.raise_error(F.lit("each class needs at least two rows")).cast("long")
    )
    out = mark_first(rows, [label], "_h", tie, quota)
    return out.withColumn("split", F.when(F.col("chosen"), "calibration").otherwise("fit")).drop("chosen", "_h")


def source_capped_sample(
    df: DataFrame,
    kind: str,
    source: str,
    order: str,
    real_cap: int | None = None,
    fake_cap: int | None = None,
    source_cap: int | None = None,
    wanted_sources: Sequence[str] = (),
) -> DataFrame:
    """First rows in `order` (a unique number): reals up to their cap, fakes up to the per-source and the total cap."""
    number = F.col(order).cast("double")
    real = df.where(F.col(kind) == "real")
    if real_cap is not None:
        real = take_first(real, [], order, order, F.lit(real_cap), number)
    fake = df.where(F.col(kind) != "real")
    if source_cap is not None:
        if wanted_sources:
            fake = fake.where(F.col(source).isin(*wanted_sources))
        fake = take_first(fake, [source], order, order, F.lit(source_cap), number)
    if fake_cap is not None:
        fake = take_first(fake, [], order, order, F.lit(fake_cap), number)
    return real.unionByName(fake)


def download_plan(df: DataFrame, value: str, seed: int, split: str | None = None) -> DataFrame:
    """Unique archive paths with their place in the hash order."""
    paths = df.select(competition_path(value, split).alias("path")).distinct()
    placed = positions(paths.withColumn("_h", stable_hash("path", seed)), [], "_h", "path", "place")
    return placed.drop("_h")


POISSON_STEPS = 18
"""Up to a mean of 1, the Poisson distribution function is 1 to the last bit of a double after so many steps."""


def inverse_frequency_resample(df: DataFrame, ident: str, groups: Sequence[str], seed: int) -> DataFrame:
    """Draw as many rows as there are, with replacement, every group equally likely.

    A row's number of copies is Poisson with mean n / (groups * group size), however
    large: it is cut into parts with a mean of at most 1, and each part draws with
    its own hash. There is no shared generator, so any task order gives the same
    rows. `part` and `copy` tell the copies of a row apart.
    """
    groups = list(groups)
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_size"))
    totals = sizes.agg((F.sum("_size") / F.count(F.lit(1))).alias("share")).scalar()
    tables = sizes.withColumn("_mean", totals / F.col("_size")).withColumn("_parts", F.ceil("_mean").cast("long"))
    rate = F.col("_mean") / F.col("_parts")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc, i):
        p = acc["p"] * rate / i
        return F.struct(p.alias("p"), F.array_append(acc["cdf"], F.element_at(acc["cdf"], -1) + p).alias("cdf"))

    steps = F.sequence(F.lit(1), F.lit(POISSON_STEPS - 1))
    tables = tables.select(*groups, "_parts", F.aggregate(steps, start, step)["cdf"].alias("_cdf"))
    # parts in two steps, so that no row holds all of them at once
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_parts") - 1) / 1024).cast("long")))
    rows = df.join(tables, groups).withColumn("_block", blocks)
    first = F.col("_block") * 1024
    parts = F.explode(F.sequence(first, F.least(first + 1023, F.col("_parts") - 1)))
    rows = rows.withColumn("part", parts)
    u = hash_unit(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("part"), F.col(ident)), 256))
    rows = rows.withColumn("_u", u).withColumn("_copies", F.size(F.filter("_cdf", lambda c: c <= F.col("_u"))))
    drawn = rows.where(F.col("_copies") > 0)
    return drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop(
        "_cdf", "_u", "_copies", "_parts", "_block"
    )


def stratified_kfold(df: DataFrame, ident: str, label: str, folds: int, seed: int) -> DataFrame:
    """Fold number per row: place by hash inside its label, modulo the number of folds."""
    rows = df.withColumn("_h", stable_hash(ident, seed))
    placed = positions(rows, [label], "_h", ident, "_place")
    return placed.withColumn("fold", F.pmod(F.col("_place") - 1, F.lit(folds)).cast("int")).drop("_place", "_h")
