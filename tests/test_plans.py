"""Ordered plans, bands and block joins against brute force, with hot groups."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.functions.scalar import stable_hash
from sieveline.operators import neighbours as nb
from sieveline.operators import sampling
from sieveline.plans import banded, ordered


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_running_sums(spark):
    rng = np.random.default_rng(1)
    # a third of the values lie in a sliver at the top
    values = np.concatenate([rng.random(400), 1 - rng.random(200) * 1e-9])
    rows = [("hot" if i % 3 else "cold", float(v), int(rng.integers(1, 5))) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, v double, n bigint")
    got = ordered.running_sums(df, ["k"], "v", ["n"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_below"] == sum(n for k, v, n in rows if k == r["k"] and v < r["v"])
        assert r["n_all"] == sum(n for k, _, n in rows if k == r["k"])
    spread = ordered.with_bucket(df, F.col("v")).groupBy("bucket").count().agg(F.max("count")).first()[0]
    assert spread < len(rows) / 10


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(v)) for k in "ab" for v in np.unique(np.round(rng.random(300), 3))]
    df = ordered.with_bucket(spark.createDataFrame(rows, "k string, v double"), F.col("v"))
    for r in ordered.neighbours(df, ["k"], "v", {"prev": "v"}, {"next": "v"}).collect():
        own = [v for k, v in rows if k == r["k"]]
        assert r["prev"] == max((v for v in own if v < r["v"]), default=None)
        assert r["next"] == min((v for v in own if v > r["v"]), default=None)


@pytest.fixture
def copies(spark):
    """A third of the rows share one path."""
    return [(i, "same" if i % 3 == 0 else f"p{i}") for i in range(900)]


def by_hash(rows, seed=7):
    return sorted(rows, key=lambda r: (sha(f"{seed}:{r[1]}")[:16], sha(str(r[0])), r[0]))


@pytest.mark.parametrize("quota", [0, 1, 299, 300, 301, 450, 899, 900, 2000])
def test_cut_inside_a_group_of_copies(spark, copies, quota):
    df = spark.createDataFrame(copies, "id bigint, path string").withColumn("h", stable_hash("path", 7))
    got = {r["id"] for r in ordered.take_first(df, [], "h", "id", F.lit(quota)).collect()}
    assert got == {i for i, _ in by_hash(copies)[:quota]}


def test_copies_are_spread_over_buckets(spark, copies):
    df = spark.createDataFrame(copies, "id bigint, path string").withColumn("h", stable_hash("path", 7))
    rows = ordered._order_buckets(df, "h", "id", None)
    assert rows.groupBy("bucket").count().agg(F.max("count")).first()[0] < 60


def test_positions(spark, copies):
    df = spark.createDataFrame(copies, "id bigint, path string").withColumn("h", stable_hash("path", 7))
    got = {r["id"]: r["position"] for r in ordered.positions(df, [], "h", "id").collect()}
    assert got == {r[0]: n + 1 for n, r in enumerate(by_hash(copies))}


@pytest.mark.parametrize("limit", [3, 10, 101, 250, 400, 5000])
def test_round_robin(spark, limit):
    rows = [(i, "abcd"[min(i % 7, 3)] if i < 300 else "z") for i in range(310)]
    got = {r["id"] for r in sampling.round_robin_limit(spark.createDataFrame(rows, "id bigint, g string"), "id", ["g"], limit, 7).collect()}
    groups = {}
    for r in sorted(rows, key=lambda r: (sha(f"7:{r[0]}")[:16], r[0])):
        groups.setdefault(r[1], []).append(r[0])
    want, turn = [], 0
    while len(want) < limit and any(turn < len(g) for g in groups.values()):
        for name in sorted(groups):
            if turn < len(groups[name]) and len(want) < limit:
                want.append(groups[name][turn])
        turn += 1
    assert got == set(want)


def test_resample_is_balanced_and_repeatable(spark):
    rows = [(i, "big" if i < 900 else "small") for i in range(1000)]
    df = spark.createDataFrame(rows, "id bigint, g string")
    draw = lambda d: sorted((r["id"], r["copy"]) for r in sampling.inverse_frequency_resample(d, "id", ["g"], 3).collect())
    once = draw(df)
    assert once == draw(df.repartition(5))
    small = sum(1 for i, _ in once if i >= 900)
    assert 380 < small < 620 and 850 < len(once) < 1150


def test_a_tiny_group_is_drawn_as_often_as_a_large_one(spark):
    rows = [(i, "big" if i < 1998 else "tiny") for i in range(2000)]
    df = spark.createDataFrame(rows, "id bigint, g string")
    drawn = {r["g"]: r["count"] for r in sampling.inverse_frequency_resample(df, "id", ["g"], 5).groupBy("g").count().collect()}
    assert 850 < drawn["tiny"] < 1150 and 850 < drawn["big"] < 1150


@pytest.mark.parametrize("hot", [1, 3, 10_000])
def test_hamming_pairs(spark, hot):
    rng = np.random.default_rng(3)
    base = [int.from_bytes(rng.bytes(8), "big") for _ in range(60)]
    flip = lambda v, k: v ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False))
    rows = set()
    for a in base:
        d = base[int(rng.integers(60))]
        rows |= {(a, d), (flip(a, 3), flip(d, 4)), (flip(a, 4), d), (flip(a, 5), d)}
    # many prints that share the average hash entirely
    rows |= {((1 << 64) - 1, flip(base[0], 2)) for _ in range(25)}
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    df = spark.createDataFrame([(signed(a), signed(d)) for a, d in rows], "a bigint, d bigint")
    pairs = banded.hamming_pairs(df, "a", "d", 4, 4, hot=hot).collect()
    got = sorted(frozenset([(r[0], r[1]), (r[2], r[3])]) for r in pairs)
    ordered_rows = sorted(rows)
    want = {
        frozenset([(signed(x[0]), signed(x[1])), (signed(y[0]), signed(y[1]))])
        for i, x in enumerate(ordered_rows)
        for y in ordered_rows[i + 1 :]
        if (x[0] ^ y[0]).bit_count() <= 4 and (x[1] ^ y[1]).bit_count() <= 4
    }
    assert len(got) == len(want) and set(got) == want


def test_knn_closed_form(spark):
    base = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.0, 1.0], 0)], "base_id bigint, vector array<double>, label int")
    base = base.withColumn("vector", nb.unit(F.col("vector")))
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "query_id bigint, vector array<double>")
    votes = {(r["query_id"], r["k"]): r["score"] for r in nb.vote(nb.nearest(queries, base, 3), [1, 3], [10.0]).collect()}
    assert votes[0, 1] == 1.0 and votes[1, 1] == 0.0
    assert votes[0, 3] > 0.99 and votes[1, 3] < 0.01


@pytest.mark.parametrize("block_rows", [7, 50, 20_000])
def test_knn_blocks_against_brute_force(spark, block_rows):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(80, 6)), np.repeat(rng.normal(size=(1, 6)), 40, 0)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    base = spark.createDataFrame([(i, [float(v) for v in r], i % 2) for i, r in enumerate(x)], "base_id bigint, vector array<double>, label int")
    queries = base.select(F.col("base_id").alias("query_id"), "vector")
    found = nb.nearest(queries, base, 5, pivots=6, block_rows=block_rows, skip_self=True).collect()
    sims = x @ x.T
    np.fill_diagonal(sims, -np.inf)
    for q in range(len(x)):
        got = sorted((r["place"], r["similarity"]) for r in found if r["query_id"] == q)
        assert [s for _, s in got] == pytest.approx(sorted(sims[q])[::-1][:5], abs=1e-9)


def test_query_blocks_keep_neighbours_together_and_split_crowds():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(100, 5))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    sizes = {c: int(rng.integers(0, 40)) for c in range(0, 100, 2)} | {7: 1000}
    first, count = nb.query_blocks_of(centres, sizes, 50)
    load = {}
    for cell, n in sizes.items():
        own = first[cell] + nb._spread(np.arange(n) * 977 + cell, np.full(n, count[cell]))
        assert len(own) == 0 or (own >= first[cell]).all() and (own < first[cell] + count[cell]).all()
        for b in own.tolist():
            load[b] = load.get(b, 0) + 1
    assert count[7] == 20 and count.sum() == 100 + 19
    assert max(load.values()) < 100 and len(load) < 60  # about 50 queries a block, whatever the cell
    shared = [c for c in range(100) if count[c] == 1]
    coarse = (centres @ centres[:10].T).argmax(axis=1)
    for block in set(first[shared].tolist()):  # cells of a block are neighbours in the order of coarse pivots
        here = sorted({coarse[c] for c in shared if first[c] == block})
        assert here == list(range(here[0], here[-1] + 1)) or len(set(coarse.tolist())) < 10


def test_knn_of_clusters_and_an_empty_base(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(8, 16))
    x = np.concatenate([c + 0.01 * rng.normal(size=(30, 16)) for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    base = spark.createDataFrame([(i, [float(v) for v in r], i % 2) for i, r in enumerate(x)], "base_id bigint, vector array<double>, label int")
    queries = base.where("base_id % 3 = 0").select(F.col("base_id").alias("query_id"), "vector")
    found = nb.nearest(queries, base, 4, block_rows=20).collect()
    sims = x @ x.T
    for q in range(0, len(x), 3):
        got = [r["base_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["place"])]
        assert got == sorted(range(len(x)), key=lambda i: (-sims[q, i], i))[:4]
    assert nb.nearest(queries, base.where("false"), 4).collect() == []


def test_knn_streams_base_rows_and_ties_copies_by_id(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(5200, 12))
    x[5::7] = x[5]  # 743 copies of one vector, and pairs of near copies far below single precision
    x[1::9] = x[0::9][: len(x[1::9])] * (1 + 1e-9)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, r.tolist(), None if i % 11 == 0 else i % 2) for i, r in enumerate(x)]
    odd = [(9000, None, 1), (9001, [float("nan")] * 12, 1), (9002, [float("inf")] + [0.0] * 11, 1), (None, x[0].tolist(), 1)]
    base = spark.createDataFrame(rows + odd, "base_id bigint, vector array<double>, label int")
    queries = base.select(F.col("base_id").alias("query_id"), "vector").where("query_id % 4 = 0 or query_id is null")
    out = nb.nearest(queries, base, 6, skip_self=True)
    plan = out._jdf.queryExecution().toString()
    assert "CoGroups" not in plan  # no task gathers a group of base rows
    found = {}
    for r in out.collect():
        found.setdefault(r["query_id"], []).append((r["place"], r["base_id"], r["similarity"], r["label"]))
    assert sorted(found) == [q for q in range(len(x)) if q % 4 == 0]
    for q in range(0, len(x), 4):
        sims = (x[q] * x).sum(axis=1)  # equal vectors give equal sums
        want = [i for i in np.lexsort([np.arange(len(x)), -sims]).tolist() if i != q][:6]
        assert sorted(found[q]) == [(p + 1, i, sims[i], rows[i][2]) for p, i in enumerate(want)]


def test_quantiles_match_numpy(spark):
    from sieveline.operators.runstats import exact_quantiles, pct_rank_average

    rng = np.random.default_rng(5)
    v = np.round(rng.random(501), 2)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id int, score double")
    got = {r["quantile"]: r["value"] for r in exact_quantiles(df, [], [0.05, 0.5, 0.9]).collect()}
    for p, x in got.items():
        assert x == pytest.approx(np.quantile(v, p))
    ranks = {r["id"]: r["p"] for r in pct_rank_average(df, [], "score", "p").collect()}
    for i, x in enumerate(v):
        assert ranks[i] == pytest.approx(((v < x).sum() + ((v == x).sum() + 1) / 2) / len(v))


def test_rows_of_a_hot_group_are_marked_in_many_tasks(spark):
    """Two labels: the look-up of a group's last row must not bring a label's rows into one task."""
    held = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        rows = spark.range(20_000).select("id", (F.col("id") % 2).alias("y"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
        out = ordered.mark_first(rows, ["y"], "h", "id", F.lit(500))
        parts = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(parts) == 20_000 and max(parts) < 5_000
        assert out.columns == ["id", "y", "h", "chosen"]
        chosen = {r["id"] for r in out.where("chosen").collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    firsts = sorted((r["h"], r["id"], r["y"]) for r in rows.collect())
    assert chosen == {i for y in (0, 1) for _, i, _ in [f for f in firsts if f[2] == y][:500]}
