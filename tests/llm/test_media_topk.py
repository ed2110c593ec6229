import hashlib
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import media, registered, topk


def test_png_round_trip_and_determinism():
    rnd = np.random.default_rng(1)
    for n in (64, 640, 64 * 333):
        for data in (rnd.integers(0, 256, n, dtype=np.uint8).tobytes(), bytes(n), (b"abcd" * n)[:n]):
            stored = media.write_png(data)
            assert stored == media.write_png(data)
            assert media.read_png(stored).tobytes() == data


@pytest.mark.parametrize("kind", range(5))
def test_every_row_filter_is_undone(kind):
    rnd = np.random.default_rng(kind)
    rows = rnd.integers(0, 256, (9, 64), dtype=np.uint8).astype(int)
    lines = []
    for y, row in enumerate(rows):
        line = [kind]
        for x, value in enumerate(row):
            a = row[x - 1] if x else 0
            b = rows[y - 1][x] if y else 0
            c = rows[y - 1][x - 1] if x and y else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            guess = [0, a, b, (a + b) // 2, near][kind]
            line.append((value - guess) % 256)
        lines.append(line)
    assert (media.unfilter(np.array(lines, np.uint8)) == rows).all()


def test_damage_is_noticed():
    stored = media.write_png(bytes(range(64)) * 4)
    for at in (0, 20, 45, len(stored) - 3):
        broken = bytearray(stored)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            media.read_png(bytes(broken))
    with pytest.raises(ValueError):
        media.read_png(stored[:-12])
    short = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">II5B", 64, 9, *media.GREY8))
    short += media._chunk(b"IDAT", zlib.compress(bytes(65))) + media._chunk(b"IEND", b"")
    with pytest.raises(ValueError):
        media.read_png(short)


def test_hash_keeps_low_frequencies():
    waves = 128 + 60 * np.cos(np.linspace(0, 7, 64))[:, None] * np.cos(np.linspace(0, 5, 64))
    noisy = waves + np.random.default_rng(2).normal(0, 3, waves.shape)
    other = 128 + 60 * np.cos(np.linspace(0, 20, 64))[None, :] * np.ones((64, 1))
    distance = lambda a, b: bin(int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).count("1")
    base = media.low_frequencies(waves)
    assert distance(base, media.low_frequencies(noisy)) < distance(base, media.low_frequencies(other))


def test_media_rows(make_docs):
    rows = [(1, "text"), (2, None), (3, ""), (4, "é" * 100_000), (1, "text"), (None, "text")]
    out = media.digests(media.load(media.store(make_docs(rows)))).collect()
    assert len(out) == len(rows)
    for r in out:
        raw = (dict(rows)[r["doc_id"]] or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(padded[-64:])
        assert r["media_bytes"] > 0 and len(r["feature"]) == 16
    same = {(r["media_sha256"], r["feature"]) for r in out if r["n_bytes"] == 4}
    assert len(same) == 1
    assert media.digests(media.load(media.store(make_docs([])))).collect() == []


def brute(vectors, k):
    out = []
    for q, x in vectors.items():
        if q % 50 == 0:
            best = sorted((-int(np.dot(x, y)), c) for c, y in vectors.items() if c != q)[:k]
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(best)]
    return sorted(out)


def test_top_k_is_exact(spark):
    rnd = np.random.default_rng(4)
    weights = {i: rnd.integers(-3, 4, 6) * (rnd.random(6) < 0.6) for i in range(400)}
    weights |= {i: np.full(6, 2) for i in range(400, 450)}  # ties
    rows = [(i, [float(w) / 256 for w in v]) for i, v in weights.items()]
    rows += [rows[7], rows[400]]  # repeated rows count once
    rows += [(1000, None), (1050, [0.5, None] + [0.0] * 4), (1100, [float("nan")] * 6), (1150, [float("inf")] * 6), (None, [9.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("weights", F.lit("x"))
    usable = frame.filter(topk.usable(F.col("embedding"))).withColumn("WEIGHTS", topk.weights(F.col("embedding")))
    usable = usable.toDF("vec_id", "embedding", "w")
    found = topk.top_k(usable, F.col("vec_id") % 50 == 0, weight_col="w", candidates=100, queries=4)
    assert sorted(map(tuple, found.collect())) == brute(weights, 5)
    few = usable.filter("vec_id in (0, 1, 2)")
    assert len(topk.top_k(few, F.col("vec_id") % 50 == 0, weight_col="w").collect()) == 2
    assert topk.top_k(usable.filter("vec_id < 0"), F.col("vec_id") % 50 == 0, weight_col="w").collect() == []


def every_row(rows, k=5):
    """Brute force in which each row is a query and a candidate of its own."""
    weights = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    out = []
    for at, (q, x) in enumerate(weights):
        if q is not None and q % 50 == 0:
            others = [(c, sum(a * b for a, b in zip(x, y))) for j, (c, y) in enumerate(weights) if j != at]
            others.sort(key=lambda r: (-r[1], r[0] is None, r[0] or 0))
            out += [(q, i + 1, c, s) for i, (c, s) in enumerate(others[:k])]
    return sorted(out, key=str)


def test_op7_counts_every_row_and_leaves_out_the_own_row_alone(spark, tmp_path):
    rnd = np.random.default_rng(9)
    rows = [(i, rnd.normal(size=4).astype(np.float32).tolist()) for i in range(-60, 160)]
    rows += [rows[10]] * 2 + [rows[60]] * 3 + [(7, [9.0, 9.0, 9.0, 9.0])] * 7  # rows 60 and 10: ids 0 and -50
    rows += [(100, rnd.normal(size=4).astype(np.float32).tolist()), (None, [8.0, -8.0, 8.0, 8.0]), (150, []), (33, [5.0])]
    bad = [(200, None), (250, [1.0, None]), (4, [float("nan")] * 4), (5, [float("-inf")] * 4)]
    kinds = "vec_id long, embedding array<float>, label int"
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame([(*r, 0) for r in rows + bad], kinds).write.parquet(path)
    found = registered.QUERIES["op7_exact_top_k"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=str) == every_row(rows)


def test_scores_beyond_a_long_are_ranked_exactly(spark):
    big = float(1 << 32)
    rows = [(0, [big, 1.0, big]), (1, [-big, 0.0, -big]), (2, [0.0, 3.0, 0.0]), (3, [big, 2.0, -big]), (50, [0.0, 1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    weighted = frame.select("vec_id", topk.weights(F.col("embedding")).alias("weights"))
    found = topk.top_k(weighted, F.col("vec_id") % 50 == 0, k=3, each_row=True)
    assert sorted(map(tuple, found.collect()), key=str) == every_row(rows, 3)
    with pytest.raises(Exception, match="a score does not fit a long"):
        topk.top_k(weighted, F.col("vec_id") == 0, k=4, each_row=True).collect()
    huge = spark.createDataFrame([(0, [1e30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="a weight does not fit a long"):
        huge.select(topk.weights(F.col("embedding"))).collect()
