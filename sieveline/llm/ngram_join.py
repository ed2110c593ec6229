"""Near-duplicate join on word n-grams, with adaptive multi-match prefixes.

Texts are sets of five-word shingles. Two sets link when their Jaccard similarity
reaches the threshold, and linked sets form components.

* Equal sets are one set, known by a 128-bit key, before anything is compared.
* Shingles are ordered rare to frequent by a fixed-size count sketch of all texts.
  Sets of n and m shingles that link share a = ceil(t (n + m) / (1 + t)); so the
  first n - a + L of one and the first m - a + L of the other share L at least.
* Every set gets its own L. A longer prefix meets more postings but asks for more
  matches; each set takes the L whose postings and verifications, estimated from the
  frequencies in its prefix, cost least. A pair has to reach the smaller L.
* Components need no pairs inside a component. In every posting list the set whose
  prefix is the most shared is compared with the others first; what it links is
  one component, and only pairs across components are made after that, with the
  largest component of a list on one side at most.
* Pairs are verified on the whole sets, so results are exact.

A null text is an empty one. An empty set links with nothing. A row with a null
id belongs to its set's component, and gives it no number; a component without any
id has a null number. Repeated rows are copies. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import blocks, pick, with_fields
from sieveline.llm.rolling import inverse_powers, mixed, powers, prefix_sums, weights_of
from sieveline.session import cut_lineage, written

WORDS = 5
BLOCK = 1 << 20
"""Bytes of text hashed at once; a byte takes some 20 more in numbers, and the powers of so many are kept."""
THRESHOLD = (80, 100)
"""Similarity as a fraction of whole numbers."""
MOST_MATCHES = 4
"""The largest L a set can take."""
SKETCH_BITS = 21
"""The count sketch has 2^21 counters of 4 bytes, whatever the input; it decides the order alone, never a result."""
CHUNK_BITS = 14
BLOOM_BITS = 20
"""2^20 words of 64 bits that say which sets may have partners; a full filter only saves less."""
VERIFY = 16.0
"""Cost of verifying a pair, in postings."""

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_WEIGHTS = weights_of(LOWER)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its shingles."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    flat = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)  # white on both sides of every text
    if not texts:
        return []
    ends = np.cumsum([len(r) + 1 for r in raw]) + 1
    white = WHITE[flat]
    start, stop = np.flatnonzero(white[:-1] & ~white[1:]) + 1, np.flatnonzero(white[1:] & ~white[:-1]) + 1
    sums = prefix_sums(flat, LOWER_WEIGHTS)
    word = sums[stop] - sums[start]
    word *= inverse_powers(len(flat))[start]
    word += (stop - start).astype(np.uint64)
    word = mixed(word)
    first = np.searchsorted(start, ends - [len(r) + 1 for r in raw])
    last = np.searchsorted(start, ends)
    step = powers(words)
    n = len(word)
    whole = np.zeros(max(0, n - words + 1), np.uint64)
    for k in range(words):
        whole += word[k : k + len(whole)] * step[k]
    whole = mixed(whole)
    spans = list(zip(first.tolist(), last.tolist()))
    for a, b in spans:
        if b - a >= words:
            whole[a : b - words + 1].sort()
    fresh = np.ones(len(whole), bool)
    fresh[1:] = whole[1:] != whole[:-1]
    out = []
    for a, b in spans:
        if b - a >= words:
            kept = fresh[a : b - words + 1]
            kept[0] = True  # what lies before is not of this text
            out.append(whole[a : b - words + 1][kept])
        elif b > a:  # the whole sequence is one shingle; its length sets it apart
            out.append(mixed((word[a:b] * step[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def key_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sketch(rows: DataFrame, words: int) -> np.ndarray:
    """How often shingles fall on each counter, over all texts."""
    chunk = 1 << CHUNK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for block in blocks(batches, "text", BLOCK):
            sets = shingle_sets(block.column("text").to_pylist(), words)
            slots = np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS) if sets else np.zeros(0, np.uint64)
            counts += np.bincount(slots.astype(np.int64), minlength=len(counts)).astype(np.uint32)
        for at in range(0, len(counts), chunk):
            part = counts[at : at + chunk]
            if part.any():
                yield pa.record_batch([pa.array([at], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["at", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch.column("at").to_pylist(), batch.column("counts").to_pylist()):
                sums[at] = sums.get(at, 0) + np.frombuffer(counts, np.uint32).astype(np.uint64)
        for at, total in sums.items():
            yield pa.record_batch([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["at", "counts"])

    parts = rows.select("text").mapInArrow(count, "at int, counts binary").repartition("at").mapInArrow(add, "at int, counts binary")
    out = np.zeros(1 << SKETCH_BITS, np.uint64)
    for row in parts.collect():  # a fixed number of counters
        out[row["at"] : row["at"] + chunk] = np.frombuffer(row["counts"], np.uint64)
    return out


def needed(n, m, threshold=THRESHOLD):
    """Shingles that sets of n and m have to share: ceil(t (n + m) / (1 + t)); on numbers or columns."""
    part, whole = threshold
    total = (n + m) * part + (part + whole - 1)
    return F.floor(total / (part + whole)).cast("int") if isinstance(n, Column) else total // (part + whole)


def _prefixes(rows: DataFrame, sketch: np.ndarray, words: int, threshold, among: np.ndarray | None = None) -> DataFrame:
    """`token`, `key`, `n`, `at`: the longest prefix that a set could need, rare shingles first.

    With a filter, only of the tokens that pass it; places count all.
    """
    shared = rows.sparkSession.sparkContext.broadcast((sketch, among))
    part, whole = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (often, bits), done = shared.value, set()
        for block in blocks(batches, "text", BLOCK):
            tokens, keys, sizes, places = [], [], [], []
            for found in shingle_sets(block.column("text").to_pylist(), words):
                key = key_of(found)
                n = len(found)
                if not n or key in done:  # a copy within the task
                    continue
                done.add(key)
                least = -(-n * part // whole)
                take = min(n, n - least + MOST_MATCHES)
                order = np.lexsort((found, often[found >> np.uint64(64 - SKETCH_BITS)]))[:take]
                prefix, place = found[order], np.arange(take, dtype=np.int32)
                if bits is not None:
                    word, bit = _places(prefix)
                    passed = (bits[word] & bit) != 0
                    prefix, place = prefix[passed], place[passed]
                tokens.append(prefix)
                keys += [key] * len(prefix)
                sizes.append(np.full(len(prefix), n, np.int32))
                places.append(place)
            if keys:
                yield pa.record_batch(
                    [
                        pa.array(np.concatenate(tokens).view(np.int64)),
                        pa.array(keys, pa.binary()),
                        pa.array(np.concatenate(sizes)),
                        pa.array(np.concatenate(places)),
                    ],
                    names=["token", "key", "n", "at"],
                )

    return rows.select("text").mapInArrow(run, "token long, key binary, n int, at int")


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of the filter for 64-bit hashes."""
    return (hashes & np.uint64((1 << BLOOM_BITS) - 1)).astype(np.int64), np.uint64(1) << (hashes >> np.uint64(58))


def _halves(keys: list[bytes]) -> np.ndarray:
    """The first 64 bits of each key."""
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)[:, 0]


def _filter_of(wanted: DataFrame) -> np.ndarray:
    """A fixed number of bits that tells most values outside of `wanted` (one column of keys or tokens) from those inside."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0)
            if pa.types.is_int64(values.type):
                hashes = values.to_numpy().view(np.uint64)
            else:
                hashes = _halves(values.to_pylist())
            word, bit = _places(hashes)
            yield pa.record_batch([pa.array(word), pa.array(bit.view(np.int64))], names=["word", "bits"])

    words = wanted.mapInArrow(place, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = words.toArrow()
    out = np.zeros(1 << BLOOM_BITS, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """`id`, `key`, `n` of every row; the key of an empty set is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK):
            found = shingle_sets(block.column("text").to_pylist(), words)
            keys = pa.array([key_of(f) if len(f) else None for f in found], pa.binary())
            sizes = pa.array([len(f) for f in found], pa.int64())
            yield pa.record_batch([block.column("id"), keys, sizes], names=["id", "key", "n"])

    return rows.select("id", "text").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key binary, n long")


def _whole_sets(rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """`key` and `shingles` (sorted 64-bit hashes) of the sets among `wanted`, once each."""
    # the filter lets pass a few more than wanted, and the join takes these out
    shared = rows.sparkSession.sparkContext.broadcast(_filter_of(wanted.select("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, done = shared.value, set()
        for block in blocks(batches, "text", BLOCK):
            fresh = {}
            for found in shingle_sets(block.column("text").to_pylist(), words):
                key = key_of(found)
                if len(found) and key not in done:
                    done.add(key)
                    fresh[key] = found
            if fresh:
                word, bit = _places(_halves(list(fresh)))
                passed = [k for k, hit in zip(fresh, (bits[word] & bit) != 0) if hit]
                held = pa.array([fresh[k].tobytes() for k in passed], pa.binary())
                yield pa.record_batch([pa.array(passed, pa.binary()), held], names=["key", "shingles"])

    found = rows.select("text").mapInArrow(run, "key binary, shingles binary")
    return found.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])


def _verify(pairs: DataFrame, rows: DataFrame, words: int, threshold) -> DataFrame:
    """Those pairs `a`, `b` whose whole sets are similar enough; the sets are made again, for these pairs alone."""
    part, whole = threshold
    pairs = cut_lineage(pairs.select("a", "b"))
    if not pairs.limit(1).count():
        return pairs
    sets = _whole_sets(rows, pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                links.append(whole * both >= part * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(links, pa.bool_()))

    x = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    return cut_lineage(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary"))


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """`key` and `root` (the smallest key reachable) of every key that has an edge `a`, `b`.

    Each round a key takes the smallest root among its neighbours, and then its
    root's root, so chains shorten by half and stars end at once.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    roots = cut_lineage(both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("key"), F.least("a", "near").alias("root")))
    for _ in range(most_rounds):
        seen = both.join(roots.toDF("b", "root"), "b").groupBy("a").agg(F.min("root").alias("near")).toDF("key", "near")
        closer = roots.join(seen, "key").select("key", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = closer.select(F.col("key").alias("root"), F.col("root").alias("further"))
        moved = closer.join(jump, "root", "left").select("key", "was", F.least("root", F.coalesce("further", "root")).alias("root"))
        moved = cut_lineage(moved)
        roots = moved.select("key", "root")
        if moved.filter("root <> was").limit(1).count() == 0:
            return roots
    raise RuntimeError("components did not settle")


def _candidates(left: DataFrame, right: DataFrame, where: Column, threshold) -> DataFrame:
    """Pairs `a` < `b` that share as many prefix shingles as the smaller L of the two asks for."""
    names = ["key", "n", "at", "matches", "comp", "main"]
    x = left.select("token", *[F.col(c).alias(f"x_{c}") for c in names])
    y = right.select("token", *[F.col(c).alias(f"y_{c}") for c in names])
    share = needed(F.col("x_n"), F.col("y_n"), threshold)
    asked = F.least("x_matches", "y_matches")
    reach = (F.col("x_at") < F.col("x_n") - share + asked) & (F.col("y_at") < F.col("y_n") - share + asked)
    fits = share <= F.least("x_n", "y_n")
    met = x.join(y, (x["token"] == y["token"]) & where & reach & fits)
    ordered = met.select(
        F.least("x_key", "y_key").alias("a"), F.greatest("x_key", "y_key").alias("b"), asked.alias("asked")
    )
    return ordered.groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("asked").alias("asked")).filter("shared >= asked")


def link_sets(rows: DataFrame, words: int = WORDS, threshold=THRESHOLD) -> DataFrame:
    """`key` and `root` of every set that links with another, from rows with `text`."""
    part, whole = threshold
    sketch = _sketch(rows, words)
    # counts are written first: a join of two fresh shuffles can split a hot token, one onto an aggregate cannot
    often = cut_lineage(_prefixes(rows, sketch, words, threshold).groupBy("token").count().filter("count > 1").select("token"))
    # the prefixes are made again, and most tokens that stand alone are not sent at all
    posted = _prefixes(rows, sketch, words, threshold, _filter_of(often))
    shared = written(posted.join(often, "token").distinct(), "shared")
    counts = cut_lineage(shared.groupBy("token").agg(F.count("*").alias("often")).filter("often > 1"))
    shared = shared.join(counts, "token")

    # how much each L costs a set, and how central a set is in its lists
    free = F.col("n") - F.ceil(F.col("n") * part / whole).cast("int")
    met = [F.sum(F.when(F.col("at") < free + ell, F.col("often") - 1).otherwise(0)).alias(f"met{ell}") for ell in range(1, MOST_MATCHES + 1)]
    costs = shared.groupBy("key").agg(*met)
    cost = F.array(*[F.struct((F.col(f"met{ell}") * (1 + VERIFY / ell)).alias("cost"), F.lit(ell).alias("matches")) for ell in range(1, MOST_MATCHES + 1)])
    chosen = costs.select("key", F.array_min(cost)["matches"].alias("matches"), F.col(f"met{MOST_MATCHES}").alias("mass"))
    posts = written(shared.join(chosen, "key").select("token", "key", "n", "at", "matches", "mass"), "posts")

    # first round: everything in a list against its most central set
    alone = posts.withColumn("comp", F.col("key")).withColumn("main", F.lit(None).cast("binary"))
    centre = alone.groupBy("token").agg(F.max(F.struct("mass", "key", "n", "at", "matches", "comp", "main")).alias("c"))
    centre = cut_lineage(centre.select("token", "c.*"))
    first = _verify(_candidates(centre, alone, F.col("x_key") != F.col("y_key"), threshold), rows, words, threshold)
    roots = components(first)

    # second round: across components; all but the largest of a list against all others in it
    held = posts.join(roots, "key", "left").withColumn("comp", F.coalesce("root", "key"))
    sizes = held.groupBy("token", "comp").agg(F.count("*").alias("size"))
    mixed_lists = sizes.groupBy("token").agg(F.count("*").alias("kinds"), F.max(F.struct("size", "comp"))["comp"].alias("main"))
    held = written(held.join(cut_lineage(mixed_lists.filter("kinds > 1")), "token"), "held")
    apart = (F.col("x_comp") != F.col("y_comp")) & ((F.col("y_comp") == F.col("y_main")) | (F.col("x_key") < F.col("y_key")))
    pairs = _candidates(held.filter("comp <> main"), held, apart, threshold)
    second = _verify(pairs, rows, words, threshold)
    return components(first.union(second))


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold=THRESHOLD):
    """(`id`, `key`, `n` of every row; `key`, `component_id`, `keeper` of every set).

    `component_id` is the smallest id of the component, and `keeper` the key of
    the one set that stands for it: that of the smallest id, or key where ids are equal.
    """
    rows = pick(docs, id_col, text_col).toDF("id", "text")
    members = cut_lineage(_sets(rows, words))
    roots = link_sets(rows, words, threshold)
    sets = members.filter("n > 0").groupBy("key").agg(F.min("id").alias("first_id"))
    grouped = sets.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    best = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "key"))
    named = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"), best["key"].alias("keeper"))
    return members, grouped.join(named, "root").select("key", "component_id", "keeper")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold=THRESHOLD) -> DataFrame:
    """`id_col`, `n_shingles`, `component_id` of every row."""
    members, sets = link(docs, id_col, text_col, words, threshold)
    number = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    joined = members.join(sets.select("key", "component_id"), "key", "left")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), number.alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold=THRESHOLD) -> DataFrame:
    """The rows of `docs` that stay: one of each component, with all columns. Rows with empty sets all stay."""
    _, sets = link(docs, id_col, text_col, words, threshold)
    keepers = sets.filter("key = keeper").select("key")
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    place, text = F.col(f"c{names.index(id_col)}"), F.col(f"c{names.index(text_col)}")
    keyed = _keyed(rows.withColumn("text", text), words)
    single = keyed.filter("key is null").drop("key")
    order = F.struct(place.isNull().alias("none"), place.alias("id"), *rows.columns)
    kept = keyed.filter("key is not null").join(keepers, "key", "left_semi")
    kept = kept.groupBy("key").agg(F.min_by(F.struct(*rows.columns), order).alias("row")).select("row.*")
    return kept.union(single.select(kept.columns)).toDF(*names)


def _keyed(rows: DataFrame, words: int) -> DataFrame:
    """All columns but `text`, and the set's `key` (null for an empty set)."""
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK):
            found = shingle_sets(block.column("text").to_pylist(), words)
            keys = pa.array([key_of(f) if len(f) else None for f in found], pa.binary())
            yield pa.record_batch([*[block.column(c) for c in kept], keys], names=[*kept, "key"])

    return rows.mapInArrow(run, with_fields(rows.select(kept), key="binary"))
