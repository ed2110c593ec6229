"""Repeated passages by longest-previous-factor arrays.

A byte is a repeat if a string of `length` bytes that covers it also starts
somewhere else: earlier, when the first copy is kept, or anywhere, when none is.

Suffixes that can share `length` bytes are brought together before they are
sorted. Of every window of `length` bytes the 200-byte string with the smallest
hash is its anchor, so equal windows have equal anchors at equal places. Runs of
windows with one anchor are a stretch. Anchors that occur once are out; stretches
that are equal as a whole repeat in all their windows, and one of them stands for
all. The distinct stretches of an anchor are dealt into groups, and in each group
a suffix array is built by prefix doubling over their bytes, with the common
prefixes of neighbours. For every window start the previous and the next smaller
position in suffix order are its best earlier matches; the longer of the two
common prefixes is the longest previous factor. Mirrored, the same gives the longest
factor that starts later.

An anchor with more than HOT distinct stretches does not go into one task. Its
windows are counted one by one, which needs no group and gives the same result.

A null text is an empty one. Texts are known by 128 bits; equal texts share one
result, and with the first copy kept, only the row with the smallest id keeps its
text (null ids come last; rows that repeat an id and its text are one document). Matches do
not cross rows. Extra columns are carried or ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import blocks, pick, text_key
from sieveline.llm.rolling import inverse_powers, mixed, prefix_sums
from sieveline.session import cut_lineage, scratch_path, written

LENGTH = 400
GRAM = 200
BLOCK = 1 << 20
"""Bytes of text hashed at once; a byte takes some 50 more in numbers, and the powers of so many are kept."""
GROUP = 2000
"""Stretches of a suffix array, on average."""
HOT = 4096
"""Distinct stretches of one anchor beyond which its windows are counted one by one."""


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, from running minima of blocks in both directions."""
    n = len(x)
    filled = np.concatenate([x, np.full(-n % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(filled, axis=1).ravel()
    np.minimum.accumulate(filled[:, ::-1], axis=1, out=filled[:, ::-1])
    m = n - width + 1
    return np.minimum(filled.ravel()[:m], ahead[width - 1 : width - 1 + m])


def stretches(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text, first window's start in it, windows, anchor's hash, hash of the run's bytes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    n, none = len(flat), np.zeros(0, np.int64)
    if not len(sizes) or sizes.max() < length:
        return none, none, none, none, none
    ends = np.cumsum(sizes)
    firsts = ends - sizes
    sums = prefix_sums(flat)
    inverse = inverse_powers(n)
    hashes = sums[gram:] - sums[: n - gram + 1]
    hashes *= inverse[: n - gram + 1]
    hashes = mixed(hashes)
    # the place in the low half: the leftmost of equal strings is the anchor
    ranked = hashes & np.uint64(0xFFFFFFFF00000000)
    ranked |= np.arange(len(hashes), dtype=np.uint64)
    least = sliding_min(ranked, length - gram + 1)
    del ranked
    holds = np.zeros(n + 1, np.int32)
    long = sizes >= length
    holds[firsts[long]] += 1
    holds[ends[long] - length + 1] -= 1
    start = np.flatnonzero(np.cumsum(holds)[: len(least)])
    anchor = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # a text's last window and the next text's first are never neighbours, as windows do not cross texts
    cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(start) != 1)) + 1
    head, tail = np.concatenate([[0], cut]), np.concatenate([cut, [len(start)]]) - 1
    i0, i1, at = start[head], start[tail], anchor[head]
    shape = ((i1 - i0).astype(np.uint64) << np.uint64(32)) | (at - i0).astype(np.uint64)
    body = mixed((sums[i1 + length] - sums[i0]) * inverse[i0] + mixed(shape))
    text = np.searchsorted(ends, i0, side="right")
    return text, i0 - firsts[text], i1 - i0 + 1, hashes[at].view(np.int64), body.view(np.int64)


def _distinct(block: pa.RecordBatch) -> tuple[list[bytes], list[int], np.ndarray]:
    """Texts of a block once each, the rows they stand at first, and how often each comes."""
    rows: dict[tuple[int, int], int] = {}
    times: list[int] = []
    first: list[int] = []
    for i, key in enumerate(zip(block.column("k1").to_pylist(), block.column("k2").to_pylist())):
        at = rows.setdefault(key, len(rows))
        if at == len(times):
            times.append(0)
            first.append(i)
        times[at] += 1
    texts = block.column("text").take(pa.array(first, pa.int32())).to_pylist()
    return [t.encode("utf-8", "surrogatepass") for t in texts], first, np.array(times, np.int64)


def _repeated_anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK):
            texts, _, times = _distinct(block)
            text, _, _, anchor, _ = stretches(texts, length, gram)
            yield pa.record_batch([pa.array(anchor), pa.array(times[text])], names=["anchor", "times"])

    met = rows.select("k1", "k2", "text").mapInArrow(run, "anchor long, times long")
    return met.groupBy("anchor").agg(F.sum("times").alias("times")).filter("times > 1").select("anchor")


def _occurrences(rows: DataFrame, length: int, gram: int) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK):
            texts, first, times = _distinct(block)
            text, at, windows, anchor, body = stretches(texts, length, gram)
            row = pa.array(np.array(first, np.int64)[text])
            yield pa.record_batch(
                [
                    pa.array(anchor),
                    pa.array(body),
                    *[block.column(c).take(row) for c in ("id", "k1", "k2")],
                    pa.array(at),
                    pa.array(windows.astype(np.int32)),
                    pa.array(times[text]),
                ],
                names=["anchor", "body", "id", "k1", "k2", "at", "windows", "times"],
            )

    return rows.mapInArrow(run, f"anchor long, body long, id {kind}, k1 long, k2 long, at long, windows int, times long")


def suffix_order(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at `starts` in order of their first `depth` bytes (then of place), and the common prefix with the one before.

    Ranks of the first 8 bytes are doubled up to `depth`; the ranks of all
    lengths on the way give the common prefixes.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    first = np.zeros(n, np.uint64)
    for k in range(8):
        first = (first << np.uint64(8)) | padded[k : k + n]
    size, levels = 8, []
    rank = np.unique(first, return_inverse=True)[1]
    while True:
        levels.append((size, rank))
        if size >= depth:
            break
        step = min(size, depth - size)
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        rank = np.unique((rank.astype(np.int64) << 32) | after, return_inverse=True)[1]
        size += step
    order = starts[np.lexsort((starts, rank[starts]))]
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), np.int64)
    for size, rank in reversed(levels):
        x, y = a + common, b + common
        same = (common + size <= depth) & (y < n) & (x < n)
        same[same] = rank[x[same]] == rank[y[same]]
        common[same] += size
    going = common < depth
    for _ in range(7):  # what is left is shorter than the first level
        x, y = a + common, b + common
        going &= (common < depth) & (x < n) & (y < n)
        going[going] = data[x[going]] == data[y[going]]
        common[going] += 1
    return order, np.concatenate([np.zeros(min(1, len(order)), np.int64), common])


def previous_factors(order: list[int], common: list[int]) -> dict[int, int]:
    """Longest previous factor of each position, from suffix order and common prefixes with the one before.

    The stack holds positions that grow; what stands below one is its previous
    smaller position, and what takes it off is its next smaller one.
    """
    out: dict[int, int] = {}
    stack: list[tuple[int, int]] = []
    for place, shared in zip(order, common):
        while stack and stack[-1][0] > place:
            larger, before = stack.pop()
            out[larger] = max(before, shared)
            shared = min(before, shared)
        stack.append((place, shared if stack else 0))
    out.update(stack)
    return out


def repeated_starts(data: np.ndarray, starts: np.ndarray, length: int, keep: str) -> np.ndarray:
    """Which starts have a factor of `length` bytes earlier (keep='first') or anywhere else (keep='none')."""
    order, common = suffix_order(data, starts, length)
    # a suffix whose neighbours share less has no such factor at all
    close = common >= length
    near = close | np.concatenate([close[1:], np.zeros(min(1, len(close)), bool)])
    order, common = order[near].tolist(), np.where(close, common, 0)[near].tolist()
    found = {p for p, shared in previous_factors(order, common).items() if shared >= length}
    if keep == "none":
        found |= {-p for p, shared in previous_factors([-p for p in order], common).items() if shared >= length}
    return np.isin(starts, np.fromiter(found, np.int64, len(found)))


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _cut_out(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted stretches: all their columns and `bytes`."""
    names = [c for c in wanted.columns if c not in ("k1", "k2")]
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct(*names)).alias("wanted"))
    joined = texts.join(lists, ["k1", "k2"]).select("k1", "k2", "text", F.explode("wanted").alias("w"))
    size = (F.col("w.windows") + F.lit(length - 1)).cast("int")
    raw = F.substring(F.col("text").cast("binary"), (F.col("w.at") + 1).cast("int"), size)
    return joined.select("k1", "k2", "w.*", raw.alias("bytes"))


def _by_suffix_arrays(cut: DataFrame, groups: int, length: int, keep: str) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        keys = [("none", "ascending"), ("id", "ascending"), ("k1", "ascending"), ("k2", "ascending"), ("at", "ascending")]
        group = group.append_column("none", group.column("id").is_null()).sort_by(keys)  # earlier rows first
        windows = group.column("windows").to_numpy()
        parts = group.column("bytes").to_pylist()
        sizes = np.array([len(p) for p in parts], np.int64)
        firsts = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(parts)), windows)
        within = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        hit = repeated_starts(np.frombuffer(b"".join(parts), np.uint8), firsts[row] + within, length, keep)
        # runs do not go on from one stretch to the next
        key = np.where(hit, row, -1)
        edge = np.flatnonzero(np.diff(np.concatenate([[-1], key, [-1]])) != 0)
        spans = [(a, b) for a, b in zip(edge, edge[1:]) if key[a] >= 0]
        rows = np.array([row[a] for a, _ in spans], np.int64)
        at = group.column("at").to_numpy()[rows] + np.array([within[a] for a, _ in spans], np.int64)
        picked = group.take(pa.array(rows))
        return pa.table(
            {
                "k1": picked.column("k1"),
                "k2": picked.column("k2"),
                "at": pa.array(at),
                "windows": pa.array(np.array([b - a for a, b in spans], np.int32)),
            }
        )

    dealt = cut.select("id", "k1", "k2", "at", "windows", "bytes", F.pmod("anchor", F.lit(groups)).alias("group"))
    return dealt.groupBy("group").applyInArrow(run, "k1 long, k2 long, at long, windows int")


def _by_windows(cut: DataFrame, length: int, keep: str) -> DataFrame:
    """Windows of hot anchors that come more than once, counted without bringing them together."""
    kind = cut.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (raw, windows) in enumerate(zip(batch.column("bytes").to_pylist(), batch.column("windows").to_pylist())):
                row = batch.slice(i, 1).take(pa.array(np.zeros(windows, np.int64)))
                places = row.column("at").to_numpy() + np.arange(windows)
                hashes = [hashlib.blake2b(raw[w : w + length], digest_size=16).digest() for w in range(windows)]
                yield pa.record_batch(
                    [*[row.column(c) for c in ("id", "k1", "k2")], pa.array(places), pa.array(hashes, pa.binary())],
                    names=["id", "k1", "k2", "at", "window"],
                )

    each = cut.select("id", "k1", "k2", "at", "windows", "bytes").mapInArrow(
        run, f"id {kind}, k1 long, k2 long, at long, window binary"
    )
    place = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2", "at")
    counted = each.groupBy("window").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    met = each.join(counted, "window")
    if keep == "first":
        met = met.filter(place != F.col("first"))
    return met.select("k1", "k2", "at", F.lit(1).alias("windows"))


def repeats(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: str = "first", hot: int = HOT) -> DataFrame:
    """`k1`, `k2`, `at`, `windows`: runs of window starts in a text that are to be removed; from `id`, `k1`, `k2`, `text`."""
    # anchors written first: a join of two fresh shuffles can split a hot anchor, one onto an aggregate cannot
    known = written(_repeated_anchors(rows, length, gram), "anchors")
    met = written(_occurrences(rows, length, gram).join(known, "anchor"), "stretches")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2", "at", "windows")
    kinds = met.groupBy("anchor", "body").agg(F.sum("times").alias("times"), F.min(place).alias("first"))
    kinds = written(kinds, "kinds")

    # equal stretches: every window of all of them, or of all but the first
    copies = met.join(kinds.filter("times > 1").select("anchor", "body", "first"), ["anchor", "body"])
    if keep == "first":
        same = (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2")) & (F.col("at") == F.col("first.at"))
        copies = copies.filter(~same)
    copies = copies.select("k1", "k2", "at", "windows")

    # different stretches of one anchor: the first of each kind stands for it
    lists = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("times").alias("fewest"))
    lists = lists.filter("kinds > 1" if keep == "first" else "kinds > 1 and fewest = 1").select("anchor", "kinds")
    wanted = kinds.join(lists, "anchor").select("anchor", "kinds", "first.id", "first.k1", "first.k2", "first.at", "first.windows")
    wanted = written(wanted, "wanted")
    texts = rows.select("k1", "k2", "text").dropDuplicates(["k1", "k2"])
    few, many = wanted.filter(F.col("kinds") <= hot), wanted.filter(F.col("kinds") > hot)
    groups = max(1, -(-few.count() // GROUP))
    found = _by_suffix_arrays(_cut_out(texts, few, length), groups, length, keep)
    if many.limit(1).count():
        found = found.union(_by_windows(cut_lineage(_cut_out(texts, many, length)), length, keep))
    return copies.union(found)


def _remove(raw: bytes, spans: list, length: int, whole_letters: bool) -> tuple[bytes, int, int]:
    """The bytes that stay, how many went, and in how many runs."""
    gone = np.zeros(len(raw) + 1, np.int32)
    for at, windows in spans:
        gone[at] += 1
        gone[at + windows + length - 1] -= 1
    flags = np.cumsum(gone[:-1]) > 0
    data = np.frombuffer(raw, np.uint8)
    if whole_letters:  # a letter goes if all its bytes do
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        flags = np.repeat(np.logical_and.reduceat(flags, starts), np.diff([*starts, len(data)]))
    first, _ = _runs(flags)
    return data[~flags].tobytes(), int(flags.sum()), len(first)


def changed_texts(rows: DataFrame, length: int, gram: int, keep: str, whole_letters: bool = False) -> DataFrame:
    """`k1`, `k2`, `kept` (binary), `n_removed`, `n_spans` of the texts that lose something."""
    spans = repeats(rows, length, gram, keep).distinct()
    spans = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "windows")).alias("spans"))
    texts = rows.select("k1", "k2", "text").dropDuplicates(["k1", "k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            kept, removed, counts = [], [], []
            for text, cuts in zip(block.column("text").to_pylist(), block.column("spans").to_pylist()):
                cuts = [(c["at"], c["windows"]) for c in cuts]
                left, n, runs = _remove(text.encode("utf-8", "surrogatepass"), cuts, length, whole_letters)
                kept.append(left)
                removed.append(n)
                counts.append(runs)
            yield pa.record_batch(
                [
                    block.column("k1"),
                    block.column("k2"),
                    pa.array(kept, pa.binary()),
                    pa.array(removed, pa.int64()),
                    pa.array(counts, pa.int64()),
                ],
                names=["k1", "k2", "kept", "n_removed", "n_spans"],
            )

    schema = "k1 long, k2 long, kept binary, n_removed long, n_spans long"
    return texts.join(spans, ["k1", "k2"]).mapInArrow(run, schema)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = pick(docs, id_col, text_col).toDF("id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.select("id", "text", *text_key(F.col("text")))


def remove_all(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """`id_col`, `n_bytes`, `n_removed`, `n_spans`, `kept_sha256` of every row, with no copy kept."""
    rows = _rows(docs, id_col, text_col)
    changed = changed_texts(rows, length, gram, "none")
    changed = changed.select("k1", "k2", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    raw = F.col("text").cast("binary")
    told = rows.select("id", "k1", "k2", F.length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("whole"))
    joined = told.join(changed, ["k1", "k2"], "left")
    return joined.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """All rows and columns of `docs`, their texts without what an earlier place holds already.

    Order is that of ids, then of places. Letters are only removed whole.
    """
    names = docs.columns
    rows = _rows(docs, id_col, text_col)
    # written first: what found it holds all texts in shuffle files, and so does the join below
    path = scratch_path(docs.sparkSession, "changed")
    changed_texts(rows, length, gram, "first", whole_letters=True).select("k1", "k2", "kept").write.parquet(path)
    changed = docs.sparkSession.read.schema("k1 long, k2 long, kept binary").parquet(path)
    firsts = rows.filter(F.length(F.col("text").cast("binary")) >= length).groupBy("k1", "k2")
    firsts = firsts.agg(F.min("id").alias("first_id"))
    kept = firsts.join(changed, ["k1", "k2"], "left")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    place, text = F.col(f"c{names.index(id_col)}"), F.col(f"c{names.index(text_col)}")
    keyed = plain.select("*", *text_key(F.coalesce(text, F.lit(""))))
    joined = keyed.join(kept, ["k1", "k2"], "left")
    first = F.col("first_id").isNull() | place.eqNullSafe(F.col("first_id"))
    fresh = F.when(~first, F.lit("")).when(F.col("kept").isNotNull(), F.decode("kept", "UTF-8")).otherwise(text)
    columns = [fresh.alias(f"c{i}") if n == text_col else F.col(f"c{i}") for i, n in enumerate(names)]
    return joined.select(columns).toDF(*names)
