"""Phrase collocations, counted in burst tries over word ids.

Words first: blocks of texts carry their own numbering, the counts of all blocks
meet by word, and only words frequent enough to stand in a candidate get an id that
holds everywhere. A block then reads as stretches of such ids, and every place
gives the window of up to five ids that starts there.

Each task counts windows in a shallow trie of word ids whose leaves are hash
containers of the remaining ids. A container that grows too large bursts into
one per next id; a trie that grows too large spills whole subtrees, the largest
first, as sorted runs. Runs are dealt by prefix and merged per prefix partition,
which gives the count of every phrase that starts there. The prefix of a window
ends at its first word that is not heavy (a 512th of all words or more): no
partition key can then hold more than a 512th of all windows, unless they are
equal and were counted together before. Phrases of heavy words alone may be
counted in several partitions and are added up after.

Null texts are empty, a null language is `und`; repeated rows count as often as
they come; an empty table has no phrases. Only the text and language columns are
read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import blocks, pick
from sieveline.llm.rolling import mixed
from sieveline.session import cut_lineage, scratch_path, shuffle_partitions

LONGEST = 5
LEAST = 100
TOP = 2000
COVER = 100
HEAVY_SHARE = 512
BURST = 8192
MOST_ENTRIES = 400_000
BIN_WINDOWS = 1 << 20
"""Windows merged together, about; the number of bins follows the number of words."""

_LOWER_AND_CUT = bytes(
    10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
_NO_WORD, _BREAK = 0, 1


class _Numbers(dict):
    """Numbers of words in the order they are met."""

    def __init__(self):
        super().__init__({b"": _NO_WORD, b"\n": _BREAK})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _coded(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, how often each occurs, and the texts as numbers of words with breaks between pieces."""
    numbers = _Numbers()
    joined = b"\n".join(texts).translate(_LOWER_AND_CUT).replace(b"\n", b" \n ")
    words = joined.split(b" ")
    codes = np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))
    codes = codes[codes != _NO_WORD]
    return list(numbers)[2:], np.bincount(codes, minlength=len(numbers))[2:], codes


def word_blocks(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Texts of one language in blocks: `block`, `lang`, `words`, `counts`, and `codes`, the numbers of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in blocks(batches, "text"):
            by_lang: dict[str, list[bytes]] = {}
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for lang, text in zip(batch.column("lang").to_pylist(), texts):
                if text:
                    by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                words, counts, codes = _coded(own)
                if words:
                    yield pa.record_batch(
                        [
                            pa.array([block], pa.int64()),
                            pa.array([lang], pa.string()),
                            pa.array([[w.decode() for w in words]], pa.list_(pa.string())),
                            pa.array([counts], pa.list_(pa.int64())),
                            pa.array([codes.tobytes()], pa.binary()),
                        ],
                        names=["block", "lang", "words", "counts", "codes"],
                    )
                    block += 1

    rows = pick(df, text_col, lang_col).toDF("text", "lang").withColumn("lang", F.coalesce("lang", F.lit("und")))
    return rows.mapInArrow(run, "block long, lang string, words array<string>, counts array<long>, codes binary")


def frequent_words(parts: DataFrame, least: int) -> DataFrame:
    """`id`, `lang`, `word` and `f` of words that occur `least` times or more; ids are odd for heavy words."""
    rows = parts.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    counts = rows.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
    kept = cut_lineage(counts.where(F.col("f") >= least).withColumn("place", F.monotonically_increasing_id()))
    # dense numbers: those of the partitions before, then the place in the partition
    part, place = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    sizes = kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    total = parts.select(F.explode("counts").alias("c")).agg(F.sum("c")).scalar()
    heavy = (F.col("f") * HEAVY_SHARE >= total).cast("long")
    numbered = kept.withColumn("part", part).join(offsets, "part")
    return numbered.select((2 * (F.col("offset") + place + 1) + heavy).cast("int").alias("id"), "lang", "word", "f")


def windows_of(ids: np.ndarray, longest: int) -> np.ndarray:
    """Every window of two or more ids, cut at the first zero, as rows filled up with zeros."""
    padded = np.concatenate([ids, np.zeros(longest, np.uint32)])
    columns, goes_on = [ids], ids != 0
    for j in range(1, longest):
        shifted = padded[j : j + len(ids)]
        goes_on = goes_on & (shifted != 0)
        columns.append(np.where(goes_on, shifted, 0))
    rows = np.stack(columns, axis=1)
    return rows[columns[1] != 0].astype(np.uint32)


class BurstTrie:
    """Counts of windows under their first id; large containers burst into one per next id."""

    def __init__(self, longest: int, burst: int = BURST):
        self.longest, self.burst = longest, burst
        self.nodes: dict[int, Counter | dict[bytes, Counter]] = {}
        self.sizes: Counter = Counter()

    def __len__(self) -> int:
        return self.sizes.total()

    def add(self, windows: np.ndarray) -> None:
        windows = windows[np.argsort(windows[:, 0], kind="stable")]
        width = 4 * (self.longest - 1)
        rest = np.ascontiguousarray(windows[:, 1:].astype(">u4")).view(f"V{width}").reshape(-1).tolist()
        firsts, starts = np.unique(windows[:, 0], return_index=True)
        ends = [*starts[1:].tolist(), len(rest)]
        nodes, sizes, burst = self.nodes, self.sizes, self.burst
        for first, start, end in zip(firsts.tolist(), starts.tolist(), ends):
            node = nodes.get(first)
            if node is None:
                node = nodes[first] = Counter()
            if isinstance(node, Counter):
                node.update(rest[start:end])
                sizes[first] = len(node)
                if len(node) > burst:
                    nodes[first] = self._burst(node)
            else:
                self._count_below(node, first, rest[start:end])

    @staticmethod
    def _burst(container: Counter) -> dict[bytes, Counter]:
        children: dict[bytes, Counter] = {}
        for key, count in container.items():
            children.setdefault(key[:4], Counter())[key[4:]] = count
        return children

    def _count_below(self, node: dict[bytes, Counter], first: int, keys: list[bytes]) -> None:
        grown = 0
        for key in keys:
            child = node.get(key[:4])
            if child is None:
                child = node[key[:4]] = Counter()
            tail = key[4:]
            grown += tail not in child
            child[tail] += 1
        self.sizes[first] += grown

    def spill(self, down_to: int = 0) -> np.ndarray:
        """Take whole subtrees out, the largest first, until `down_to` entries are left: rows of ids and their count."""
        taken, left = [], len(self)
        for first, _ in self.sizes.most_common():
            if left <= down_to:
                break
            left -= self.sizes.pop(first)
            taken.append((first, self.nodes.pop(first)))
        runs = [self._run(first, node) for first, node in sorted(taken, key=lambda t: t[0])]
        return np.concatenate(runs) if runs else np.zeros((0, self.longest + 1), np.uint64)

    def _run(self, first: int, node: Counter | dict[bytes, Counter]) -> np.ndarray:
        if isinstance(node, Counter):
            entries = sorted(node.items())
        else:
            entries = [(head + tail, n) for head in sorted(node) for tail, n in sorted(node[head].items())]
        out = np.empty((len(entries), self.longest + 1), np.uint64)
        out[:, 0] = first
        out[:, 1:-1] = np.frombuffer(b"".join([k for k, _ in entries]), ">u4").reshape(len(entries), -1)
        out[:, -1] = [n for _, n in entries]
        return out


def prefix_bins(rows: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each window: by its ids up to the first that is not heavy (even)."""
    key, going = np.zeros(len(rows), np.uint64), np.ones(len(rows), bool)
    for j in range(rows.shape[1] - 1):
        column = rows[:, j]
        going = going & (column != 0)
        key = np.where(going, mixed(key * np.uint64(0x9E3779B97F4A7C15) + column), key)
        going = going & (column % np.uint64(2) == 1)
    return (key % np.uint64(bins)).astype(np.int64)


def _runs(rows: np.ndarray, bins: int) -> pa.RecordBatch:
    """Sorted rows as one compressed run per bin."""
    at = prefix_bins(rows, bins)
    order = np.argsort(at, kind="stable")  # rows of a bin stay sorted
    rows, at = rows[order], at[order]
    found, starts = np.unique(at, return_index=True)
    compress = zstandard.ZstdCompressor(level=1).compress
    ends = [*starts[1:].tolist(), len(rows)]
    data = [compress(np.ascontiguousarray(rows[s:e].T).tobytes()) for s, e in zip(starts.tolist(), ends)]
    return pa.record_batch([pa.array(found, pa.int64()), pa.array(data, pa.binary())], names=["bin", "run"])


def merged_counts(rows: np.ndarray, least: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Phrases of two words or more at the start of the windows, and their counts.

    A phrase with a word that is not heavy is whole here and left out below
    `least`; one of heavy words alone may go on in other bins.
    """
    longest = rows.shape[1] - 1
    rows = rows[np.lexsort([rows[:, j] for j in reversed(range(longest))])]
    phrases, counts = [], []
    new = np.ones(len(rows), bool)
    new[1:] = rows[1:, 0] != rows[:-1, 0]
    heavy = rows[:, 0] % 2 == 1
    for j in range(1, longest):
        new[1:] |= rows[1:, j] != rows[:-1, j]
        heavy = heavy & (rows[:, j] % 2 == 1)
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(rows[:, -1].astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
        keep = (rows[starts, j] != 0) & ((sums >= least) | heavy[starts])
        phrases += list(rows[starts[keep], : j + 1].astype(np.int32))
        counts.append(sums[keep])
    return phrases, np.concatenate(counts) if counts else np.zeros(0, np.int64)


def phrase_counts(parts: DataFrame, words: DataFrame, least: int, longest: int) -> DataFrame:
    """`ids` and `a` of all phrases of 2 to `longest` frequent words that occur `least` times or more."""
    spark = parts.sparkSession
    total = parts.select(F.explode("counts").alias("c")).agg(F.sum("c").alias("n")).first()["n"] or 0
    bins = max(shuffle_partitions(spark), -(-total // BIN_WINDOWS))
    own = parts.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w"))
    known = own.select("block", "lang", "at", F.col("w.words").alias("word")).join(words.select("lang", "word", "id"), ["lang", "word"])
    numbers = known.groupBy("block").agg(F.collect_list(F.struct("at", "id")).alias("m"))
    coded = parts.select("block", "codes").join(numbers, "block").select("codes", F.col("m.at").alias("at"), F.col("m.id").alias("id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie(longest)
        for batch in batches:
            for i in range(batch.num_rows):
                codes = np.frombuffer(batch.column("codes")[i].as_buffer(), np.uint32)
                at, ids = (batch.column(n)[i].values.to_numpy() for n in ("at", "id"))
                number = np.zeros(int(max(codes.max(), at.max() + 2)) + 1, np.uint32)
                number[at + 2] = ids  # 0 and 1 are no words
                trie.add(windows_of(number[codes], longest))
                if len(trie) > MOST_ENTRIES:
                    yield _runs(trie.spill(MOST_ENTRIES // 2), bins)
        if len(trie):
            yield _runs(trie.spill(), bins)

    def merge(group: pa.Table) -> pa.Table:
        decompress = zstandard.ZstdDecompressor().decompress
        runs = [np.frombuffer(decompress(r), np.uint64).reshape(longest + 1, -1).T for r in group.column("run").to_pylist()]
        phrases, counts = merged_counts(np.concatenate(runs), least)
        return pa.table({"ids": pa.array(phrases, pa.list_(pa.int32())), "n": pa.array(counts, pa.int64())})

    found = coded.mapInArrow(count, "bin long, run binary").groupBy("bin").applyInArrow(merge, "ids array<int>, n long")
    return found.groupBy("ids").agg(F.sum("n").alias("a")).where(F.col("a") >= least)


def floor_score(df: DataFrame) -> DataFrame:
    """Add `score`, floor(1000 a n / (l r)) in whole numbers of up to 38 digits."""
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    above = (whole("a") * whole("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")
    rows = df.withColumns({"_above": above.cast("decimal(38,0)"), "_below": (whole("l") * whole("r")).cast("decimal(38,0)")})
    return rows.withColumn("score", F.expr("_above div _below")).drop("_above", "_below")


def collocations(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    top: int = TOP,
    cover: int = COVER,
) -> DataFrame:
    """The `top` phrases of every language: `lang`, `rank`, `phrase`, `a`, `l`, `r`, `n` and `score`.

    `a` counts the phrase, `l` and `r` the parts at its weakest cut, `n` all words;
    the score is floor(1000 a n / (l r)). A phrase inside a longer one that occurs
    `cover` per cent as often, or more, is left out.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "word-blocks")
    word_blocks(df, text_col, lang_col).write.option("compression", "zstd").parquet(path)
    parts = spark.read.parquet(path)
    words = cut_lineage(frequent_words(parts, least))
    phrases = cut_lineage(phrase_counts(parts, words, least, longest))

    counted = words.select(F.array("id").alias("ids"), F.col("f").alias("a")).unionByName(phrases)
    inside = F.transform(
        F.sequence(F.lit(2), F.size("ids") - 1),
        lambda n: F.transform(F.sequence(F.lit(1), F.size("ids") - n + 1), lambda i: F.slice("ids", i, n)),
    )
    longer = phrases.where(F.size("ids") > 2).select(F.explode(F.flatten(inside)).alias("ids"), F.col("a").alias("c"))
    covered = longer.groupBy("ids").agg(F.max("c").alias("c"))
    kept = phrases.join(covered, "ids", "left").where(F.col("c").isNull() | (100 * F.col("c") < cover * F.col("a"))).drop("c")

    spelt = kept.select("ids", "a", F.posexplode("ids").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
    spelt = spelt.groupBy("ids", "a").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
    spelt = spelt.select("ids", "a", "lang", F.array_join("w.word", " ").alias("phrase"))
    sizes = parts.select("lang", F.explode("counts").alias("c")).groupBy("lang").agg(F.sum("c").alias("n"))

    cuts = F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k")
    cut = spelt.join(sizes, "lang").select("*", cuts)
    cut = cut.withColumns({"_l": F.slice("ids", 1, F.col("k")), "_r": F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k"))})
    for side in ("l", "r"):
        cut = cut.join(counted.select(F.col("ids").alias(f"_{side}"), F.col("a").alias(side)), f"_{side}")
    scored = floor_score(cut.select("lang", "phrase", "a", "n", "k", "l", "r"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "n", "b.l", "b.r", "b.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    for keys in (["lang", "salt"], ["lang"]):  # a language may hold most phrases: the first of each share, then of all
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return salted.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def check_sql(least: int = LEAST, longest: int = LONGEST, top: int = TOP, cover: int = COVER, documents: str = "documents") -> str:
    """DuckDB SQL for the same rows: every phrase of every piece is made and counted."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM {documents}
), lists AS (
  SELECT lang, w FROM (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM pieces) p WHERE len(w) > 0
), sizes AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY lang
), made AS (
  SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
  FROM lists, (SELECT unnest(range(1, {longest + 1})) AS k) s
  WHERE len(w) >= k
), f AS (
  SELECT lang, k AS size, phrase, count(*) AS a FROM made GROUP BY lang, k, phrase HAVING count(*) >= {least}
), cand AS (
  SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE size > 1
), covered AS (
  SELECT lang, phrase, max(c) AS c
  FROM (
    SELECT lang, a AS c, unnest([array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, size - m + 2)]) AS phrase
    FROM cand, (SELECT unnest(range(2, {longest})) AS m) s WHERE m < size
  ) x
  GROUP BY lang, phrase
), kept AS (
  SELECT cand.* FROM cand LEFT JOIN covered USING (lang, phrase) WHERE c IS NULL OR 100 * c < {cover} * a
), cuts AS (
  SELECT *, unnest(range(1, size)) AS k FROM kept
), scored AS (
  SELECT c.lang, c.phrase, c.a, n, c.k, x.a AS l, y.a AS r,
         CAST((CAST(1000 AS HUGEINT) * c.a * n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cuts c
  JOIN sizes USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')
), best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored) s WHERE place = 1
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) b
WHERE rank <= {top}
"""
