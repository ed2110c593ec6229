"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

One model learns how toxic texts spell, one how ordinary texts do. Letter counts
up to the full context (the word's letters so far, at most ORDER - 1) are kept
per class; below that both back off to the same continuation counts, so that an
expression that is rare in one class is judged by what both share. A word's
score is its toxic less its ordinary log-likelihood. For a spelling that neither
class has seen, what each keeps for new letters after its context is compared;
what they share below that cancels, and a new context says nothing.

Scores are normalised by length: the mean over the whole text, the highest mean
over a few neighbouring words, and what single words say beyond the ordinary, as
a sum on a log scale and against the text's length. So an insult counts the same in a
short and in a long text. A logistic curve, fitted on a bounded sample of
labelled texts, turns these into a probability. These texts are measured by
counts that have not seen them; the model itself counts all labelled training texts.

The evidence is a written table of any size. Texts are written once in packed
blocks that list the contexts of their words and the letters after each. These
meet the evidence in a join, and what it says travels back to the block, as
numbers alone: texts and spellings stay where they were written.

A null text is an empty one; texts without words have evidence 0 and get the
curve's value there. A row with a null id is scored, and is not held out. Labels
that are null count as missing, and several labels of one id count as toxic if
one does. Without any labels the curve's starting values apply. Extra columns are
ignored, and repeated rows are scored alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sieveline.llm.common import blocks, make_room, pick
from sieveline.session import scratch_path, shuffle_partitions

ORDER = 6
DISCOUNT = 0.75
WINDOW = 4
"""Neighbouring words of the local mean."""
STORED_BYTES = 16 << 20
"""Text of a stored block; the larger, the fewer contexts are listed twice."""
NEW = "*"
"""Stands for any letter not seen after a context; no word holds it."""
FOLDS, HELD_OUT, CURVE = 5, 0, 1
"""Folds by crc32 of the id; one is never learned from, one fits the curve by counts of the rest, and then is counted with them."""
CURVE_ROWS = 20_000
"""Labelled texts the curve is fitted on at most: those whose id hashes lowest."""
COUNTS = ("ordinary", "toxic", "fresh_ordinary", "fresh_toxic")
"""By class: in the folds that the curve's texts are measured by, and in the curve's own."""
MEASURES = ("mean", "peak", "excess", "density")
START = (-3.0, 0.0, 1.0, 0.0, 0.5)
"""Curve before it has seen labels: at 0 evidence, and per measure."""
CLIP, FROM, PEAK = 4.0, 2.0, 15.0
"""One word's say in sums lies in -2..CLIP, is beyond the ordinary above FROM, and in a peak counts up to PEAK."""

words_of = re.compile(r"[^\W_]{1,64}").findall


@dataclass
class Model:
    evidence: DataFrame | dict[str, float]
    """`gram`, `evidence`, written; empty without labels."""
    curve: tuple[float, ...]


@dataclass
class Stored:
    """Texts in written blocks: `block`, `body` (packed rows), `needed` (contexts with letters), `ids`, `keys` (of the texts).

    The table is bucketed by `block`: what joins it travels to the texts, which stay where they lie.
    """

    table: DataFrame
    fields: StructType
    """Of the packed rows."""


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Written in buckets of a key, under a name of its own in the session's catalog."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    out = df.write.format("parquet").option("compression", "zstd").option("path", path)
    out.bucketBy(shuffle_partitions(spark), key).saveAsTable(table)
    return spark.table(table)


def _packed(block: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(block)
    return sink.getvalue().to_pybytes()


def _needed(words: set[str]) -> pa.StructArray:
    """Contexts in the spellings of words, and the letters after each: one length of spelling at a time, in order."""
    contexts, followers, ends = [], [], [0]
    found: dict[int, set[str]] = defaultdict(set)
    for word in words:
        for gram in grams(word):
            found[len(gram)].add(gram)
    for size in sorted(found):
        last = None
        for gram in sorted(found.pop(size)):
            if gram[:-1] != last:
                last = gram[:-1]
                contexts.append(last)
                ends.append(ends[-1])
            followers.append(gram[-1])
            ends[-1] += 1
    letters = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(followers, pa.string()))
    return pa.StructArray.from_arrays([pa.array(contexts, pa.string()), letters], names=["context", "letters"])


def stored(rows: DataFrame) -> Stored:
    """Rows with `id`, `text` and others, written once; block numbers hold for what was written."""
    kind = rows.schema["id"].dataType.simpleString()
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        number = TaskContext.get().partitionId() << 32
        for block in blocks(batches, "text", STORED_BYTES):
            number += 1
            words: set[str] = set()
            for text in block.column("text"):
                words.update(words_of((text.as_py() or "").lower()))
            needed = _needed(words)
            words.clear()
            whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            yield pa.record_batch(
                [
                    pa.array([number], pa.int64()),
                    pa.array([_packed(block.select(names))], pa.binary()),
                    whole(needed),
                    whole(block.column("id")),
                    whole(block.column("key")),
                ],
                names=["block", "body", "needed", "ids", "keys"],
            )

    keyed = rows.withColumn("key", F.xxhash64("text"))
    schema = f"block long, body binary, needed array<struct<context:string,letters:array<string>>>, ids array<{kind}>, keys array<long>"
    return Stored(_bucketed(keyed.mapInArrow(run, schema), "texts", "block"), rows.schema)


def fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS


def grams(word: str, order: int = ORDER) -> list[str]:
    """Each letter of a word, and its end, after its full context."""
    spelled = f"^{word}$"
    return [spelled[max(0, i - order + 1) : i + 1] for i in range(1, len(spelled))]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text"):
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for text, toxic in zip(block.column("text").to_pylist(), block.column("toxic").to_pylist()):
            counts[toxic].update(words_of((text or "").lower()))
        found = list(counts[0].keys() | counts[1].keys())
        yield pa.record_batch(
            [pa.array(found, pa.string()), *[pa.array([c[w] for w in found], pa.int64()) for c in counts]],
            names=["word", "ordinary", "toxic"],
        )


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ordinary: Counter = Counter()
        toxic: Counter = Counter()
        for word, a, b in zip(*[batch.column(n).to_pylist() for n in ("word", "ordinary", "toxic")]):
            for gram in grams(word):
                ordinary[gram] += a
                toxic[gram] += b
        found = list(ordinary)
        yield pa.record_batch(
            [pa.array(found, pa.string()), *[pa.array([c[g] for g in found], pa.int64()) for c in (ordinary, toxic)]],
            names=["gram", "ordinary", "toxic"],
        )


def count_grams(labelled: DataFrame) -> DataFrame:
    """`gram`, `ordinary`, `toxic`: how often each class spells it; from `text` and `toxic` (0 or 1)."""
    words = labelled.mapInArrow(_count_words, "word string, ordinary long, toxic long")
    words = words.groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    spelled = words.mapInArrow(_count_grams, "gram string, ordinary long, toxic long")
    return spelled.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def evidence(counted: DataFrame) -> DataFrame:
    """`gram`, `evidence` (toxic less ordinary log-likelihood) and `weight`, by Kneser-Ney smoothing with shared backoff."""
    d = F.lit(DISCOUNT)
    rows = counted.withColumns(
        {
            "context": F.expr("left(gram, length(gram) - 1)"),
            "short": F.expr("right(gram, 3)"),
        }
    )
    # shared: in how many full contexts, of either class, a letter follows two others
    short = rows.groupBy("short").agg(F.count("*").alias("n"))
    short = short.withColumns({"before": F.expr("left(short, length(short) - 1)"), "letter": F.expr("right(short, 1)")})
    before = short.groupBy("before").agg(F.sum("n").alias("before_n"), F.count("*").alias("before_kinds"))
    letters = short.groupBy("letter").agg(F.count("*").alias("letter_n"))
    every = letters.agg(F.sum("letter_n").alias("n")).scalar()
    alone = letters.select("letter", (F.col("letter_n") / every).alias("alone"))
    shared = short.join(before, "before").join(alone, "letter")
    shared = shared.select(
        "short",
        (
            (F.greatest(F.col("n") - d, F.lit(0.0)) + d * F.col("before_kinds") * F.col("alone")) / F.col("before_n")
        ).alias("shared"),
    )
    contexts = rows.groupBy("context").agg(
        *[F.sum(c).alias(f"{c}_n") for c in ("ordinary", "toxic")],
        *[F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds") for c in ("ordinary", "toxic")],
    )
    joined = rows.join(shared, "short").join(contexts, "context")

    def chance(c: str) -> Column:
        kept = F.greatest(F.col(c) - d, F.lit(0.0)) + d * F.col(f"{c}_kinds") * F.col("shared")
        return F.when(F.col(f"{c}_n") > 0, kept / F.col(f"{c}_n")).otherwise(F.col("shared"))

    said = F.log(chance("toxic")) - F.log(chance("ordinary"))
    told = joined.select("gram", "ordinary", "toxic", said.alias("evidence"))
    weight = (F.col("ordinary") + F.col("toxic")) * F.abs("evidence")
    return told.select("gram", "evidence", weight.alias("weight"))


def backoff(counted: DataFrame) -> DataFrame:
    """`gram` (a context and NEW) and `evidence`: what each class keeps for letters it has not seen there, toxic over ordinary."""
    names = ("ordinary", "toxic")
    contexts = counted.groupBy(F.expr("left(gram, length(gram) - 1)").alias("context")).agg(
        *[F.sum(c).alias(c) for c in names], *[F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds") for c in names]
    )
    left = lambda c: F.when(F.col(c) > 0, DISCOUNT * F.col(f"{c}_kinds") / F.col(c)).otherwise(F.lit(1.0))
    return contexts.select(F.concat("context", F.lit(NEW)).alias("gram"), (F.log(left("toxic")) - F.log(left("ordinary"))).alias("evidence"))


def _table(counted: DataFrame, capacity: int | None) -> DataFrame | dict[str, float]:
    """All evidence of counted spellings, written; with a capacity, the heaviest spellings alone."""
    if capacity is not None:
        return _heaviest(evidence(counted), capacity)
    if not counted.limit(1).count():
        return {}
    return _written(evidence(counted).select("gram", "evidence").union(backoff(counted)), "evidence")


def _heaviest(told: DataFrame, capacity: int) -> dict[str, float]:
    """At most `capacity` spellings, those whose evidence weighs most; equal weights go together."""
    told = told.filter("weight > 0").withColumn("size", F.floor(F.log2("weight") * 8).cast("int"))
    left, least = capacity, None
    for size, n in sorted(((r["size"], r["count"]) for r in told.groupBy("size").count().collect()), reverse=True):
        left -= n
        if left < 0:
            break
        least = size
    if least is None:
        return {}
    kept = told.filter(F.col("size") >= least).select("gram", "evidence").toArrow()
    return dict(zip(kept.column("gram").to_pylist(), kept.column("evidence").to_pylist()))


def said_of(needed: DataFrame, evidence: DataFrame, told: tuple[str, ...] = ("context", "letters")) -> DataFrame:
    """`block` and `said` (per known context: what is told of it, its letters' evidence), from `block`, `context`, `letters`.

    A letter not seen after a context that is known has the evidence of NEW there.
    """
    entry = F.struct(F.expr("right(gram, 1)").alias("letter"), "evidence")
    known = evidence.groupBy(F.expr("left(gram, length(gram) - 1)").alias("context"))
    known = known.agg(F.map_from_entries(F.collect_list(entry)).alias("known"))
    new = F.coalesce(F.try_element_at("known", F.lit(NEW)), F.lit(0.0))
    values = F.transform("letters", lambda x: F.coalesce(F.try_element_at("known", x), new))
    met = needed.join(known, "context").select("block", *told, values.alias("values"))
    return met.groupBy("block").agg(F.collect_list(F.struct(*told, "values")).alias("said"))


class _WordScores(dict):
    """Scores of the words of one block, from its contexts with letters and what is said of them."""

    def __init__(self, needed, said):
        super().__init__()
        self.evidence: dict[str, float] = {}
        if said is not None:
            for start in range(0, len(said), 20_000):  # a part at a time, lest all of it lies twice in memory
                part = said.slice(start, 20_000)
                asked = needed.take(part.field("at"))
                columns = asked.field("context"), asked.field("letters"), part.field("values")
                for context, letters, values in zip(*[c.to_pylist() for c in columns]):
                    for letter, value in zip(letters, values):
                        self.evidence[context + letter] = value

    def __missing__(self, word: str) -> float:
        of = self.evidence
        score = self[word] = sum([of.get(g, 0.0) for g in grams(word)])
        return score


def measure(text: str | None, scores: dict[str, float]) -> tuple[float, float, float, float]:
    """MEASURES of a text; one shorter than WINDOW words has a peak as if it were that long."""
    values = np.array([scores[w] for w in words_of((text or "").lower())])
    n = len(values)
    if not n:
        return 0.0, 0.0, 0.0, 0.0
    sums = np.concatenate([[0.0], np.cumsum(np.minimum(values, PEAK))])
    peak = (sums[WINDOW:] - sums[:-WINDOW]).max() if n > WINDOW else sums[-1]
    clipped = np.clip(values, -2.0, CLIP)
    excess = float(np.maximum(clipped - FROM, 0.0).sum())
    return float(clipped.mean()), float(peak) / WINDOW, math.log1p(excess), excess / math.sqrt(n)


def _measured(
    texts: Stored, evidence: DataFrame | dict[str, float], curve: tuple | None, with_text: bool = False
) -> DataFrame:
    """The other columns (or all) of the packed rows and, of each text, its measures, or the curve's value if there is one."""
    blocked, names = texts.table, [f.name for f in texts.fields]
    kept = [n for n in names if with_text or n != "text"]
    if isinstance(evidence, dict):
        evidence = blocked.sparkSession.createDataFrame(list(evidence.items()), "gram string, evidence double")
    needed = blocked.select("block", F.posexplode("needed").alias("at", "n")).select("block", "at", "n.context", "n.letters")
    said = said_of(needed, evidence, ("at",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, needed, told in zip(*[batch.column(c) for c in ("body", "needed", "said")]):
                scores = _WordScores(needed.values, told.values)
                block = pa.ipc.open_stream(body.as_buffer()).read_next_batch()
                found = [measure(t, scores) for t in block.column("text").to_pylist()]
                columns = [[bend(curve, f) for f in found]] if curve else zip(*found)
                arrays = [block.column(n) for n in kept] + [pa.array(c, pa.float64()) for c in columns]
                yield pa.record_batch(arrays, names=kept + (["score"] if curve else list(MEASURES)))

    added = {"score": "double"} if curve else dict.fromkeys(MEASURES, "double")
    fields = StructType([f for f in texts.fields if f.name in kept])
    for name, kind in added.items():
        fields = fields.add(name, kind)
    rows = blocked.select("block", "body", "needed").join(said, "block", "left").select("body", "needed", "said")
    return rows.mapInArrow(run, fields)


def bend(curve: tuple[float, ...], measures: tuple[float, ...]) -> float:
    odds = curve[0] + sum(c * m for c, m in zip(curve[1:], measures))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))


def fit_curve(measures: np.ndarray, labels: np.ndarray, pull: float = 0.3, rounds: int = 40) -> tuple[float, ...]:
    """Ridge logistic fit around START, by Newton steps of bounded length."""
    curve = start = np.array(START)
    if len(labels):
        x = np.column_stack([np.ones(len(labels)), measures])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
            slope = x.T @ (labels - p) - pull * (curve - start)
            curvature = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(start))
            step = np.linalg.solve(curvature, slope)
            curve = curve + step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
    return tuple(float(v) for v in curve)


def _labelled(texts: Stored, marks: DataFrame) -> DataFrame:
    """`gram` and COUNTS per block of marked texts, and `text`, `toxic` of those the curve is fitted on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, marked in zip(batch.column("body"), batch.column("marks").to_pylist()):
                said = pa.ipc.open_stream(body.as_buffer()).read_next_batch().column("text").to_pylist()
                words = [Counter() for _ in COUNTS]
                out: list[tuple] = []
                for m in marked:
                    text = said[m["at"]] or ""
                    words[2 * m["fresh"] + m["toxic"]].update(words_of(text.lower()))
                    if m["fits"]:
                        out.append((None, 0, m["toxic"], 0, 0, text))
                counts: dict[str, list[int]] = {}
                for i, of in enumerate(words):
                    for word, n in of.items():
                        for gram in grams(word):
                            counts.setdefault(gram, [0, 0, 0, 0])[i] += n
                out += [(gram, *n, None) for gram, n in counts.items()]
                kinds = [pa.string(), *[pa.int64()] * 4, pa.string()]
                columns = zip(*out) if out else [()] * len(kinds)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["gram", *COUNTS, "text"])

    by_block = marks.groupBy("block").agg(F.collect_list(F.struct("at", "toxic", "fresh", "fits")).alias("marks"))
    joined = texts.table.select("block", "body").join(by_block, "block").select("body", "marks")
    schema = ", ".join(["gram string", *[f"{c} long" for c in COUNTS], "text string"])
    return _written(joined.mapInArrow(run, schema), "counts")


def learn(
    texts: Stored, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", capacity: int | None = None
) -> Model:
    """Learn from all labelled texts outside the held-out fold; `id_col` is that of the labels.

    The driver gets the measures of CURVE_ROWS texts, and of spellings none, or at most `capacity`.
    """
    row = F.posexplode(F.arrays_zip("ids", "keys")).alias("at", "row")
    rows = texts.table.select("block", row).select("block", "at", F.col("row.ids").alias("id"), F.col("row.keys").alias("key"))
    rows = rows.withColumn("fold", fold(F.col("id"))).filter(F.col("fold") != HELD_OUT)
    said = pick(labels, id_col, label_col).toDF("id", "toxic").filter("id is not null and toxic is not null")
    said = said.groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    # all labels take part, so their number has no bound; the same join at every size
    marks = rows.join(said.hint("merge"), "id").withColumn("fresh", F.col("fold") == CURVE)
    marks = _written(marks.select("block", "at", "id", "key", "toxic", "fresh"), "marks")
    fits = marks.filter("fresh").orderBy(F.xxhash64("id"), "id", "key", "block", "at").limit(CURVE_ROWS)
    fits = fits.select("block", "at", F.lit(True).alias("fits"))
    marks = marks.join(fits, ["block", "at"], "left").withColumn("fits", F.coalesce("fits", F.lit(False)))
    seen = _labelled(texts, marks)
    counted = seen.filter("gram is not null").groupBy("gram").agg(*[F.sum(c).alias(c) for c in COUNTS])
    counted = _written(counted, "spellings")
    others = _table(counted.filter("ordinary + toxic > 0").select("gram", "ordinary", "toxic"), capacity)
    both = counted.selectExpr("gram", "ordinary + fresh_ordinary as ordinary", "toxic + fresh_toxic as toxic")
    fitted = stored(seen.filter("text is not null").select(F.col("toxic").alias("id"), "text"))
    found = sorted(tuple(r) for r in _measured(fitted, others, None).collect())
    measures = np.array([r[1:] for r in found]).reshape(-1, len(MEASURES))
    curve = fit_curve(measures, np.array([r[0] for r in found], float))
    return Model(_table(both, capacity), curve)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    capacity: int | None = None,
) -> Model:
    """`learn` from documents that are not stored yet."""
    return learn(store(docs, id_col, text_col), labels, id_col, label_col, capacity)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> Stored:
    """Documents for `learn` and `judge`, with the columns to `keep` as `kept0`, `kept1` ..."""
    held = [f"kept{i}" for i in range(len(keep))]
    return stored(pick(docs, id_col, text_col, *keep).toDF("id", "text", *held))


def judge(texts: Stored, model: Model, with_text: bool = False) -> DataFrame:
    """`id`, `text` if wanted, the kept columns, and `score` of every row's whole text."""
    return _measured(texts, model.evidence, model.curve, with_text)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """`id_col`, the columns to `keep`, and `score` of every row's whole text."""
    return judge(store(docs, id_col, text_col, keep), model).toDF(id_col, *keep, "score")
