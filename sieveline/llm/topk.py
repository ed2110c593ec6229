"""Exact top-k by exhaustive term-at-a-time accumulation.

Vectors are rows of integer weights over terms (their positions). Queries and
candidates are dealt into blocks; a pair of blocks holds the candidates as one
posting list per term. Every term of a query scatters its weight times the
posting weights into a dense array of scores, and a partition selection keeps
the best k of the block. The kept ones of all blocks merge into the exact
answer. Blocks of candidates are sent once for each block of queries, so what
moves grows with candidates x queries / block size, as the work itself does.

A vector that is null, or holds a null or a number that is not finite, takes no
part. Rows that repeat the same id and vector count once, and rows without an id
take no part; with `each_row` every row counts, a query's own row alone is not its
candidate, and rows without an id follow those of the same score that have one.
Vectors may differ in length; missing terms weigh 0. Ties go to the smaller id.
Sums are exact: where they could pass 64 bits they are worked out in Python's
integers, and a weight or a kept score that does not fit a long fails the job.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import pick

K = 5
CANDIDATES, QUERIES = 8192, 2048
"""Expected rows of a block."""
SCORES = 1 << 21
"""Scores held at once in a task."""
LONG = (1 << 63) - 1


def weights(vector: Column, scale: int = 256) -> Column:
    """Integer weights of a vector: floor(scale * x) for each component."""

    def one(x: Column) -> Column:
        scaled = F.lit(float(scale)) * x.cast("double")
        beyond = (F.abs(scaled) >= float(LONG)) & (F.abs(x.cast("double")) < float("inf"))
        return F.when(beyond, F.raise_error(F.lit("a weight does not fit a long")).cast("long")).otherwise(F.floor(scaled).cast("long"))

    return F.transform(vector, one)


def usable(vector: Column) -> Column:
    plain = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(plain(x), F.lit(False)))


def _postings(rows: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each term, the rows that hold it and their weights."""
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.fromiter((w for row in rows for w in row), np.int64, ends[-1])
    row = np.repeat(np.arange(len(rows)), np.diff(ends))
    term = np.arange(ends[-1]) - ends[:-1][row]
    held = flat != 0
    flat, row, term = flat[held], row[held], term[held]
    order = np.argsort(term, kind="stable")
    flat, row, term = flat[order], row[order], term[order]
    cuts = np.searchsorted(term, np.arange(max(map(len, rows), default=0) + 1))
    return [(row[a:b], flat[a:b]) for a, b in zip(cuts, cuts[1:])]


def _dot(a: list, b: list) -> int:
    return sum(x * y for x, y in zip(a, b))


def _wide(rows: list, terms: int) -> list[int]:
    """Rows with a weight whose products, summed over so many terms, could pass a long."""
    most = math.isqrt(LONG // max(1, terms))
    return [i for i, row in enumerate(rows) if row and max(max(row), -min(row)) > most]


def best_of_block(
    query_ids, query_rows, ids: list, rows: list, k: int, copies: list | None = None
) -> tuple[list, list, list, list]:
    """Per query (its place, id, score, copies) the k best candidates of the block, ties to the smaller id.

    Candidates with the query's id are left out. Where `copies` says how often every candidate
    occurs, the query's own row is one of the copies of its id and vector, and only that is left out.
    """
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    ids, rows = [ids[i] for i in order], [rows[i] for i in order]
    times = np.ones(len(ids), np.int64) if copies is None else np.array([copies[i] for i in order], np.int64)
    places: dict = {}
    for i, name in enumerate(ids):
        places.setdefault(name, []).append(i)
    terms = max(map(len, rows), default=0)
    wide, wide_queries = _wide(rows, terms), set(_wide(query_rows, terms))
    postings = _postings([[] if i in set(wide) else row for i, row in enumerate(rows)] if wide else rows)
    found: tuple[list, list, list, list] = ([], [], [], [])
    step = max(1, SCORES // max(1, len(ids)))
    for at in range(0, len(query_ids), step):
        part = query_rows[at : at + step]
        scores = np.zeros((len(part), len(ids)), np.int64)
        for term, (held, weight) in enumerate(postings):
            asked = [(i, row[term]) for i, row in enumerate(part) if term < len(row) and row[term] and at + i not in wide_queries]
            if not asked or not len(held):
                continue
            for i, w in asked:
                if len(held) == len(ids):
                    scores[i] += w * weight
                else:
                    scores[i, held] += w * weight
        for i, query in enumerate(query_ids[at : at + step]):
            same = places.get(query, [])
            left = times
            if same:
                left = times.copy()
                for j in same:
                    left[j] -= left[j] if copies is None else rows[j] == part[i]
            own, here = scores[i], np.flatnonzero(left > 0)
            if wide or at + i in wide_queries:
                exact = own.tolist()
                for j in range(len(ids)) if at + i in wide_queries else wide:
                    exact[j] = _dot(part[i], rows[j])
                best = heapq.nsmallest(k, here.tolist(), key=lambda j: (-exact[j], j))
                if any(abs(exact[j]) > LONG for j in best):
                    raise ValueError("a score does not fit a long")
            else:
                exact = own
                if len(here) > k:  # all that reach the k-th score, then the smallest ids of those
                    held = own[here]
                    bar = np.partition(held, len(held) - k)[len(held) - k]
                    here = here[held >= bar]
                best = here[np.lexsort((here, -own[here]))[:k]].tolist()
            found[0].extend([at + i] * len(best))
            found[1].extend(ids[j] for j in best)
            found[2].extend(int(exact[j]) for j in best)
            found[3].extend(min(int(left[j]), k) for j in best)
    return found


def top_k(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    weight_col: str = "weights",
    k: int = K,
    candidates: int = CANDIDATES,
    queries: int = QUERIES,
    each_row: bool = False,
) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score`: each query row's k best other rows by inner product."""
    rows = pick(vectors.withColumn("is_query", F.coalesce(is_query, F.lit(False))), id_col, weight_col, "is_query")
    rows = rows.toDF("id", "weights", "is_query").filter("weights is not null")
    if not each_row:
        rows = rows.filter("id is not null").distinct()
    asks = F.sum(F.col("is_query").cast("long"))
    rows = rows.groupBy("id", "weights").agg(F.count("*").alias("copies"), asks.alias("asks"))
    asking = F.count_if(F.col("asks") > 0)
    count = rows.agg(F.count("*").alias("n"), asking.alias("q")).first()
    across, down = max(1, -(-count.n // candidates)), max(1, -(-count.q // queries))
    # rows of one id are told apart by their vectors
    block = lambda n: F.pmod(F.xxhash64("id", "weights"), F.lit(n))
    left = rows.select("id", "weights", "copies", block(across).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("q"))
    version = F.row_number().over(Window.partitionBy("id").orderBy("weights"))
    asked = rows.filter("asks > 0").select(
        F.col("id").alias("query_id"), F.col("weights").alias("asked"), "asks", version.alias("version"), block(down).alias("q")
    )
    asked = asked.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))

    kinds = "query_id long, version int, asks long, vec_id long, score long, copies long"

    def scan(found: pa.Table, queries: pa.Table) -> pa.Table:
        place, ids, scores, copies = best_of_block(
            queries.column("query_id").to_pylist(),
            queries.column("asked").to_pylist(),
            found.column("id").to_pylist(),
            found.column("weights").to_pylist(),
            k,
            found.column("copies").to_pylist() if each_row else None,
        )
        asker = queries.select(["query_id", "version", "asks"]).take(pa.array(place, pa.int64()))
        best = [pa.array(x, pa.int64()) for x in (ids, scores, copies)]
        return pa.table([*asker.columns, *best], names=[c.split()[0] for c in kinds.split(", ")])

    pairs = left.groupBy("c", "q").cogroup(asked.groupBy("c", "q")).applyInArrow(scan, kinds)
    order = [F.desc("score"), F.asc_nulls_last("vec_id")]
    repeated = pairs.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))) if each_row else pairs
    asker = ["query_id", "version"] if each_row else ["query_id"]
    ranked = repeated.withColumn("rank", F.row_number().over(Window.partitionBy(*asker).orderBy(*order)))
    ranked = ranked.filter(F.col("rank") <= k)
    if each_row:  # rows of the same id and vector ask the same and get the same answer
        ranked = ranked.withColumn("_ask", F.explode(F.sequence(F.lit(1), F.col("asks"))))
    return ranked.select("query_id", "rank", "vec_id", "score")
