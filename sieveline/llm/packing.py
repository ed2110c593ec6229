"""Packing documents into windows of tokens by best-fit decreasing.

A document's ids and a closing id are cut into full windows, and the rest is
one shorter piece. Pieces are dealt into groups of a bounded expected size; in
each group the longest piece is placed first, always into the open window with
the least room that still holds it. A segment tree over the room left (0 to the
window's size) finds that window in a few steps.

A null text is an empty one, which is a piece of the closing id alone. Rows that
repeat a document are packed as often as they come, wherever they land. Only the
id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.bpe import VOCAB, library_bpe
from sieveline.llm.common import blocks, pick, with_fields
from sieveline.session import cut_lineage

WINDOW = 2048
CLOSING_ID = 1
GROUP_PIECES = 4096
"""Pieces packed together, on average; the number of groups follows the number of pieces."""


def cut(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocab: str = VOCAB,
    window: int = WINDOW,
    closing: int = CLOSING_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most `window` ids: `id_col`, `start`, `length`, `ids_crc32`, `doc_tokens`, `part` and, if asked for, `ids`.

    `part` numbers the rows of a task, and tells repeated documents apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = library_bpe(vocab)
        last = np.int32(closing).tobytes()
        part = 0
        for block in blocks(batches, "text"):
            rows, starts, lengths, crcs, totals, parts, ids = [], [], [], [], [], [], []
            for row, coded in enumerate(bpe.encode([t or "" for t in block.column("text").to_pylist()])):
                coded += last
                total = len(coded) // 4
                for start in range(0, total, window):
                    piece = coded[4 * start : 4 * (start + window)]
                    rows.append(row)
                    starts.append(start)
                    lengths.append(len(piece) // 4)
                    crcs.append(zlib.crc32(piece))
                    totals.append(total)
                    parts.append(part)
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<i4"))
                part += 1
            columns = [block.column("id").take(pa.array(rows, pa.int32()))]
            columns += [pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals, parts)]
            columns += [pa.array(ids, pa.list_(pa.int32()))] * with_ids
            yield pa.record_batch(columns, names=names)

    rows = pick(df, id_col, text_col).toDF("id", "text")
    kinds = [("id", rows.schema["id"].dataType.simpleString())]
    kinds += [(n, "long") for n in ("start", "length", "ids_crc32", "doc_tokens", "part")]
    kinds += [("ids", "array<int>")] * with_ids
    names = [n for n, _ in kinds]
    out = rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds))
    return out.withColumnRenamed("id", id_col)


class RoomTree:
    """Open windows by the room they have left: a segment tree of counts over 0..size."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, change: int) -> None:
        node = room + self.leaves
        while node:
            self.counts[node] += change
            node >>= 1

    def put(self, window: int, room: int) -> None:
        self.open[room].append(window)
        self._add(room, 1)

    def tightest(self, length: int) -> int | None:
        """The least room of at least `length` that some open window has."""
        counts, node = self.counts, length + self.leaves
        if counts[node]:
            return length
        while node > 1:
            if not node & 1 and counts[node + 1]:  # the sibling to the right holds larger rooms
                node += 1
                while node < self.leaves:
                    node *= 2
                    if not counts[node]:
                        node += 1
                return node - self.leaves
            node >>= 1
        return None

    def take(self, room: int) -> int:
        self._add(room, -1)
        return self.open[room].pop()


def best_fit(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window, offset) of each piece; the pieces come longest first."""
    tree, opened, out = RoomTree(window), 0, []
    for length in lengths:
        room = tree.tightest(length)
        if room is None:
            at, room, opened = opened, window, opened + 1
        else:
            at = tree.take(room)
        out.append((at, window - room))
        if room > length:
            tree.put(at, room - length)
    return out


def place(pieces: DataFrame, window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Give every piece its `sequence_id` and its `offset` there.

    `pieces` has the columns of `cut`, the id first, and any others. It is read
    twice; pass a written table or a checkpoint.
    """
    names = pieces.columns
    groups = max(1, -(-pieces.count() // group_pieces))
    schema = with_fields(pieces, sequence_id="long", offset="long")

    def pack(group: pa.Table) -> pa.Table:
        number = group.column("bin")[0].as_py()
        group = group.sort_by([("length", "descending"), *[(n, "ascending") for n in (names[0], "start", "ids_crc32", "part")]])
        placed = best_fit(group.column("length").to_pylist(), window)
        at = np.array(placed, np.int64).reshape(-1, 2)
        group = group.drop_columns(["bin"])
        group = group.append_column("sequence_id", pa.array((number << 32) + at[:, 0]))
        return group.append_column("offset", pa.array(at[:, 1]))

    dealt = pieces.withColumn("bin", F.pmod(F.xxhash64("part", "start", "length", *names[:1]), F.lit(groups)))
    return dealt.groupBy("bin").applyInArrow(pack, schema)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB, window: int = WINDOW):
    """Where every piece of every document goes: the columns of `cut` but `part`, `sequence_id` and `offset`."""
    return place(cut_lineage(cut(df, id_col, text_col, vocab, window)), window).drop("part")


def sequences(placed: DataFrame, window: int = WINDOW, padding: int = 0) -> DataFrame:
    """The packed windows themselves, from placed pieces that carry `ids`: `sequence_id`, `ids`, padded to the window."""
    joined = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.flatten(F.col("p.ids"))
    return joined.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(padding), window - F.size(ids))).alias("ids"))
