"""Token ids on disk: fixed-size blocks of ids, transposed into bit or byte planes and compressed.

Documents are brought into the order of their ids by a range shuffle. Every task
encodes its stretch of documents and writes one file of segments. A segment
holds whole documents, about a million ids of them or one longer document: a
header, the chunk index (the compressed size of every plane of every block), and
the planes, each compressed with zstandard on its own. Document ids and lengths
are blocks of the same kind in front. A second index, a Parquet table with a row
per segment, says where each segment lies and what it holds; only files that it
names count, so attempts of tasks that were lost leave nothing that is read.

Ids are 32-bit. Planes that are zero in a whole block take a few bytes. Null
texts are empty ones and consist of the closing id alone; documents without an
id come first; documents that share an id keep an order by a hash of their texts,
and repeated rows are all written. An empty table gives an empty index. Only the
id and text columns are read; the id is an integer.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.byte_bpe import VOCAB, byte_bpe
from sieveline.llm.common import blocks, pick
from sieveline.session import scratch_path, shuffle_partitions

BLOCK_IDS = 1 << 16
SEGMENT_IDS = 1 << 20
CLOSING_ID = 0
LEVEL = 3
MAGIC = b"SVTP"
KINDS = ("byte", "bit")

_HEADER = struct.Struct("<4sBIQQ")  # magic, kind, ids per block, documents, ids
_INDEX = "part int, segment int, file string, at long, n_bytes long, n_docs long, n_ids long, crc32 long"


def to_planes(values: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block, least significant first: byte k, or bit k, of every value."""
    rows = values.view(np.uint8).reshape(len(values), values.itemsize)
    if kind == "bit":
        rows = np.unpackbits(rows, axis=1, bitorder="little")
        return [np.packbits(rows[:, k]).tobytes() for k in range(rows.shape[1])]
    return [rows[:, k].tobytes() for k in range(rows.shape[1])]


def from_planes(planes: list[bytes], n: int, dtype: str, kind: str) -> np.ndarray:
    """The values whose planes these are."""
    if kind == "bit":
        bits = [np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes]
        return np.packbits(np.stack(bits, axis=1), axis=1, bitorder="little").reshape(-1).view(dtype)
    rows = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    return np.ascontiguousarray(rows).reshape(-1).view(dtype)


def _plane_count(dtype: str, kind: str) -> int:
    return np.dtype(dtype).itemsize * (8 if kind == "bit" else 1)


def _cut(values: np.ndarray, block: int) -> Iterator[np.ndarray]:
    for at in range(0, len(values), block):
        yield values[at : at + block]


def pack_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, kind: str, block: int) -> bytes:
    """One segment as bytes: header, chunk index, planes of the columns id, id present, length, and of the ids."""
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    columns = [
        np.array([0 if i is None else i for i in doc_ids], "<i8"),
        np.array([i is not None for i in doc_ids], "u1"),
        np.array(lengths, "<u8"),
        ids,
    ]
    planes = [compress(p) for column in columns for part in _cut(column, block) for p in to_planes(part, kind)]
    sizes = np.array([len(p) for p in planes], "<u4").tobytes()
    header = _HEADER.pack(MAGIC, KINDS.index(kind), block, len(doc_ids), len(ids))
    return b"".join([header, sizes, *planes])


def unpack_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, which of them are there, lengths and all ids of a segment."""
    magic, kind, block, n_docs, n_ids = _HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment of token planes")
    kind = KINDS[kind]
    columns = [("<i8", n_docs), ("u1", n_docs), ("<u8", n_docs), ("<u4", n_ids)]
    count = sum(-(-n // block) * _plane_count(dtype, kind) for dtype, n in columns)
    sizes = np.frombuffer(data, "<u4", count, _HEADER.size).tolist()
    at, next_plane = _HEADER.size + 4 * count, iter(sizes)
    view, decompress = memoryview(data), zstandard.ZstdDecompressor().decompress
    out = []
    for dtype, n in columns:
        parts = [np.zeros(0, dtype)]
        for start in range(0, n, block):
            planes = []
            for _ in range(_plane_count(dtype, kind)):
                size = next(next_plane)
                planes.append(decompress(view[at : at + size]))
                at += size
            parts.append(from_planes(planes, min(block, n - start), dtype, kind))
        out.append(np.concatenate(parts))
    return tuple(out)


def _store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a folder or file, given as a path or with a scheme."""
    if "://" not in uri and not uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def write(
    df: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocab: str = VOCAB,
    closing: int = CLOSING_ID,
    kind: str = "byte",
    block: int = BLOCK_IDS,
    segment_ids: int = SEGMENT_IDS,
) -> DataFrame:
    """Write the ids of all documents, in the order of `id_col`, as files below `folder`; the table of their segments.

    `folder` must be reachable from all executors.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown planes: {kind}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, last = byte_bpe(vocab), struct.pack("<I", closing)
        part = TaskContext.get().partitionId()
        name = posixpath.join(folder, f"part-{part:06d}-{uuid.uuid4().hex}.planes")
        index: list[tuple] = []
        doc_ids: list[int | None] = []
        coded: list[bytes] = []
        held, out = 0, None

        def close_segment() -> None:
            nonlocal held, out
            if out is None:
                store, path = _store(name)
                store.create_dir(posixpath.dirname(path), recursive=True)
                out = store.open_output_stream(path)
            lengths = [len(c) // 4 for c in coded]
            ids = np.frombuffer(b"".join(coded), "<u4")
            data = pack_segment(doc_ids, lengths, ids, kind, block)
            index.append((part, len(index), name, out.tell(), len(data), len(doc_ids), len(ids), zlib.crc32(data)))
            out.write(data)
            doc_ids.clear()
            coded.clear()
            held = 0

        for rows in blocks(batches, "text"):
            for doc_id, text in zip(rows.column("id").to_pylist(), rows.column("text").to_pylist()):
                ids = bpe.encode(text or "") + last
                doc_ids.append(doc_id)
                coded.append(ids)
                held += len(ids) // 4
                if held >= segment_ids:
                    close_segment()
        if doc_ids:
            close_segment()
        if out is not None:
            out.close()
            kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 5]
            names = [f.split()[0] for f in _INDEX.split(", ")]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*index), kinds)], names=names)

    spark = df.sparkSession
    rows = pick(df, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    # repeated rows differ by their place, so they too spread over ranges
    order = [F.asc_nulls_first("id"), F.xxhash64("text"), F.col("place")]
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    path = posixpath.join(folder, "index")
    ranged.mapInArrow(run, _INDEX).write.parquet(path)
    return spark.read.parquet(path)


def with_starts(index: DataFrame) -> DataFrame:
    """The segments with `start`, the number of ids in all segments before: sums per file first, then inside each."""
    files = index.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = files.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))
    return index.join(files, "part").withColumn("start", start).drop("_before")


def read(index: DataFrame, id_col: str = "doc_id", as_bytes: bool = False) -> DataFrame:
    """All documents from their files: `id_col`, `start` (ids of all documents before) and `ids`.

    `ids` is an array, or with `as_bytes` the little-endian 32-bit ids one after
    the other. A segment whose bytes have changed fails the read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment in batch.to_pylist():
                store, path = _store(segment["file"])
                with store.open_input_file(path) as file:
                    data = file.read_at(segment["n_bytes"], segment["at"])
                if zlib.crc32(data) != segment["crc32"]:
                    raise OSError(f"{segment['file']}: segment {segment['segment']} is damaged")
                doc_ids, present, lengths, ids = unpack_segment(data)
                ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths.astype(np.int64))])
                flat = pa.py_buffer(ids.tobytes())
                if as_bytes:
                    offsets = pa.py_buffer((4 * ends).astype(np.int32).tobytes())
                    values = pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, offsets, flat])
                else:
                    flat = pa.Array.from_buffers(pa.int32(), len(ids), [None, flat])
                    values = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)
                yield pa.record_batch(
                    [pa.array(doc_ids, mask=present == 0), pa.array(segment["start"] + ends[:-1]), values],
                    names=["id", "start", "ids"],
                )

    # few, small rows that stand for much work: dealt out one by one, whatever their size
    dealt = with_starts(index).repartition(4 * shuffle_partitions(index.sparkSession), "part", "segment")
    out = dealt.mapInArrow(run, f"id long, start long, ids {'binary' if as_bytes else 'array<int>'}")
    return out.withColumnRenamed("id", id_col)


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB, kind: str = "byte") -> DataFrame:
    """Write to a fresh folder next to the checkpoints; the segments."""
    return write(df, scratch_path(df.sparkSession, "token-planes"), id_col, text_col, vocab, kind=kind)
