"""Media columns: text bytes as greyscale PNG in a binary column, read back with checks, and picture hashes.

A text's UTF-8 bytes, filled up with zeros to a positive multiple of 64, are the
rows of a picture 64 samples wide. It is written chunk by chunk with its
checksums, the rows filtered the way that leaves the smallest differences, and
zlib-compressed. Reading tests the signature, every checksum, the header and
the inflated size, and undoes the filters row by row with numpy. The feature is
a hash of low frequencies: block means on a 32 x 32 grid, a cosine transform, and
for each of the 8 x 8 lowest frequencies whether it lies above their median.

A null text is an empty one and gives a picture of one row of zeros. Equal texts
give equal bytes and features. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import blocks, pick, with_fields

WIDTH = 64
GRID, LOW = 32, 8

# The PNG signature, and 8-bit greyscale with no interlacing
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GREY8 = (8, 0, 0, 0, 0)
NONE, SUB, UP, AVERAGE, PAETH = range(5)

_angles = np.pi * (np.arange(GRID) + 0.5) / GRID
COSINES = np.cos(np.arange(LOW)[:, None] * _angles[None, :])


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def payload(text: str | None, width: int = WIDTH) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % width if raw else width)


def write_png(samples: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    """A greyscale PNG whose rows are the samples, each filtered by the difference with the smallest sum."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    left = np.zeros_like(rows)
    left[:, 1:] = rows[:, :-1]
    above = np.zeros_like(rows)
    above[1:] = rows[:-1]
    ways = np.stack([rows, rows - left, rows - above])
    cost = np.abs(ways.view(np.int8).astype(np.int16)).sum(axis=2)
    way = cost.argmin(axis=0)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = way
    lines[:, 1:] = ways[way, np.arange(len(rows))]
    header = struct.pack(">II5B", width, len(rows), *GREY8)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Samples of filtered rows (filter byte first). Runs of rows with one simple filter are undone at once."""
    kinds, body = lines[:, 0], lines[:, 1:]
    if kinds.max(initial=0) > PAETH:
        raise ValueError("unknown row filter")
    out = body.copy()
    sub = kinds == SUB
    out[sub] = np.cumsum(body[sub], axis=1, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for start, end in zip([0, *edges], [*edges, len(lines)]):
        kind = kinds[start]
        before = out[start - 1] if start else np.zeros(body.shape[1], np.uint8)
        if kind == UP:
            out[start:end] = before + np.cumsum(body[start:end], axis=0, dtype=np.uint8)
        elif kind in (AVERAGE, PAETH):
            for row in range(start, end):
                out[row] = _bent(body[row].tolist(), before.tolist(), kind)
                before = out[row]
    return out


def _bent(line: list[int], above: list[int], kind: int) -> list[int]:
    """One row whose prediction depends on its own earlier samples."""
    out: list[int] = []
    left = corner = 0
    for value, up in zip(line, above):
        if kind == AVERAGE:
            guess = (left + up) // 2
        else:
            slope = left + up - corner
            guess = min((left, up, corner), key=lambda near: abs(slope - near))
        left = (value + guess) & 255
        corner = up
        out.append(left)
    return out


def read_png(data: bytes) -> np.ndarray:
    """Rows of samples of an 8-bit greyscale PNG; ValueError where a checksum, a size or the format is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, header, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("cut chunk")
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) < size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            header = struct.unpack(">II5B", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if header is None or header[2:] != GREY8 or not ended:
        raise ValueError("not a whole 8-bit greyscale PNG")
    width, height = header[:2]
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if lines.size != height * (width + 1):
        raise ValueError("rows are missing")
    return unfilter(lines.reshape(height, width + 1))


def _means(values: np.ndarray, parts: int) -> np.ndarray:
    """Means along the first axis over `parts` equal stretches; short inputs repeat their rows."""
    n = len(values)
    if n < parts:
        return values[np.arange(parts) * n // parts]
    edges = np.arange(parts) * n // parts
    sums = np.add.reduceat(values, edges, axis=0)
    return sums / np.diff([*edges, n])[:, None]


def low_frequencies(rows: np.ndarray) -> bytes:
    """64 bits: which of the lowest cosine frequencies lie above their median."""
    small = _means(_means(rows.astype(np.float64), GRID).T, GRID).T
    waves = COSINES @ small @ COSINES.T
    return np.packbits((waves > np.median(waves)).ravel()).tobytes()


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """`id_col`, `n_bytes` and the `media` column (binary PNG) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            texts = block.column("text").to_pylist()
            sizes = pc.fill_null(pc.binary_length(block.column("text")), 0).cast(pa.int64())
            media = pa.array([write_png(payload(t, width), width) for t in texts], pa.binary())
            yield pa.record_batch([block.column("id"), sizes, media], names=["id", "n_bytes", "media"])

    rows = pick(df, id_col, text_col).toDF("id", "text")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def load(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Every column, the `payload` read back from the PNG, and its `picture_hash`."""
    others = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, media_col):
            read = [None if m is None else read_png(m) for m in block.column(media_col).to_pylist()]
            samples = pa.array([None if r is None else r.tobytes() for r in read], pa.binary())
            hashes = pa.array([None if r is None else low_frequencies(r) for r in read], pa.binary())
            yield pa.record_batch([*block.columns, samples, hashes], names=[*others, "payload", "picture_hash"])

    return df.mapInArrow(run, with_fields(df, payload="binary", picture_hash="binary"))


def digests(df: DataFrame) -> DataFrame:
    """Sizes, checksums and the feature of stored and reread media."""
    tail = F.expr("substring(payload, length(payload) - 63, 64)")
    return df.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("picture_hash")).alias("feature"),
    )
