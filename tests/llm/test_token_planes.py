import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from sieveline.llm import token_planes
from sieveline.llm.bpe import vocab_path
from sieveline.llm.byte_bpe import VOCAB, byte_bpe

SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(vocab_path(VOCAB))


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]


def test_byte_bpe_agrees_with_the_library():
    pick, bpe = random.Random(3), byte_bpe()
    parts = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'ll", "é", "漢", "1", "22", ".", ",", "!?", "\x1c", "\x85", "\u2003", "<|endoftext|>", "😀", "\u0301", "-", " \n", " the", "\r\n"]
    texts = ["".join(pick.choices(parts, k=pick.randint(0, 12))) for _ in range(3000)] + ["x" * 9000, " " * 5000, "word, " * 3000]
    for text in texts:
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == ids_of(text)[:-1], repr(text)


@pytest.mark.parametrize("kind", token_planes.KINDS)
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000, 70_000])
def test_planes_give_their_values_back(kind, n):
    values = np.random.default_rng(n).integers(0, 2**32, n).astype("<u4")
    if n:
        planes = token_planes.to_planes(values, kind)
        assert (token_planes.from_planes(planes, n, "<u4", kind) == values).all()
    doc_ids, lengths = [None, -5, 2**60], [n, 0, 0]
    ids, present, sizes, back = token_planes.unpack_segment(token_planes.pack_segment(doc_ids, lengths, values, kind, 4096))
    assert (back == values).all() and sizes.tolist() == lengths and present.tolist() == [0, 1, 1] and ids.tolist()[1:] == doc_ids[1:]


def test_query_agrees_with_the_library_on_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want, start = {}, 0
    for row in docs:
        ids = ids_of(row["text"])
        want[row["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = entry.queries()["op11_token_planes"](spark, SF).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("kind", token_planes.KINDS)
def test_nulls_repeats_long_texts_and_many_segments(spark, make_docs, tmp_path, kind):
    rows = [(5, "five six"), (None, "no id"), (3, None), (3, ""), (9, "same"), (9, "same"), (9, "same"), (1, "long word " * 5000), (None, None)]
    index = token_planes.write(make_docs(rows), f"file://{tmp_path}/out", kind=kind, block=64, segment_ids=16)
    got = token_planes.read(index).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 3, 3, 5, 9, 9, 9]
    assert sorted((repr(r["doc_id"]), r["ids"]) for r in got) == sorted((repr(i), ids_of(t)) for i, t in rows)
    ends = np.cumsum([0, *[len(r["ids"]) for r in got]])
    assert [r["start"] for r in got] == ends[:-1].tolist() and index.count() > 1


def test_empty_table(spark, make_docs, tmp_path):
    index = token_planes.write(make_docs([]), str(tmp_path / "out"))
    assert index.count() == 0 and token_planes.read(index).collect() == []


def test_files_without_a_row_in_the_index_do_not_count_and_damage_is_noticed(spark, make_docs, tmp_path):
    index = token_planes.write(make_docs([(1, "one"), (2, "two")]), str(tmp_path / "out"))
    (tmp_path / "out" / "part-000000-lost.planes").write_bytes(b"left by a lost task")
    assert token_planes.read(index).count() == 2
    name = index.first()["file"]
    data = bytearray(open(name, "rb").read())
    data[-1] ^= 1
    with open(name, "wb") as file:
        file.write(data)
    assert os.path.getsize(name) == len(data)
    with pytest.raises(Exception, match="damaged"):
        token_planes.read(index).agg(F.sum("start")).collect()
