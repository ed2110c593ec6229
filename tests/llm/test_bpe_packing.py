import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sieveline.llm import bpe, packing


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCAB))


TEXTS = [
    "",
    "   \n",
    "Hello  World! it's 123 café",
    "a<|endoftext|>b <|startoftext|>x <|end",
    "$$$ lle### don't I'LL ....",
    "ΑΣ Σ straße İstanbul ǅ \x1c a\x1fb\x07c",
    "日本語 नमस्ते é  x　y ᠎",
    "ab" * 4000,
    "x" * 700,
]


def test_words_encode_as_the_library_does(library):
    rnd = random.Random(3)
    letters = "aeinthrsoul'.!# éß1"
    texts = TEXTS + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(3000)]
    found = bpe.word_bpe().encode(texts)
    wanted = library.encode_batch(texts, add_special_tokens=False)
    for text, ids, want in zip(texts, found, wanted):
        assert np.frombuffer(ids, "<i4").tolist() == want.ids, text
        assert bpe.word_bpe().decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_recent_keeps_what_is_asked_for_again():
    known = bpe.Recent(2)
    for text in ("a", "b", "c"):
        assert known.missing({text}) == [text]
        known.now[text] = b"1"
    assert known.missing({"a"}) == []  # moved over from the older half
    assert known.missing({"d"}) == ["d"]


def test_small_memory_changes_nothing():
    rnd = random.Random(5)
    texts = [" ".join("".join(rnd.choice("aeint.") for _ in range(rnd.randint(1, 5))) for _ in range(80)) for _ in range(60)]
    want = bpe.word_bpe().encode(texts)
    small = bpe.WordBpe(bpe.vocab_path(bpe.VOCAB))
    small.known, small.spelt = bpe.Recent(30), bpe.Recent(20)
    assert [ids for text in texts for ids in small.encode([text])] == want


def test_encode_decode_rows(make_docs, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "with no id"), (3, None), (2, TEXTS[2]), (2, TEXTS[2])]
    out = bpe.encode_decode(make_docs(rows)).collect()
    assert len(out) == len(rows)
    by_text = sorted((str(r["doc_id"]), list(r["ids"]), r["decoded"]) for r in out)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), ids, library.decode(ids, skip_special_tokens=False)))
    assert by_text == sorted(want)
    assert bpe.encode_decode(make_docs([])).collect() == []


@pytest.mark.parametrize("window", [8, 2048])
def test_best_fit_takes_the_tightest_room(window):
    rnd = random.Random(window)
    lengths = sorted((rnd.randint(1, window) for _ in range(500)), reverse=True)
    rooms: list[int] = []
    for length, (at, offset) in zip(lengths, packing.best_fit(lengths, window)):
        fits = [r for r in rooms if r >= length]
        if fits:
            assert rooms[at] == min(fits)
        else:
            assert at == len(rooms)
            rooms.append(window)
        assert offset == window - rooms[at]
        rooms[at] -= length


def test_packed_pieces_hold_every_id_once(make_docs, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, None), (2, TEXTS[2]), (2, TEXTS[2]), (None, "no id")]
    rows += [(100 + i, "word " * (37 * i % 900)) for i in range(60)]
    out = packing.pack(make_docs(rows)).collect()
    windows: dict = {}
    counted: dict = {}
    for r in out:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        counted[r["doc_id"]] = counted.get(r["doc_id"], 0) + r["length"]
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    want: dict = {}
    for i, t in rows:
        want[i] = want.get(i, 0) + len(library.encode(t or "", add_special_tokens=False).ids) + 1
    assert counted == want
    ids = library.encode(TEXTS[7], add_special_tokens=False).ids + [1]
    for r in out:
        if r["doc_id"] == 7:
            piece = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert zlib.crc32(piece) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
    assert packing.pack(make_docs([])).collect() == []


def test_sequences_are_the_padded_windows(make_docs, library):
    docs = make_docs([(1, "one two three"), (2, "four five")])
    placed = packing.place(packing.cut(docs, window=16, with_ids=True), window=16)
    rows = packing.sequences(placed, window=16, padding=0).collect()
    a, b = (library.encode(t, add_special_tokens=False).ids + [1] for t in ("one two three", "four five"))
    assert [r["ids"] for r in rows] == [a + b + [0] * (16 - len(a) - len(b))]


def test_packing_leaves_words_to_the_library():
    import random
    import time

    from sieveline.llm.bpe import library_bpe, word_bpe

    rnd = random.Random(3)
    texts = [" ".join("".join(rnd.choices("abcdefghijklmnoprstuvwz", k=rnd.randint(2, 14))) for _ in range(2000)) for _ in range(15)]
    odd = ["", "It's 1,234.5 <|endoftext|>x", "Émile\x1cNaïve ﬁ", "日本語 \u0645\u0631", "a" * 3000, "\U0001f600 ok\u3000end", "don\u2019t"]
    fast, trie, library = library_bpe(), word_bpe(), library_bpe().library
    for text, ids in zip(odd + texts[:2], fast.encode(odd + texts[:2])):
        assert np.frombuffer(ids, "<i4").tolist() == library.encode(text, add_special_tokens=False).ids
    spent = []
    for bpe in (fast, trie):
        start = time.process_time()
        found = bpe.encode(texts)
        spent.append(time.process_time() - start)
    assert found == fast.encode(texts) and spent[0] < 0.85 * spent[1]
