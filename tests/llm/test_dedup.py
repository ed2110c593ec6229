import hashlib
import random
import re

import numpy as np
import pytest

from sieveline.llm import ngram_join, rolling, suffix_dedup


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(n))


def shingles(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(found) < 5:
        return frozenset([tuple(found)]) if found else frozenset()
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4))


def test_shingle_sets_follow_the_words():
    texts = ["A b\tC d\x0be f", "a b c d e f", "a  b", "A B", "a\x1cb c", None, "", " \n", "b a", "É é x y z", "a b c d e a b c d e a"]
    found = ngram_join.shingle_sets(texts)
    want = [shingles(t) for t in texts]
    assert [len(f) for f in found] == [len(w) for w in want]
    for f, w in zip(found, want):
        for g, v in zip(found, want):
            assert len(np.intersect1d(f, g)) == len(w & v)


def near_corpus():
    rnd = random.Random(5)
    base = words(rnd, 150).split()
    rows = []
    for i in range(60):  # a group with edits at few or many places
        copy = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 5, 9])):
            copy[rnd.randrange(150)] = words(rnd, 1) + "x"
        rows.append(" ".join(copy))
    rows += [words(rnd, rnd.randint(1, 200)) for _ in range(60)]
    shared = words(rnd, 60)
    rows += [words(rnd, 80) + " " + shared for _ in range(25)]  # one passage, otherwise different
    rows += [words(rnd, 9) + " " + shared for _ in range(12)]  # nearly all passage
    rows += ["", " ", None, None, "two words", "Two  WORDS", "two word", rows[70], rows[70].upper(), rows[70].replace(" ", "\n")]
    chain = words(rnd, 100).split()
    for i in range(8):  # each links with the next alone
        rows.append(" ".join(chain))
        chain = chain[6:] + words(rnd, 6).split()
    ids = list(range(100, 100 + len(rows)))
    rnd.shuffle(ids)
    return [*zip(ids, rows), (ids[3], rows[3]), (None, rows[80]), (None, words(rnd, 30))]


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    smallest: dict = {}
    for i, (doc, _) in enumerate(rows):
        at = find(i)
        if doc is not None:
            smallest[at] = min(doc, smallest.get(at, doc))
    return [(doc, len(sets[i]), smallest.get(find(i))) for i, (doc, _) in enumerate(rows)]


def order(rows):
    return sorted(map(str, map(tuple, rows)))


def test_components_equal_brute_force(make_docs):
    rows = near_corpus()
    out = ngram_join.near_duplicates(make_docs(rows)).collect()
    assert order(out) == order(brute_components(rows))


def test_one_of_each_component_stays(make_docs):
    rows = near_corpus()
    docs = make_docs(rows)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    told = brute_components(rows)
    empty = sum(n == 0 for _, n, _ in told)
    ids = [r["doc_id"] for r in kept.collect()]
    full = {c for _, n, c in told if n and c is not None}
    assert len(ids) == empty + len(full) + sum(n > 0 and c is None for _, n, c in told)
    assert full <= set(ids)


def test_join_of_an_empty_table(make_docs):
    assert ngram_join.near_duplicates(make_docs([])).collect() == []
    assert ngram_join.keep_one(make_docs([])).collect() == []


def test_components_of_a_long_chain_and_a_star(spark):
    name = lambda i: b"%04d" % i
    edges = [(name(i), name(i + 1)) for i in range(40)] + [(name(500), name(500 + i)) for i in range(1, 50)]
    frame = spark.createDataFrame([(bytearray(b), bytearray(a)) for a, b in edges], "a binary, b binary")
    found = {bytes(r["key"]): bytes(r["root"]) for r in ngram_join.components(frame).collect()}
    assert found == {name(i): name(0) for i in range(41)} | {name(500 + i): name(500) for i in range(50)}


def test_factors_of_small_strings():
    rnd = np.random.default_rng(0)
    for _ in range(30):
        data = rnd.integers(0, 2, rnd.integers(20, 80)).astype(np.uint8)
        depth = 12
        starts = np.arange(len(data) - depth + 1)
        order_, common = suffix_dedup.suffix_order(data, starts, depth)
        text = data.tobytes()
        assert [text[i : i + depth] for i in order_] == sorted(text[i : i + depth] for i in starts)
        factors = suffix_dedup.previous_factors(order_.tolist(), common.tolist())
        for i in starts:
            want = 0
            for j in range(i):
                n = 0
                while n < depth and text[j + n] == text[i + n]:
                    n += 1
                want = max(want, n)
            assert factors[i] == want


def planted(rnd):
    passage, other = words(rnd, 130), words(rnd, 100)
    rows = [(i, words(rnd, rnd.randint(1, 150))) for i in range(30)]
    rows += [(100 + i, words(rnd, 5 + i) + passage + words(rnd, 5)) for i in range(6)]
    rows += [(200, other + other), (201, "ab" * 500), (202, "é" * 900), (203, None), (204, ""), (205, "ab" * 500)]
    rows += [(206, rows[0][1] + words(rnd, 120)), (206, rows[32][1]), (None, passage + "end"), (207, passage[:399])]
    rows += [(208 + i, words(rnd, 40) + passage[20:440] + words(rnd, 40)) for i in range(5)]
    return rows


def brute_removed(texts, length, earlier_only):
    seen: dict = {}
    for i, raw in enumerate(texts):
        for k in range(len(raw) - length + 1):
            seen.setdefault(raw[k : k + length], []).append((i, k))
    out = []
    for i, raw in enumerate(texts):
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            places = seen[raw[k : k + length]]
            if (places[0] != (i, k)) if earlier_only else len(places) > 1:
                gone[k : k + length] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_no_copy_kept_equals_brute_force(make_docs, monkeypatch, hot):
    # with hot=1 the windows of every anchor are counted one by one
    plain = suffix_dedup.repeats
    monkeypatch.setattr(suffix_dedup, "repeats", lambda *a, **k: plain(*a, **k, hot=hot))
    rows = planted(random.Random(8))
    texts = [(t or "").encode() for _, t in rows]
    want = []
    for (doc, _), raw, gone in zip(rows, texts, brute_removed(texts, 400, False)):
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        want.append((doc, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    assert order(suffix_dedup.remove_all(make_docs(rows)).collect()) == order(want)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_first_copy_stays(make_docs, monkeypatch, hot):
    plain = suffix_dedup.repeats
    monkeypatch.setattr(suffix_dedup, "repeats", lambda *a, **k: plain(*a, **k, hot=hot))
    rows = sorted((r for r in planted(random.Random(9)) if r[0] is not None and r[0] not in (205, 206)), key=lambda r: r[0])
    rows.append((300, rows[31][1]))  # a whole copy
    docs = make_docs(rows[::-1])
    out = suffix_dedup.keep_first(docs)
    assert out.columns == docs.columns
    found = {r["doc_id"]: r["text"] for r in out.collect()}
    texts = [(t or "").encode() for _, t in rows]
    for (doc, text), raw, gone in zip(rows, texts, brute_removed(texts, 400, True)):
        data = np.frombuffer(raw, np.uint8)
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        if len(starts):  # whole letters alone go
            gone = np.repeat(np.logical_and.reduceat(gone, starts), np.diff([*starts, len(raw)]))
        assert found[doc] == (None if text is None else data[~gone].tobytes().decode()), doc


def test_dedup_of_an_empty_table(make_docs):
    assert suffix_dedup.remove_all(make_docs([])).collect() == []
    assert suffix_dedup.keep_first(make_docs([])).collect() == []


def test_a_block_in_a_kernel_stays_small():
    import tracemalloc

    texts = ["".join(random.Random(i).choices("abcdefgh ", k=1000)) for i in range(600)]
    kernels = (
        (lambda: suffix_dedup.stretches([t.encode() for t in texts]), suffix_dedup.BLOCK, 60),
        (lambda: ngram_join.shingle_sets(texts), ngram_join.BLOCK, 30),
    )
    for kernel, block, most_mb in kernels:
        kernel()  # powers are kept from here on
        tracemalloc.start()
        kernel()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak / 600_000 * block < most_mb * 1e6


def test_blocks_of_many_texts_reuse_the_powers():
    """A block of 2^20 bytes and the white space between its texts makes no powers anew; neighbours in a block stay apart."""
    longer, shorter = (rolling.powers(ngram_join.BLOCK + k) for k in (900, 500))
    assert np.shares_memory(longer, shorter)
    texts = ["a b c d e f", "a b c d e f", "", "a b c d e a b c d e a", None, "a b c d e f", "a"]
    together, alone = ngram_join.shingle_sets(texts), [ngram_join.shingle_sets([t])[0] for t in texts]
    assert [len(s) for s in together] == [2, 2, 0, 5, 0, 2, 1]
    for one, other in zip(together, alone):
        np.testing.assert_array_equal(one, other)
        np.testing.assert_array_equal(one, np.unique(one))


def test_tables_between_steps_are_written_small_and_go_with_the_stage(spark, make_docs, tmp_path, monkeypatch):
    from sieveline import session

    monkeypatch.setattr(session, "_shared_folder", lambda spark, name: str(tmp_path))
    passage = "".join(random.Random(5).choices("abcdefgh ", k=900))
    docs = make_docs([(1, "x" + passage), (2, "y" + passage), (3, "z")])
    with session.passing_scratch(spark):
        kept = {r["doc_id"]: r["text"] for r in suffix_dedup.keep_first(docs).collect()}
        kinds = {p.name.split("-")[0] for p in tmp_path.iterdir()}
    assert kept == {1: "x" + passage, 2: "y", 3: "z"}
    assert {"anchors", "stretches", "kinds", "wanted"} <= kinds
    assert not list(tmp_path.iterdir())
