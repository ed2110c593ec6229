import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import collocations as co

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least, longest, top, cover):
    counts, sizes = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = [w for w in re.split("[ \t]", piece) if w]
            sizes[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = defaultdict(int)
        for p, c in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    covered[p[i : i + m]] = max(covered[p[i : i + m]], c)
        found = []
        for p, a in candidates.items():
            if p in covered and 100 * covered[p] >= cover * a:
                continue
            score, _, left, right = min((1000 * a * sizes[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def collected(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def frame(spark, rows):
    """Documents with columns that clash with the operator's own."""
    return spark.createDataFrame(
        [(t, g, 1, "x", "w", 2) for t, g in rows], "text string, lang string, block long, codes string, TEXT string, id int"
    )


WORDS = ["Alpha", "beta", "gamma", "GAMMA", "delta", "ünder", "été", "z q", "eta", "theta"]


def made(seed, n, rare=40):
    pick = random.Random(seed)
    rows = []
    for _ in range(n):
        words = pick.choices(WORDS + [f"w{i}" for i in range(rare)], weights=[30] * len(WORDS) + [2] * rare, k=pick.randint(0, 60))
        rows.append(("".join(w + pick.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b", "; "]) for w in words), pick.choice(["en", "en", "fr", None])))
    return rows


@pytest.mark.parametrize("least, longest, top, cover", [(3, 5, 2000, 100), (2, 4, 10, 70), (1, 2, 50, 100), (5, 3, 2000, 30)])
def test_phrases_agree_with_brute_force(spark, least, longest, top, cover):
    rows = made(least, 120) + [("common phrase of five words " * 30, "en")] * 3 + [(None, "en"), ("", None), (" .;\n", "fr"), ("a a a a a a a a a", "es")] * 2
    rows += [("very long text with words, " * 20_000, "de")]
    got = collected(co.collocations(frame(spark, rows), least=least, longest=longest, top=top, cover=cover))
    assert got == brute(rows, least, longest, top, cover) and got


def test_sql_form_agrees(spark):
    import duckdb

    rows = made(11, 80)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(con.execute(co.check_sql(least=3, top=30)).fetchall())
    assert want == brute(rows, 3, 5, 30, 100) == collected(co.collocations(frame(spark, rows), least=3, top=30))


def test_empty_table(spark):
    assert co.collocations(frame(spark, [(None, None)]).where("false")).collect() == []
    assert co.collocations(frame(spark, [(None, None), ("", "en")])).collect() == []


def test_trie_bursts_spills_and_merges_to_the_same_counts():
    numbers = np.random.default_rng(4)
    ids = numbers.integers(0, 30, 20_000).astype(np.uint32)
    windows = co.windows_of(ids, 5)
    trie, runs = co.BurstTrie(5, burst=16), []
    for at in range(0, len(windows), 1000):
        trie.add(windows[at : at + 1000])
        if len(trie) > 2000:
            before = len(trie)
            run = trie.spill(500)
            assert len(trie) <= 500 and len(run) == before - len(trie)
            assert [r[:5].tolist() for r in run] == sorted(r[:5].tolist() for r in run)
            runs.append(run)
    assert any(isinstance(n, dict) for n in trie.nodes.values())
    runs.append(trie.spill())
    assert len(trie) == 0
    want = Counter()
    for k in range(2, 6):
        for i in range(len(ids) - k + 1):
            if (ids[i : i + k] != 0).all():
                want[tuple(ids[i : i + k].tolist())] += 1
    got, rows = Counter(), np.concatenate(runs)
    bins = co.prefix_bins(rows, 7)
    for b in range(7):
        phrases, counts = co.merged_counts(rows[bins == b], 3)
        for p, c in zip(phrases, counts.tolist()):
            # a phrase that ends its prefix in this bin is whole here
            assert all(x % 2 for x in p.tolist()) or tuple(p.tolist()) not in got
            got[tuple(p.tolist())] += c
    assert {p: c for p, c in got.items() if c >= 3} == {p: c for p, c in want.items() if c >= 3}


def test_no_bin_key_is_held_by_heavy_words_alone():
    rows = np.array([[3, 5, 7, 9, 2, 1], [3, 5, 7, 9, 4, 1], [3, 5, 2, 9, 9, 1], [3, 5, 2, 11, 0, 1], [2, 3, 0, 0, 0, 1], [2, 9, 5, 0, 0, 1]], np.uint64)
    bins = co.prefix_bins(rows, 1 << 40)
    assert bins[0] != bins[1] and bins[2] == bins[3] and bins[4] == bins[5] and len(set(bins.tolist())) == 4


def test_scores_beyond_64_bits_are_exact(spark):
    rows = [(10**15 + 7, 9 * 10**15, 10**15 + 9, 10**15 + 8), (123456789012, 987654321987, 123456789013, 123456789999), (100, 100, 100, 100)]
    df = co.floor_score(spark.createDataFrame(rows, "a long, n long, l long, r long"))
    assert [r["score"] for r in df.orderBy(F.desc("a")).collect()] == [1000 * a * n // (x * y) for a, n, x, y in rows]
