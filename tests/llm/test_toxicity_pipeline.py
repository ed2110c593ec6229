import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from sieveline.llm import toxicity

SYLLABLES = "an er in on ti re th he st ou ing ed".split()
RUDE = ["zorgblat", "vexnik", "grumquash"]


def corpus(n=900, seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        said = [word() for _ in range(rnd.randint(5, 150))]
        if toxic:
            for _ in range(max(2, len(said) // 25)):
                said.insert(rnd.randrange(len(said)), rnd.choice(RUDE) + rnd.choice(["", "!", "s"]))
        docs.append((i, " ".join(said)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def brute_evidence(counted):
    d = toxicity.DISCOUNT
    short = Counter(g[-3:] for g in counted)
    before, kinds, last = Counter(), Counter(), Counter()
    for s, n in short.items():
        before[s[:-1]] += n
        kinds[s[:-1]] += 1
        last[s[-1]] += n * 0 + 1
    every = sum(last.values())
    total, seen = Counter(), Counter()
    for g, n in counted.items():
        for c in (0, 1):
            total[g[:-1], c] += n[c]
            seen[g[:-1], c] += n[c] > 0
    out = {}
    for g, n in counted.items():
        s = g[-3:]
        shared = (max(short[s] - d, 0) + d * kinds[s[:-1]] * last[s[-1]] / every) / before[s[:-1]]
        p = []
        for c in (0, 1):
            h = g[:-1], c
            p.append((max(n[c] - d, 0) + d * seen[h] * shared) / total[h] if total[h] else shared)
        out[g] = math.log(p[1] / p[0])
    return out


def test_counts_and_evidence_equal_brute_force(spark):
    docs, labels = corpus(60)
    labelled = spark.createDataFrame([(t, lab[2]) for (_, t), lab in zip(docs, labels)], "text string, toxic int")
    counted = toxicity.count_grams(labelled)
    want: dict = {}
    for (_, text), lab in zip(docs, labels):
        for word in toxicity.words_of(text.lower()):
            for gram in toxicity.grams(word):
                want.setdefault(gram, [0, 0])[lab[2]] += 1
    assert {r["gram"]: [r["ordinary"], r["toxic"]] for r in counted.collect()} == want
    found = {r["gram"]: r["evidence"] for r in toxicity.evidence(counted).collect()}
    assert found == pytest.approx(brute_evidence(want))


def test_capacity_keeps_the_heaviest(spark):
    rows = [(f"g{i}", float(i), float(2**i)) for i in range(10)]
    told = spark.createDataFrame(rows, "gram string, evidence double, weight double")
    assert set(toxicity._heaviest(told, 3)) == {"g7", "g8", "g9"}
    assert len(toxicity._heaviest(told, 100)) == 10
    assert toxicity._heaviest(told.limit(0), 3) == {}


def test_held_out_texts_are_told_apart(spark, make_docs):
    docs, labels = corpus()
    odd = [(5000, None), (5001, ""), (5002, "... 123"), (None, "thing zorgblat vexnik zorgblat"), (4, docs[4][1]), (5003, "a" * 50_000)]
    frame = make_docs(docs + odd)
    said = spark.createDataFrame([*labels, (None, 1, 1), (7, 1, None), (0, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(frame, said)
    scored = toxicity.score(frame, model, keep=("lang", "text"))
    assert scored.columns == ["doc_id", "lang", "text", "score"]
    rows = scored.collect()
    assert len(rows) == len(docs) + len(odd) and all(0 <= r["score"] <= 1 for r in rows)
    truth = {i: t for i, _, t in labels}
    held = [r for r in rows if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = np.mean([(r["score"] >= 0.5) == truth[r["doc_id"]] for r in held])
    assert len(held) > 100 and right > 0.97
    scores = {r["doc_id"]: r["score"] for r in rows}
    assert scores[None] > 0.5 > scores[5000] == scores[5001]


def test_the_model_keeps_every_spelling_of_all_training_folds(spark, make_docs):
    docs, labels = corpus(200)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(make_docs(docs), said)
    counted = [(t, lab[2]) for (i, t), lab in zip(docs, labels) if zlib.crc32(str(i).encode()) % 5 != toxicity.HELD_OUT]
    want = toxicity.evidence(toxicity.count_grams(spark.createDataFrame(counted, "text string, toxic int")))
    found = {r["gram"]: r["evidence"] for r in model.evidence.collect() if not r["gram"].endswith(toxicity.NEW)}
    assert found == pytest.approx({r["gram"]: r["evidence"] for r in want.collect()})


def test_new_letters_after_known_contexts_back_off_per_class(spark):
    counted = spark.createDataFrame([("^a", 6, 2), ("^b", 2, 0), ("^ab", 0, 5)], "gram string, ordinary long, toxic long")
    left = {r["gram"]: r["evidence"] for r in toxicity.backoff(counted).collect()}
    d = toxicity.DISCOUNT
    assert left == pytest.approx({"^*": math.log((d * 1 / 2) / (d * 2 / 8)), "^a*": math.log(d * 1 / 5)})
    table = toxicity.evidence(counted).select("gram", "evidence").union(toxicity.backoff(counted))
    known = {r["gram"]: r["evidence"] for r in table.collect()}
    rows = [(1, "^", ["a", "x"]), (1, "^a", ["b", "x"]), (1, "^q", ["a"])]
    needed = spark.createDataFrame(rows, "block long, context string, letters array<string>")
    said = {r["context"]: list(zip(r["letters"], r["values"])) for r in toxicity.said_of(needed, table).collect()[0]["said"]}
    assert said == {"^": [("a", known["^a"]), ("x", known["^*"])], "^a": [("b", known["^ab"]), ("x", known["^a*"])]}


def test_without_labels_or_documents(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(make_docs([(1, "some text")]), none)
    assert model.evidence == {} and model.curve == toxicity.START
    assert toxicity.score(make_docs([]), model).collect() == []


def test_stages_take_effect(spark, tmp_path):
    docs, labels = corpus(240)
    rnd = random.Random(1)
    said = lambda n: " ".join("".join(rnd.choice("klmnop") for _ in range(5)) for _ in range(n))
    passage = said(120)
    extra = [(1000 + i, said(90) + " " + passage) for i in range(3)]
    near = docs[1][1] + " and one more"
    extra += [(2000, docs[1][1]), (2001, near), (2002, "write to me@mail.example.com or " + " ".join(f"w{i}" for i in range(90)))]
    rows = [(i, t, "en", "s", len(t)) for i, t in docs + extra] + [(3000, None, "en", "s", None)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        stage(spark, kept, folder).write.parquet(f"{folder}/{name}")
        kept = spark.read.parquet(f"{folder}/{name}")
        assert kept.columns == before.columns
        seen[name] = {r["doc_id"]: r for r in kept.collect()}
    toxic = {i for i, _, t in labels if t}
    gone = {r[0] for r in rows} - set(seen["toxicity"])
    assert len(gone & toxic) > 0.9 * len(toxic) and len(gone - toxic) <= 2
    joined = seen["ngram_join"]
    assert 1 in joined and 2000 not in joined
    dedup = seen["suffix_dedup"]
    assert dedup[1000]["text"].endswith(passage)
    assert all(len(dedup[i]["text"]) < len(joined[i]["text"]) - 500 for i in (1001, 1002))
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in dedup.values())
    assert "[email]" in seen["pii"][2002]["text"] and seen["pii"][3000]["text"] is None
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, folder).collect()
    assert {r["doc_id"] for r in packed} == set(seen["pii"])
    again = corpus_pipeline.run(spark, folder).collect()
    place = lambda rows: sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in rows)
    assert place(again) == place(packed)


def test_shared_passages_of_51_short_words_go(spark):
    rnd = random.Random(5)
    said = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(3)) for _ in range(n))
    passage = said(51)
    docs = spark.createDataFrame([(i, f"{said(40)} {passage} {said(40)}") for i in range(3)], "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeats(spark, docs, "").collect()}
    assert passage in kept[0] and all(len(kept[i]) <= 2 * 160 for i in (1, 2))


def test_stored_texts_are_joined_where_they_lie(spark, make_docs):
    docs, labels = corpus(40)
    texts = toxicity.store(make_docs(docs))
    said = spark.createDataFrame([(b, 1) for (b,) in texts.table.select("block").collect()], "block long, x int").hint("merge")
    joined = texts.table.select("block", "body").join(said, "block")
    plan = joined._jdf.queryExecution().sparkPlan().toString() + joined._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(block") <= 1
    known = toxicity._table(spark.createDataFrame([("^a", 6, 2)], "gram string, ordinary long, toxic long"), None)
    rows = spark.createDataFrame([(1, 4, "^", ["a", "x"]), (1, 9, "^q", ["a"])], "block long, at int, context string, letters array<string>")
    (row,) = toxicity.said_of(rows, known, ("at",)).collect()
    assert [list(s.asDict()) for s in row["said"]] == [["at", "values"]] and row["said"][0]["at"] == 4


def test_a_reused_worker_gives_up_what_others_left():
    from sieveline.llm import bpe, common

    first = bpe.word_bpe()
    assert bpe.word_bpe() is first
    common.make_room()
    assert bpe.word_bpe() is not first


def test_shuffle_files_go_with_their_query(spark, tmp_path, monkeypatch):
    import glob
    import time

    left = lambda: set(glob.glob(f"{spark.conf.get('spark.local.dir', '/tmp')}/**/blockmgr-*/*/shuffle_*", recursive=True))
    held = []

    def stage(spark, docs, sf_dir):
        held.append(docs.groupBy("text").count().orderBy("text"))  # keeps the driver from collecting it
        return held[-1]

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("count", stage)])
    spark.createDataFrame([(i, str(i % 7)) for i in range(50)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    setting, before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled"), left()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 7
    for _ in range(100):
        if left() <= before:
            break
        time.sleep(0.1)
    assert not [f for f in left() - before if f.endswith(".data")][1:]  # the count just made may have one
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_a_stage_leaves_its_output_alone(spark, tmp_path, monkeypatch):
    import os

    from sieveline import session

    folder = tmp_path / "shared"
    folder.mkdir()
    monkeypatch.setattr(session, "_shared_folder", lambda spark, name: str(folder))

    def tidy(spark, docs, sf_dir):
        table = toxicity._bucketed(docs, "texts", "doc_id")
        return toxicity._written(table.filter("doc_id > 0"), "kept")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", tidy), ("second", tidy)])
    spark.createDataFrame([(i, "a") for i in range(5)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tables = {t.name for t in spark.catalog.listTables()}
    rows = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in rows.collect()) == [1, 2, 3, 4]
    assert [n.split("-")[0] for n in os.listdir(folder)] == ["second"]
    assert {t.name for t in spark.catalog.listTables()} == tables
    assert spark.read.parquet(f"{tmp_path}/documents.parquet").count() == 5
