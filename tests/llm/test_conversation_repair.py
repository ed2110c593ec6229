import hashlib
import itertools
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

import __spark_entry__ as entry
from sieveline.llm import conversation_repair as repair

SF = "/root/testdata/sf0.001"
PATTERN = re.compile(r"(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"


def kinds_of(rows):
    """First fault of each (role, text)."""
    out, seen = [], set()
    for role, text in rows:
        end = text.rstrip(WHITE)
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def every_way(rows, most_inserts):
    """All (cost, audit, lines) of edits that give the pattern, by trying everything."""
    kinds = kinds_of(rows)
    options = []
    for (role, text), kind in zip(rows, kinds):
        more = 5 * (kind == "truncated")
        ways = [(2, "D", None)]
        if kind not in ("blank", "duplicate"):
            ways += [(more, "K", (role, text)), (1 + more, "R", ("user", text)), (1 + more, "R", ("assistant", text))]
        options.append(ways)
    for chosen in itertools.product(*options):
        for counts in itertools.product(range(most_inserts + 1), repeat=len(rows) + 1):
            if sum(counts) > most_inserts:
                continue
            for names in itertools.product(("user", "assistant"), repeat=sum(counts)):
                cost, audit, lines, name = 0, "", [], iter(names)
                for i in range(len(rows) + 1):
                    for _ in range(counts[i]):
                        cost, audit = cost + 5, audit + "I"
                        lines.append((next(name), ""))
                    if i < len(rows):
                        cost, audit = cost + chosen[i][0], audit + chosen[i][1]
                        lines += [chosen[i][2]] * (chosen[i][2] is not None)
                # an empty role cannot be kept
                if all(r for r, _ in lines) and PATTERN.fullmatch("".join(r[0] for r, _ in lines)):
                    yield cost, audit, "\n".join(f"{r}:{t}" for r, t in lines)


def codes_of(rows):
    letter = lambda role: role[:1] if role[:1] in ("s", "u", "a") else "o"
    shown = {"": lambda r: letter(r), "truncated": lambda r: letter(r).upper()}
    return "".join(shown.get(k, lambda r: "x")(role) for (role, _), k in zip(rows, kinds_of(rows)))


TEXTS = ["Yes.", "No", " ", "Why?", "", "So", "Ok!"]
ROLES = ["user", "assistant", "system", "tool", "", "admin", "U"]


def test_cheapest_edits_agree_with_trying_everything():
    pick = random.Random(5)
    for _ in range(150):
        rows = [(pick.choice(ROLES), pick.choice(TEXTS)) for _ in range(pick.randint(0, 3))]
        cost, audit, lines = min(every_way(rows, 2))
        assert repair.cheapest(repair.parse(codes_of(rows))) == (cost, audit), rows
        editor = repair._Editor(audit)
        made = [x for role, text in rows for x in editor.row(role, text)] + list(editor.inserted())
        assert "\n".join(f"{r}:{t}" for _, r, t in made) == lines


def forward(rows):
    """Least (cost, audit) by a walk from left to right over the pattern's places."""
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(best):
        for _ in range(4):
            for place, (cost, audit) in list(best.items()):
                then = step.get((place, "a" if place == "u" else "u"))
                best[then] = min(best.get(then, (1 << 60, "")), (cost + 5, audit + "I"))
        return best

    best = inserted({"0": (0, "")})
    for (role, _), kind in zip(rows, kinds_of(rows)):
        new = {}
        for place, (cost, audit) in best.items():
            ways = [(place, 2, "D")]
            if kind not in ("blank", "duplicate"):
                more = 5 * (kind == "truncated")
                ways += [(step.get((place, role[:1])), more, "K"), (step.get((place, "u")), 1 + more, "R"), (step.get((place, "a")), 1 + more, "R")]
            for then, extra, letter in ways:
                if then is not None:
                    new[then] = min(new.get(then, (1 << 60, "")), (cost + extra, audit + letter))
        best = inserted(new)
    return min(best[p] for p in "0a" if p in best)


@pytest.mark.parametrize("cuts", [1, 2, 7])
def test_cells_of_segments_combine_to_the_same(cuts):
    pick = random.Random(cuts)
    for n in (1, 5, 33, 200):
        rows = [(pick.choice(ROLES), pick.choice(TEXTS) + str(pick.randint(0, 99)) + pick.choice(".!, ")) for _ in range(n)]
        codes, size = codes_of(rows), -(-n // cuts)
        cell = repair.NOTHING
        for at in range(0, n, size):
            cell = repair.combine(cell, repair.parse(codes[at : at + size]))
        assert repair.cheapest(cell) == forward(rows)


SCHEMA = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("conv", T.StringType()),  # names that the operator uses itself
        T.StructField("code", T.StringType()),
        T.StructField("TURN", T.LongType()),
    ]
)


def expected(rows, everyone):
    """By conversation, over rows (conv, turn, role, text) that are there."""
    out = {}
    for conv in everyone:
        own = [r for r in rows if r[0] == conv]
        # turns first, then role; equal turns with different texts of one role do not occur in these tests
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        lines = [(r[2], r[3]) for r in own]
        kinds = kinds_of(lines)
        told = {r[1] for r in own if r[1] is not None}
        gaps = max(told) - min(told) + 1 - len(told) if told else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(lines))
        cost, audit = forward(lines)
        editor = repair._Editor(audit)
        made = [x for role, text in lines for x in editor.row(role, text)] + list(editor.inserted())
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in made).encode()).hexdigest()
        out[conv] = (gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest)
    return out


def found(df):
    rows = df.collect()
    got = {r["conv_id"]: tuple(r[n] for n in (*repair._PLAN_NAMES, "repaired_sha256")) for r in rows}
    assert len(got) == len(rows)
    return got


def test_query_agrees_with_brute_force_on_all_conversations(spark):
    given = pq.read_table(f"{SF}/conversations.parquet").to_pylist()
    rows = []
    for r in given:
        fault = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", r["text"]) if fault == 2 else r["text"]
        rows += [(r["conv_id"], r["turn"], "user" if fault == 4 else r["role"], text)] * (2 if fault == 3 else 1)
    want = expected(rows, {r["conv_id"] for r in given})
    assert found(entry.queries()["op12_conversation_repair"](spark, SF)) == want


def test_nulls_ties_repeats_empty_and_long_conversations(spark):
    pick = random.Random(9)
    rows = [
        (1, None, "user", "Hi."), (1, 4, None, "x."), (1, 4, "user", None), (1, 9, "assistant", "Bye."),
        (None, 0, "user", "No id."), (None, None, None, None),
        (2, 5, "user", "Same."), (2, 5, "user", "Same."), (2, 5, "user", "Same."), (2, 6, "user", "Same."),
        (3, 1, "", "Empty role."), (3, 2, "user", ""), (4, 7, "assistant", "a " * 50_000),
    ]
    rows += [(5, i, pick.choice(ROLES[:4]), pick.choice(TEXTS) + str(i % 900) + pick.choice(["", "."])) for i in range(6000)]
    df = spark.createDataFrame([(*r, "c", "x", 1) for r in rows], SCHEMA)
    filled = [(r[0], r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows]
    want = expected(filled, {r[0] for r in rows})
    assert found(repair.digests(df)) == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that even this table has several ranges
    try:
        assert repair.segments(df).count() > len(want)  # the long one is cut
        assert found(repair.digests(df)) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lines = {}
    for r in repair.turns(df).orderBy("conv_id", "place").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, told in want.items():
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == told[-1]


def test_conversations_without_rows_and_empty_tables(spark):
    gone = spark.createDataFrame([(7, 0, "user", "Hi.", "c", "x", 1)], SCHEMA)
    none = gone.where("false")
    assert found(repair.digests(none, gone)) == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.digests(none).collect() == [] and repair.turns(none).collect() == []
