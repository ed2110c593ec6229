"""Repairing the structure of conversations by weighted interval parsing.

A sound conversation has the role initials `(s?(ua)+)?`. Its grammar in Chomsky
normal form has one nonterminal per pair of places in that pattern, `(p, q)`, and
the rules `(p, q) -> (p, r) (r, q)`: what leads from p to q over a span is what
leads from p to some r over its first part and from r to q over the rest. A cell
holds, for every nonterminal, the least (cost, audit) of the edits of its span,
closed under insertions at both ends; spans of one row come first, then spans of
two, four and so on. As the rules hold for every cut of a span, one cut each is
enough. The letters of an audit fix its cost, so no cheapest audit of a span is the
beginning of another one, and the least of a whole span is made of least parts.

Rows are edited by Keep (0), Rerole to user or assistant (1) and Delete (2), and
turns with an empty text are inserted (5). Blank rows and rows whose role and text
stood earlier must go; a row whose text does not end in a full stop, an exclamation
or a question mark costs 5 more unless deleted.

On Spark: repeated texts are found by keys, then the rows without their texts are
dealt by ranges of (conversation, turn), so that a long conversation is cut into
segments, each parsed where it lies. The cells of segments are combined per
conversation, and one sorted stream applies the audit to the texts; nothing of a
conversation is held but its audit.

Nulls in role or text are one space. Rows come by turn, those without one first;
rows of one turn by role, then by a hash of the text, so repeated rows are adjacent.
An empty role, like any but those with initial s, u or a, cannot be kept. A
conversation id that is null is one of its own. An empty table has no result.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sieveline.llm.common import pick

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANK_CHARS = " \t\n\x0b\x0c\r"
NAMES = {"u": "user", "a": "assistant"}

# The pattern's places: before the first turn, after s, after u, after a
PLACES = "0sua"
STEPS = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}  # (place, initial) -> place
ENDS = "0a"
_PAIRS = [(p, q) for p in PLACES for q in PLACES if q not in "0s" or p == q or (p, q) == ("0", "s")]
_AT = {pair: i for i, pair in enumerate(_PAIRS)}
_RULES = [(_AT[p, q], _AT[p, r], _AT[r, q]) for p, q in _PAIRS for r in PLACES if (p, r) in _AT and (r, q) in _AT]
_START = [_AT["0", q] for q in ENDS]

Cell = tuple  # (cost, audit) or None per nonterminal


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out: list = [None] * len(_PAIRS)
    for whole, first, rest in _RULES:
        a, b = left[first], right[rest]
        if a is not None and b is not None:
            found, best = (a[0] + b[0], a[1] + b[1]), out[whole]
            if best is None or found < best:
                out[whole] = found
    return tuple(out)


def _nothing() -> Cell:
    """The cell of no rows: insertions alone, as many as lead from place to place."""
    out: list = [(0, "") if p == q else None for p, q in _PAIRS]
    for (place, initial), then in STEPS.items():
        if initial in NAMES:
            out[_AT[place, then]] = (INSERT, "I")
    for _ in PLACES:
        out = list(combine(tuple(out), tuple(out)))
    return tuple(out)


NOTHING = _nothing()


@lru_cache(maxsize=None)
def row_cell(code: str) -> Cell:
    """The cell of one row: its initial, in upper case if truncated, `o` for other roles, `x` if it must go."""
    out: list = [(DELETE, "D") if p == q else None for p, q in _PAIRS]
    if code != "x":
        more = TRUNCATED if code.isupper() else 0
        for (place, initial), then in STEPS.items():
            ways = [(more, "K")] if initial == code.lower() else []
            ways += [(REROLE + more, "R")] if initial in NAMES else []
            out[_AT[place, then]] = min(ways, default=None)
    return combine(combine(NOTHING, tuple(out)), NOTHING)


def _parse(codes: str) -> Cell:
    cells = [row_cell(c) for c in codes] or [NOTHING]
    while len(cells) > 1:  # spans of twice the length
        odd = cells[len(cells) & ~1 :]
        cells = [combine(a, b) for a, b in zip(cells[::2], cells[1::2])] + odd
    return cells[0]


_parse_short = lru_cache(maxsize=1 << 16)(_parse)


def parse(codes: str) -> Cell:
    """The cell of a span of rows; short spans repeat and are remembered."""
    return _parse_short(codes) if len(codes) <= 32 else _parse(codes)


def cheapest(cell: Cell) -> tuple[int, str]:
    """Cost and audit of the best edits that give the whole pattern."""
    return min(cell[i] for i in _START if cell[i] is not None)


_LEGAL = {"su", "ua", "au"}


def _rows(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Named rows with a key of role and text, and the faults seen in the row alone."""
    rows = pick(df, conv_col, turn_col, role_col, text_col).toDF("conv", "turn", "role", "text")
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")})
    end = F.right(F.rtrim("text", F.lit(BLANK_CHARS)), F.lit(1))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    code = F.when(end == "", "x").otherwise(F.when(end.isin(".", "!", "?"), known).otherwise(F.upper(known)))
    return rows.withColumns(
        {"initial": initial, "code": code, "k1": F.xxhash64("role", "text"), "k2": F.xxhash64(F.lit(1), "text", "role")}
    )


def _order() -> list[Column]:
    return [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("k1"), F.asc("k2")]


_COUNTS = "n long, blank long, duplicate long, truncated long, illegal long, distinct long"


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    condition = F.lit(True)
    for n in names:
        condition &= left[n].eqNullSafe(right[f"_{n}"])
    return condition


def segments(df: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """Parsed stretches of conversations in their order: counts of faults, what stands at their ends, and their cells."""
    rows = _rows(df, conv_col, turn_col, role_col, text_col)
    keys = ["conv", "role", "k1", "k2"]
    groups = rows.groupBy("turn", "initial", "code", *keys).agg(F.count(F.lit(1)).alias("copies"))
    repeated = groups.groupBy(*keys).agg(F.min(F.struct("turn")).alias("first"), F.sum("copies").alias("all"))
    repeated = repeated.where("all > 1").select(*[F.col(k).alias(f"_{k}") for k in keys], "first")
    marked = groups.join(repeated, _same(groups, repeated, keys), "left")
    later = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    marked = marked.withColumn("later", later).select("conv", "turn", "role", "k1", "k2", "initial", "code", "copies", "later")
    dealt = marked.repartitionByRange(*_order()).sortWithinPartitions(*_order())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, at = TaskContext.get().partitionId(), [], None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 5, 6, 7, 8)]
            for conv, turn, initial, code, copies, later in zip(*columns):
                if at is None or at.conv != conv:
                    if at is not None:
                        out.append(at.row(part))
                    at = _Segment(conv, initial)
                at.add(turn, initial, code, copies, later)
            if len(out) >= 4096:
                yield _record(out, kinds)
                out = []
        if at is not None:
            out.append(at.row(part))
        if out:
            yield _record(out, kinds)

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = (
        f"conv {kind['conv']}, part int, first string, last string, low {kind['turn']}, high {kind['turn']}, "
        f"{_COUNTS}, costs array<long>, audits array<string>"
    )
    kinds = _kinds(schema)
    return dealt.mapInArrow(run, schema)


def _record(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds.types)], schema=kinds)


def _kinds(schema: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(schema))


class _Segment:
    """Rows of one conversation in order, as counts and codes."""

    def __init__(self, conv, initial: str):
        self.conv, self.first, self.last = conv, initial, None
        self.low = self.high = None
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.codes: list[str] = []

    def add(self, turn, initial: str, code: str, copies: int, later: bool) -> None:
        self.n += copies
        if code == "x":
            self.blank += copies
            self.codes.append("x" * copies)
        else:
            again = copies if later else copies - 1
            self.duplicate += again
            self.truncated += (copies - again) * code.isupper()
            self.codes.append(code * (copies - again) + "x" * again)
        if self.last is not None:
            self.illegal += self.last + initial not in _LEGAL
        self.illegal += copies - 1  # a role never follows itself
        self.last = initial
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.distinct += 1

    def row(self, part: int) -> tuple:
        cell = parse("".join(self.codes))
        counts = (self.n, self.blank, self.duplicate, self.truncated, self.illegal, self.distinct)
        costs, audits = [None if c is None else c[0] for c in cell], [None if c is None else c[1] for c in cell]
        return (self.conv, part, self.first, self.last, self.low, self.high, *counts, costs, audits)


def plans(parts: DataFrame) -> DataFrame:
    """Per conversation with rows: `gaps`, counts of faults, `cost` and `audit`, from its segments in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, done = None, []

        def close() -> None:
            gaps = 0 if at["low"] is None else at["high"] - at["low"] + 1 - at["distinct"]
            cost, audit = cheapest(at["cell"])
            done.append((at["conv"], gaps, at["blank"], at["duplicate"], at["truncated"], at["illegal"], cost, audit))

        for batch in batches:
            for row in batch.to_pylist():
                row["cell"] = tuple(None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"]))
                if at is None or at["conv"] != row["conv"]:
                    if at is not None:
                        close()
                    at = row
                    continue
                row["illegal"] += at["last"] + row["first"] not in _LEGAL
                row["distinct"] -= at["high"] is not None and at["high"] == row["low"]
                for name in ("blank", "duplicate", "truncated", "illegal", "distinct"):
                    row[name] += at[name]
                row["cell"] = combine(at["cell"], row["cell"])
                row["low"] = row["low"] if at["low"] is None else at["low"]
                row["high"] = at["high"] if row["high"] is None else row["high"]
                at = row
            if done:
                yield _record(done, kinds)
                done = []
        if at is not None:
            close()
            yield _record(done, kinds)

    schema = f"conv {parts.schema['conv'].dataType.simpleString()}, " + _PLAN
    kinds = _kinds(schema)
    dealt = parts.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "part")
    return dealt.mapInArrow(run, schema)


_PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_PLAN_NAMES = [f.split()[0] for f in _PLAN.split(", ")]


class _Editor:
    """Applies an audit to the rows of one conversation, one after the other."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place = audit, 0, "0"

    def _next(self) -> str:
        self.at += 1
        return "a" if self.place == "u" else "u"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.place = self._next()
            yield "I", NAMES[self.place], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what stands before the row and of the row, unless deleted."""
        yield from self.inserted()
        edit = self.audit[self.at]
        wanted = self._next()
        if edit == "K":
            self.place = role[:1]
            yield edit, role, text
        elif edit == "R":
            self.place = wanted
            yield edit, NAMES[wanted], text


def _edited(df: DataFrame, found: DataFrame, everyone: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One sorted stream per conversation: what is known of it, then its rows."""
    rows = _rows(df, *columns).select("conv", "turn", "role", "text", "k1", "k2")
    blank = [F.lit(None).cast(k).alias(n) for n, k in (f.split() for f in _PLAN.split(", "))]
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields[1:]]
    conv = everyone.select(F.col(columns[0]).alias("conv")).distinct()
    stream = rows.select("*", *blank, F.lit(2).alias("kind"))
    stream = stream.unionByName(found.select("conv", *_PLAN_NAMES, *nothing, F.lit(1).alias("kind")))
    stream = stream.unionByName(conv.select("conv", *blank, *nothing, F.lit(0).alias("kind")))
    order = _order()
    return stream.repartition("conv").sortWithinPartitions(order[0], "kind", *order[1:]).drop("k1", "k2", "turn")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict]]:
    for batch in batches:
        for row in batch.to_pylist():
            yield row["kind"], row


def turns(df: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """The repaired conversations: `conv_col`, `place` (from 0), `edit` (K, R or I), `role` and `text`."""
    columns = (conv_col, turn_col, role_col, text_col)
    found = plans(segments(df, *columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor, conv, place, out, size = _Editor(""), None, 0, [], 0

        def emit(made: Iterator[tuple[str, str, str]]) -> None:
            nonlocal place, size
            for edit, role, text in made:
                out.append((conv, place, edit, role, text))
                place += 1
                size += len(text)

        for kind, row in _conversations(batches):
            if kind == 0:
                emit(editor.inserted())
                editor, conv, place = _Editor(""), row["conv"], 0
            elif kind == 1:
                editor = _Editor(row["audit"])
            else:
                emit(editor.row(row["role"], row["text"]))
            if size > 1 << 22 or len(out) > 10_000:
                yield _record(out, kinds)
                out, size = [], 0
        emit(editor.inserted())
        if out:
            yield _record(out, kinds)

    stream = _edited(df, found, df, columns)
    schema = f"conv {stream.schema['conv'].dataType.simpleString()}, place long, edit string, role string, text string"
    kinds = _kinds(schema)
    return stream.mapInArrow(run, schema).withColumnRenamed("conv", conv_col)


def digests(
    df: DataFrame, everyone: DataFrame | None = None, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text"
) -> DataFrame:
    """Per conversation: gaps, faults, `cost`, `audit`, and the SHA-256 of its repaired `role:text` lines.

    `everyone` may name conversations that have no rows left in `df`; they give
    zeros, an empty audit and the hash of nothing. A hash takes its bytes in order,
    so one task streams through the whole of a conversation.
    """
    columns = (conv_col, turn_col, role_col, text_col)
    found = plans(segments(df, *columns))
    empty = dict.fromkeys(_PLAN_NAMES, 0) | {"audit": ""}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, done = None, []

        def feed(made: Iterator[tuple[str, str, str]]) -> None:
            nonlocal first
            for _, role, text in made:
                line = f"{role}:{text}" if first else f"\n{role}:{text}"
                digest.update(line.encode())
                first = False

        def close() -> None:
            feed(editor.inserted())
            done.append((conv, *[at[n] for n in _PLAN_NAMES], digest.hexdigest()))

        for kind, row in _conversations(batches):
            if kind == 0:
                if at is not None:
                    close()
                conv, at, editor, digest, first = row["conv"], empty, _Editor(""), hashlib.sha256(), True
            elif kind == 1:
                at, editor = row, _Editor(row["audit"])
            else:
                feed(editor.row(row["role"], row["text"]))
            if len(done) >= 4096:
                yield _record(done, kinds)
                done = []
        if at is not None:
            close()
        if done:
            yield _record(done, kinds)

    stream = _edited(df, found, df if everyone is None else everyone, columns)
    schema = f"conv {stream.schema['conv'].dataType.simpleString()}, {_PLAN}, repaired_sha256 string"
    kinds = _kinds(schema)
    return stream.mapInArrow(run, schema).withColumnRenamed("conv", conv_col)
