"""Array expressions: running values, and pattern matches with their places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = 256


def running(values: Column, start: Column, step) -> Column:
    """Running values of an array under an associative `step`, led by `start`.

    They are built in stretches and joined, so long arrays stay near linear.
    """
    scan = lambda a: F.aggregate(a, F.array(start), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))
    fold = lambda a: F.aggregate(a, start, step)
    stretches = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(STEP)), lambda i: F.slice(values, i, STEP)
    )
    parts = F.when(F.size(values) == 0, F.array(values)).otherwise(stretches)
    bases = F.slice(scan(F.transform(parts, fold)), 1, F.size(parts))
    within = F.transform(parts, lambda p: F.slice(scan(p), 1, F.size(p)))
    joined = F.zip_with(within, bases, lambda w, b: F.transform(w, lambda x: step(b, x)))
    return F.concat(F.flatten(joined), F.array(fold(values)))


def prefix_sums(values: Column) -> Column:
    """Running sums of an array of ints, led by 0."""
    return running(F.transform(values, lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)


def _zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def located(text: Column, pattern: str, hint: Column, lines: bool = False) -> Column:
    """Matches of a pattern as array<struct<start, hit>>, starts in code points; `hint` says if there can be any.

    With `lines`, each match also has the number of the line it starts in. The
    pieces between matches give the places, so no match is looked for twice.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    n = F.size(hits)

    def before(measure) -> Column:
        """What lies before each match, in the given measure."""
        steps = F.zip_with(between, hits, lambda b, h: _zero_if_null(measure(b)) + _zero_if_null(measure(h)))
        own = F.transform(F.slice(between, 1, n), lambda b: measure(b).cast("long"))
        return F.zip_with(F.slice(prefix_sums(steps), 1, n), own, lambda s, b: s + b)

    starts = before(F.length)
    if not lines:
        found = F.zip_with(starts, hits, lambda s, h: F.struct(s.alias("start"), h.alias("hit")))
        return F.when(hint, found).otherwise(F.array().cast("array<struct<start:bigint,hit:string>>"))
    breaks = before(lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit(""))))
    at = F.zip_with(starts, breaks, lambda s, b: F.struct(s.alias("start"), (b + 1).alias("line")))
    found = F.zip_with(at, hits, lambda a, h: F.struct(a["start"].alias("start"), h.alias("hit"), a["line"].alias("line")))
    return F.when(hint, found).otherwise(F.array().cast("array<struct<start:bigint,hit:string,line:bigint>>"))
