"""Personal data by weak supervision, in DataFrame functions alone.

Patterns with their checks find the base spans, and these always stand. Looser
patterns propose further spans. Regex, gazetteer, context, shape and border
labelers vote on every proposal (yes, no, or nothing). Counts per combination of votes
and features are all that leaves the cluster; on these, expectation-maximisation
estimates how reliable each labeler is for each kind, and a logistic span
classifier is trained on the estimated probabilities. A proposal that the
classifier accepts, and that no base span or earlier proposal overlaps, is added.

A null text is an empty one and has no spans. Offsets are code points, ends are
exclusive. Rows are judged one by one; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.arrays import located, running
from sieveline.llm.common import pick

# The base patterns. Possessive repeats and the looks behind match the same as without, in linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|(?<=0))"

# Looser proposals
SECRET = r"(?i)(?<![A-Za-z0-9_])(?:api[_-]?key|access[_-]?key|secret|token|passwo?r?d|pwd)[\x20\"']{0,3}[=:][\x20\"']{0,3}[A-Za-z0-9_+/=.-]{8,}+"
LOCAL_PHONE = r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)[\x20]?|[0-9]{2,4}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"
SPELLED_EMAIL = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++[\x20]?(?:\(at\)|\[at\])[\x20]?[A-Za-z0-9-]++(?:[\x20]?(?:\.|\(dot\)|\[dot\])[\x20]?[A-Za-z0-9-]++)++"
LOOSE = {"email": SPELLED_EMAIL, "card": CARD, "phone": LOCAL_PHONE, "secret": SECRET}
KINDS = ("email", "ip", "card", "phone", "secret")

# Gazetteers and words of the context
CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35|30[0-5]|36|38)"
TOP_DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"
AREA_CODES = r"^\(?[2-9][0-9]{2}"
KEY_PREFIX = r"(?i)(?:AKIA|ghp_|sk-|xox|token|key)"
CUES = {
    "email": r"(?i)(?:mail|contact|write|reach)",
    "ip": r"(?i)(?:\bip\b|host|server|address)",
    "card": r"(?i)(?:card|visa|master|credit|debit|payment|konto|tarjeta|carte)",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|whatsapp)",
    "secret": r"(?i)(?:token|key|secret|passw)",
}
OTHER_CUES = r"(?i)(?:version|isbn|issn|doi|order|invoice|serial|page|figure|section)\W*$"
CONTEXT = 24
"""Code points before a proposal that the context labeler reads."""
LABELERS = ("pattern", "gazetteer", "context", "shape", "border")


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def valid(kind: str, hit: Column) -> Column:
    """The check a base match must pass."""
    count = F.length(digits(hit))
    if kind == "ip":
        return hit.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(count.between(12, 19), F.call_function("luhn_check", digits(hit))).otherwise(F.lit(False))
    if kind == "phone":
        return count.between(9, 15)
    return F.lit(True)


def hints(text: Column) -> dict[str, Column]:
    """What a text must hold for a kind to match at all; cheap to find out."""
    return {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
        "phone": F.contains(text, F.lit("+")),
    }


def span(kind: str, found: Column) -> Column:
    """start, rank of the kind, end, kind: in the order spans are listed in."""
    start = found["start"]
    return F.struct(
        start.alias("start"),
        F.lit(KINDS.index(kind)).alias("rank"),
        (start + F.length(found["hit"])).alias("end"),
        F.lit(kind).alias("kind"),
    )


def base_spans(df: DataFrame) -> DataFrame:
    """Adds `matches_<kind>` (all matches of the base patterns) and `base_<kind>` (spans of those that pass)."""
    text = F.col("text")
    hint = hints(text)
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    out = df.withColumns({f"matches_{k}": located(text, p, hint[k]) for k, p in patterns.items()})

    def spans(kind: str) -> Column:
        passed = F.filter(f"matches_{kind}", lambda m: valid(kind, m["hit"]))
        return F.transform(passed, lambda m: span(kind, m))

    return out.withColumns({f"base_{k}": spans(k) for k in BASE})


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def _votes(kind: str, hit: Column, before: Column, after: Column) -> Column:
    """The labelers' votes on one proposal, as one small array in the order of LABELERS."""
    count, size = F.length(digits(hit)), F.length(hit)
    never = F.lit(False)
    checked = {
        "email": _vote(hit.rlike(r"(?i)\.[a-z]{2,}$"), ~hit.rlike(r"(?i)[a-z]{2,}$")),
        "ip": _vote(valid("ip", hit), ~valid("ip", hit)),
        "card": _vote(valid("card", hit), ~valid("card", hit)),
        "phone": _vote(count.between(9, 15), ~count.between(7, 15)),
        "secret": _vote(hit.rlike(r"[0-9]") & (size >= 24), size < 16),
    }[kind]
    listed = {
        "email": _vote(hit.rlike(TOP_DOMAINS), never),
        "ip": _vote(never, hit.rlike(r"^(?:0|127|255)\.")),
        "card": _vote(digits(hit).rlike(CARD_PREFIX), ~digits(hit).rlike(CARD_PREFIX)),
        "phone": _vote(hit.rlike(AREA_CODES) | hit.startswith("+"), never),
        "secret": _vote(hit.rlike(KEY_PREFIX), never),
    }[kind]
    near = _vote(before.rlike(CUES[kind]), before.rlike(OTHER_CUES))
    shaped = {
        "email": _vote(hit.rlike(r"[A-Za-z]{2,}"), size > 120),
        "ip": _vote(size >= 7, size > 15),
        "card": _vote(
            valid("card", hit) & hit.rlike(r"^(?:[0-9]{13,16}|[0-9]{4}(?:[ -][0-9]{4}){3})$"), ~valid("card", hit)
        ),
        "phone": _vote(hit.rlike(r"[().\x20-]"), count > 15),
        "secret": _vote(hit.rlike(r"[0-9a-fA-F]{32,}"), hit.rlike(r"[=:][\x20\"']*[A-Za-z]+$")),
    }[kind]
    whole = _vote(never, before.rlike(r"[A-Za-z0-9_]$") | after.rlike(r"^[A-Za-z0-9_]"))
    return F.array(checked, listed, near, shaped, whole)


def _features(kind: str, hit: Column) -> Column:
    """Features of the span classifier, as names; the votes join them when it is trained."""
    count, size = F.length(digits(hit)), F.length(hit)
    return F.array(
        F.lit(f"kind={kind}"),
        F.concat(F.lit(f"{kind}:digits="), F.least(count, F.lit(20)).cast("string")),
        F.concat(F.lit(f"{kind}:length="), F.least(F.floor(size / 4), F.lit(12)).cast("string")),
        F.concat(F.lit(f"{kind}:broken="), hit.rlike(r"[\x20().-]").cast("string")),
    )


def proposals(df: DataFrame) -> DataFrame:
    """Adds `proposed`: spans beyond the base ones with the votes and features on each, and what base spans vote like."""
    text = F.col("text")
    loose = {
        "email": located(text, SPELLED_EMAIL, text.rlike(r"(?i)[(\[]at[)\]]")),
        "card": F.col("matches_card"),
        "phone": located(text, LOCAL_PHONE, text.rlike(r"[0-9]{3}[\x20.-][0-9]{4}")),
        "secret": located(text, SECRET, text.rlike(r"(?i)(?:key|secret|token|passw|pwd)[\x20\"']{0,3}[=:]")),
    }

    def judge(kind: str, hits: Column, is_base) -> Column:
        def one(m: Column) -> Column:
            end = m["start"] + F.length(m["hit"])
            lead = F.greatest(m["start"] - CONTEXT, F.lit(0))
            before = F.substring(text, (lead + 1).cast("int"), (m["start"] - lead).cast("int"))
            after = F.substring(text, (end + 1).cast("int"), F.lit(1))
            return F.struct(
                span(kind, m).alias("span"),
                is_base(m).alias("base"),
                _votes(kind, m["hit"], before, after).alias("votes"),
                _features(kind, m["hit"]).alias("features"),
            )

        return F.transform(hits, one)

    plausible = F.filter(loose["card"], lambda m: F.length(digits(m["hit"])).between(8, 24))
    parts = [
        judge("email", F.col("matches_email"), lambda m: F.lit(True)),
        judge("email", loose["email"], lambda m: F.lit(False)),
        judge("ip", F.col("matches_ip"), lambda m: valid("ip", m["hit"])),
        judge("card", plausible, lambda m: valid("card", m["hit"])),
        judge("phone", F.col("matches_phone"), lambda m: valid("phone", m["hit"])),
        judge("phone", loose["phone"], lambda m: F.lit(False)),
        judge("secret", loose["secret"], lambda m: F.lit(False)),
    ]
    return df.withColumn("proposed", F.concat(*parts))


class Reliability:
    """What expectation-maximisation found for one kind: prior and chances of each vote per labeler and truth."""

    def __init__(self, prior: float, chance: list):
        self.prior, self.chance = prior, chance

    def posterior(self, votes: tuple[int, ...]) -> float:
        odds = math.log(self.prior) - math.log(1 - self.prior)
        for j, vote in enumerate(votes):
            odds += math.log(self.chance[j][1][vote + 1]) - math.log(self.chance[j][0][vote + 1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def estimate(counts: dict[tuple[int, ...], float], rounds: int = 40) -> Reliability:
    """EM over vote combinations. It starts from the share of yes among the votes cast, which tells truth from error."""
    belief = {}
    for votes in counts:
        cast = [v for v in votes if v]
        belief[votes] = (1 + sum(v > 0 for v in cast)) / (2 + len(cast))
    total = sum(counts.values())
    model = Reliability(0.5, [])
    for _ in range(rounds):
        yes = sum(counts[v] * belief[v] for v in counts)
        chance = []
        for j in range(len(LABELERS)):
            seen = [[2.0, 1.0, 1.0], [1.0, 1.0, 2.0]]  # before it votes, a labeler is taken to be better than chance
            for votes, n in counts.items():
                seen[1][votes[j] + 1] += n * belief[votes]
                seen[0][votes[j] + 1] += n * (1 - belief[votes])
            chance.append([[x / sum(row) for x in row] for row in seen])
        model = Reliability((yes + 1) / (total + 2), chance)
        belief = {v: model.posterior(v) for v in counts}
    return model


def vote_names(kind: str, votes: tuple[int, ...]) -> list[str]:
    return [f"{kind}:{name}={vote}" for name, vote in zip(LABELERS, votes)]


def train_classifier(examples: list[tuple[list[str], float, float]], rounds: int = 300, pull: float = 1.0) -> dict[str, float]:
    """Logistic weights by feature name from (names, probability of yes, count), by steps against a diagonal bound."""
    weights: dict[str, float] = defaultdict(float)
    if not examples:
        return {}
    most = max(len(names) for names, _, _ in examples)
    mass: dict[str, float] = defaultdict(float)
    for names, _, n in examples:
        for name in names:
            mass[name] += n
    for _ in range(rounds):
        slope: dict[str, float] = defaultdict(float)
        for names, truth, n in examples:
            odds = sum(weights[x] for x in names)
            error = n * (truth - 1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
            for name in names:
                slope[name] += error
        for name in mass:
            weights[name] += (slope[name] - pull * weights[name]) / (mass[name] * most / 4 + pull)
    return dict(weights)


def fit(proposed: DataFrame) -> dict[str, float]:
    """Weights of the span classifier. The driver gets counts per votes and features, whose number has a fixed bound."""
    rows = proposed.select(F.explode("proposed").alias("p")).select("p.span.kind", "p.votes", "p.features", "p.base")
    counted = rows.groupBy("kind", "votes", "features").count().collect()
    by_kind: dict[str, dict] = defaultdict(lambda: defaultdict(float))
    for r in counted:
        by_kind[r["kind"]][tuple(r["votes"])] += r["count"]
    models = {kind: estimate(counts) for kind, counts in by_kind.items()}
    examples = []
    for r in sorted(counted, key=lambda r: (r["kind"], r["votes"], r["features"])):
        votes = tuple(r["votes"])
        truth = models[r["kind"]].posterior(votes)
        examples.append(([*r["features"], *vote_names(r["kind"], votes)], truth, float(r["count"])))
    return train_classifier(examples)


def accepted(p: Column, weights: dict[str, float]) -> Column:
    """Whether the classifier takes a proposal, from its features and votes."""
    if not weights:
        return F.lit(False)
    of = F.create_map(*[F.lit(x) for name, w in sorted(weights.items()) for x in (name, float(w))])
    kind = p["span"]["kind"]
    named = [
        F.concat(kind, F.lit(f":{name}="), F.element_at(p["votes"], j + 1).cast("string")) for j, name in enumerate(LABELERS)
    ]
    names = F.concat(p["features"], F.array(*named))
    score = F.aggregate(names, F.lit(0.0), lambda acc, n: acc + F.coalesce(F.try_element_at(of, n), F.lit(0.0)))
    return score >= 0


def listed(spans: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """`id`, `text`, `base` and `spans` (sorted arrays of spans), and the columns to `keep` as `kept0`, `kept1` ...

    Every row is read twice, once to learn the labelers' reliabilities.
    """
    held = [f"kept{i}" for i in range(len(keep))]
    rows = pick(df, id_col, text_col, *keep).toDF("id", "text", *held)
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    found = proposals(base_spans(rows))
    weights = fit(found)
    base = F.array_sort(F.concat(*[F.col(f"base_{k}") for k in BASE]))
    added = F.filter("proposed", lambda p: ~p["base"] & accepted(p, weights))
    fresh = F.transform(added, lambda p: p["span"])
    free = F.filter(fresh, lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    rowed = found.withColumn("base", base).withColumn("fresh", F.array_sort(free))
    apart = F.filter(
        "fresh", lambda s, i: (i == 0) | (F.element_at("fresh", F.greatest(i, F.lit(1)))["end"] <= s["start"])
    )
    out = rowed.withColumn("spans", F.array_sort(F.concat("base", apart)))
    return out.select("id", "base", "spans", *[f"base_{k}" for k in BASE], *held, "text")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("id").alias("doc_id"),
        *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, with every span in the text replaced by its kind in brackets.

    Spans that overlap are replaced as one, under the kind of the first. Null texts stay null.
    """
    names = df.columns
    found = find(df, id_col, text_col, keep=tuple(names))
    ends = running(F.transform("spans", lambda s: s["end"]), F.lit(0).cast("long"), lambda a, b: F.greatest(a, b))
    text = F.col("text")
    between = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))

    def piece(s: Column, before: Column) -> Column:
        fresh = F.concat(between(before, s["start"]), F.lit("["), s["kind"], F.lit("]"))
        return F.when(s["start"] >= before, fresh).otherwise(F.lit(""))

    held = found.withColumn("ends", ends)
    pieces = F.zip_with("spans", F.slice("ends", 1, F.size("spans")), piece)
    rest = between(F.element_at("ends", -1), F.length(text).cast("long"))
    clean = F.when(F.size("spans") == 0, text).otherwise(F.concat(F.array_join(pieces, ""), rest))
    at = names.index(text_col)
    clean = F.when(F.col(f"kept{at}").isNotNull(), clean)
    return held.select(*[clean.alias(n) if i == at else F.col(f"kept{i}").alias(n) for i, n in enumerate(names)])
