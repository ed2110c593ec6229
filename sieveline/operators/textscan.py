"""Pattern scans over whole documents, prefix redaction, and integrity of files against a manifest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.arrays import located

# Patterns and severities of the privacy and identity scans.
LOCAL_USER_PATH = r"""(?i)([A-Z]:[\\/]+Users[\\/]+(?!<you>)[^\\/,\s;:\"'<>]+[\\/]+[^\s,;\"'<>]*)"""
PLACEHOLDER_USER_PATH = r"(?i)[A-Z]:[\\/]+Users[\\/]+<you>[\\/]+"
SECRET_ASSIGNMENT = r"""(?i)\b(api[_-]?key|secret|token|password|aws_access_key_id|github_token|kaggle_key)\b\s*[:=]\s*['"]?([A-Za-z0-9_\-]{12,})"""
EMAIL_ADDRESS = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
REPOSITORY_URL = r"(?i)https?://(?:www\.)?github\.com/[^\s)\]}]+"
AUTHOR_FIELD = r"\\author\{[^}]*\}"
ACKNOWLEDGMENT = r"(?im)^(?:\\section\*?\{Acknowledg|##+\s+Acknowledg)"
PUBLIC_WORDING = (
    r"(?i)\b(?:public repo|public GitHub|checked into the repository|public project|public release)\b"
)
MACHINE_READABLE_TYPES = ("result-data", "table", "quality-control", "planning", "claim-audit")
# end of fixed values


@dataclass(frozen=True)
class Rule:
    """A pattern, the severity of its matches, and a milder one for machine-readable documents."""

    issue: str
    pattern: str
    severity: str = "blocker"
    machine_severity: str | None = None
    unless: str | None = None


PRIVACY_RULES = (
    Rule("local_absolute_path", LOCAL_USER_PATH, "blocker", "warning"),
    Rule("secret_like_assignment", SECRET_ASSIGNMENT),
)
IDENTITY_RULES = (
    Rule("non_anonymous_author_field", AUTHOR_FIELD, unless=r"(?i)anonymous|\{\s*\}"),
    Rule("email_address", EMAIL_ADDRESS),
    Rule("github_url", REPOSITORY_URL),
    Rule("local_absolute_path", LOCAL_USER_PATH),
    Rule("public_repo_wording", PUBLIC_WORDING, "review"),
    Rule("acknowledgment_section", ACKNOWLEDGMENT, "review"),
)


def personal_rule(names: Sequence[str]) -> Rule:
    """A rule for the given personal names or handles."""
    return Rule("personal_identifier", r"(?i)\b(?:" + "|".join(names) + r")\b")


def unicode(pattern: str) -> str:
    """Word limits, word characters and blanks in the Unicode sense on every Java version."""
    return pattern if pattern.startswith("(?U)") else "(?U)" + pattern


def scan(df: DataFrame, ident: str, text: str, rules: Sequence[Rule], kind: str | None = None, around: int = 60) -> DataFrame:
    """One row per match of a rule: line, snippet of `around` characters either side, severity.

    The table is read once: a row's matches of all rules are one array.
    """
    whole = F.col(text)

    def found(number: int, rule: Rule) -> Column:
        pattern = unicode(rule.pattern)
        hits = located(whole, pattern, whole.rlike(pattern), lines=True)
        if rule.unless:
            hits = F.filter(hits, lambda m: ~m["hit"].rlike(rule.unless))
        return F.transform(hits, lambda m: F.struct(F.lit(number).alias("rule"), m["start"].alias("start"), m["hit"].alias("hit"), m["line"].alias("line")))

    every = F.concat(*[found(i, rule) for i, rule in enumerate(rules, 1)])
    rows = df.select(ident, text, *([kind] if kind else []), F.explode(every).alias("m"))
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("m.rule"))
    severity = of([r.severity for r in rules])
    if kind:
        milder = of([r.machine_severity or r.severity for r in rules])
        severity = F.when(F.col(kind).isin(*MACHINE_READABLE_TYPES), milder).otherwise(severity)
    left = F.greatest(F.col("m.start") - around, F.lit(0))
    upto = F.col("m.start") + F.length("m.hit") + around
    return rows.select(
        ident,
        *([kind] if kind else []),
        of([r.issue for r in rules]).alias("issue"),
        severity.alias("severity"),
        F.col("m.line").alias("line"),
        F.translate(F.substr(whole, left + 1, upto - left), "\r\n", "  ").alias("example"),
    )


def placeholder_counts(df: DataFrame, ident: str, text: str, pattern: str = PLACEHOLDER_USER_PATH) -> DataFrame:
    """Documents with placeholder paths and how many they hold."""
    n = F.regexp_count(F.col(text), F.lit(unicode(pattern)))
    return df.select(ident, n.alias("n_placeholders")).where(F.col("n_placeholders") > 0)


def unsafe_claims(df: DataFrame, ident: str, text: str, benchmark: str, claim: str, negation: str) -> DataFrame:
    """Lines that name a benchmark and make a claim without a negating word."""
    lines = df.select(ident, F.posexplode(F.split(text, r"\r\n|\r|\n", -1)).alias("_at", "line_text"))
    line = F.col("line_text")
    return lines.where(line.rlike(unicode(benchmark)) & line.rlike(unicode(claim)) & ~line.rlike(unicode(negation))).select(
        ident, (F.col("_at") + 1).alias("line"), F.trim("line_text").alias("line_text")
    )


def redact_prefixes(df: DataFrame, text: str, variants: Sequence[str], mark: str = "<repo>") -> DataFrame:
    """Replace every variant, longest first, and count the replacements."""
    out = df.withColumn("redacted", F.col(text)).withColumn("n_replaced", F.lit(0))
    for variant in sorted(set(variants), key=lambda v: (-len(v), v)):
        shorter = F.replace(F.col("redacted"), F.lit(variant), F.lit(""))
        count = (F.length("redacted") - F.length(shorter)) / len(variant)
        out = out.withColumn("_n", count.cast("int")).withColumn(
            "redacted", F.replace(F.col("redacted"), F.lit(variant), F.lit(mark))
        )
        out = out.withColumn("n_replaced", F.col("n_replaced") + F.col("_n")).drop("_n")
    return out


def hash_manifest(manifest: DataFrame, files: DataFrame, skipped: Sequence[str] = ()) -> DataFrame:
    """Manifest rows with existence, size, hash and status. `files` has (path, size_bytes, sha256)."""
    known = files.select("path", "size_bytes", "sha256").withColumn("_there", F.lit(True))
    joined = manifest.join(known, "path", "left")
    there, skip = F.col("_there").isNotNull(), F.col("path").isin(*skipped) if skipped else F.lit(False)
    status = F.when(skip, "index_or_self_skipped").when(there, "hashed").otherwise("missing")
    return joined.select(
        *manifest.columns,
        there.alias("exists"),
        "size_bytes",
        F.when(~skip, F.col("sha256")).alias("sha256"),
        status.alias("hash_status"),
    )


def hash_verify(hashes: DataFrame, files: DataFrame) -> DataFrame:
    """Check rows: recorded hashes and sizes against the files as they are now."""
    now = files.select("path", F.col("size_bytes").alias("_size"), F.col("sha256").alias("_sha")).withColumn("_there", F.lit(True))
    joined = hashes.join(now, "path", "left")
    hashed, there = F.col("hash_status") == "hashed", F.col("_there").isNotNull()
    valid = F.col("hash_status").isin("hashed", "missing", "index_or_self_skipped")
    counts = joined.agg(
        F.count_if(~F.coalesce(valid, F.lit(False))).alias("statuses"),
        F.count_if(hashed & ~there).alias("gone"),
        F.count_if(hashed & there & (F.col("sha256") != F.col("_sha"))).alias("changed"),
        F.count_if(hashed & there & (F.col("size_bytes") != F.col("_size"))).alias("resized"),
        F.count_if((F.col("hash_status") == "missing") & there).alias("back"),
    )
    rule = lambda name, c: F.struct(
        F.lit(name).alias("check"), (F.col(c) == 0).alias("passed"), F.col(c).alias("n_problems")
    )
    rows = F.array(
        rule("hash statuses valid", "statuses"),
        rule("hashed artifacts exist", "gone"),
        rule("sha256 values match", "changed"),
        rule("size values match", "resized"),
        rule("missing artifacts still absent", "back"),
    )
    return counts.select(F.explode(rows).alias("r")).select("r.*")
