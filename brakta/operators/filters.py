"""Post-filters: they reject spans and never invent any."""

from __future__ import annotations

import re
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brakta.functions.text import luhn_ok, not_blank
from brakta.operators import taxonomy


@dataclass(frozen=True)
class Rule:
    """What a label's spans must meet; the defaults let all pass."""

    regex: str = ""
    mode: str = "full"
    threshold: float = 0.0
    luhn: bool = False


DEFAULT_RULES = {k: Rule(regex=taxonomy.DEFAULT_PATTERNS.get(k, "")) for k in taxonomy.DEFAULT_ENABLED}


def in_java(pattern: str | None) -> str:
    """A rule's pattern as the engine reads it, without white space around it, named groups in its spelling; '' where it is blank or invalid, which switches it off."""
    own = (pattern or "").strip()
    try:
        re.compile(own)
    except re.error:
        return ""
    own = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", re.sub(r"\(\?P<(\w+)>", r"(?<\1>", own))
    spark = SparkSession.getActiveSession()
    if own and spark is not None:
        try:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(own)
        except (Py4JJavaError, PySparkException):
            return ""
    return own


def usable(pattern: str | None) -> bool:
    """Blank and invalid patterns are off."""
    return in_java(pattern) != ""


def preview(rule: Rule, sample: Column, confidence: Column | None = None) -> Column:
    """What a rule says of a sample text: 'empty' (nothing to try), 'invalid' (its pattern cannot be read), 'ok' or 'reject'."""
    blank = ~F.coalesce(not_blank(sample), F.lit(False))
    if (rule.regex or "").strip() and not usable(rule.regex):
        return F.when(blank, "empty").otherwise("invalid")
    return F.when(blank, "empty").when(passes(rule, sample, F.lit(1.0) if confidence is None else confidence), "ok").otherwise("reject")


def aliased(label: Column) -> Column:
    """Trained label names as the keys results are shown under."""
    out = label
    for name, key in taxonomy.ALIASES.items():
        out = F.when(label == name, key).otherwise(out)
    return out


def allowed(spans: DataFrame, labels: list[str] | None) -> DataFrame:
    """Only the labels given; none given, or an empty list, means all."""
    return spans.filter(F.col("label").isin(list(labels))) if labels else spans


def passes(rule: Rule, text: Column, confidence: Column) -> Column:
    ok = F.lit(True)
    if rule.threshold > 0:
        ok = ok & (confidence >= rule.threshold)
    regex = in_java(rule.regex)
    if regex:
        if rule.mode == "full":  # the leftmost match must be the whole text, which is less than a full match
            ok = ok & text.rlike(regex) & (F.regexp_extract(text, regex, 0) == text)
        elif rule.mode == "partial":
            ok = ok & text.rlike(regex)
        elif rule.mode == "exclude":
            ok = ok & ~text.rlike(regex)
    return ok & luhn_ok(text) if rule.luhn else ok


def filtered(spans: DataFrame, rules: dict[str, Rule], threshold: float | None = 0.5, allow: list[str] | None = None) -> DataFrame:
    """Global floor (0 and none mean 0.5), alias, allow-list, then each label's rule: one CASE, so every pattern is compiled once."""
    spans = spans.filter(F.col("confidence") >= (threshold or 0.5)).withColumn("label", aliased(F.col("label")))
    spans = allowed(spans, allow)
    ok = None
    for label, rule in rules.items():
        test = passes(rule, F.col("text"), F.col("confidence"))
        ok = F.when(F.col("label") == label, test) if ok is None else ok.when(F.col("label") == label, test)
    return spans if ok is None else spans.filter(ok.otherwise(True))


def within(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans that end within their document's text."""
    return spans.join(docs.select("doc_id", F.length("text").alias("n_text")), "doc_id").filter("end <= n_text").drop("n_text")


def customised(rules: DataFrame, base: DataFrame) -> DataFrame:
    """(label, customised): whether a label's rule differs from the default, nulls compared as values. Both: (label, regex, mode, threshold, luhn)."""
    columns = ("regex", "mode", "threshold", "luhn")
    known = base.select("label", *[F.col(c).alias(f"base_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"base_{c}"))
    return rules.join(known, "label").select("label", (~same).alias("customised"))


def rule_counts(rules: DataFrame) -> DataFrame:
    """(n_rules, n_active): labels with a rule, and those whose rule can reject anything."""
    active = (F.trim(F.coalesce("regex", F.lit(""))) != "") | (F.col("threshold") > 0) | F.col("luhn")
    return rules.agg(F.count("*").alias("n_rules"), F.count_if(active).alias("n_active"))


def toggled(enabled: Column, label: Column) -> Column:
    """A list of labels with one taken out, or put at its end if it was not in."""
    return F.when(F.array_contains(enabled, label), F.array_remove(enabled, label)).otherwise(F.array_append(enabled, label))


def without_labels(gone: list[str], *tables: DataFrame) -> tuple[DataFrame, ...]:
    """Labels taken out, with all that hangs on them: from each table with a column ``label`` (rules, enabled labels, descriptions)."""
    return tuple(t.filter(~F.col("label").isin(gone)) if gone else t for t in tables)


def label_descriptions(base: dict[str, str], overrides: dict[str, str], custom: list[dict]) -> dict[str, str]:
    """Descriptions a detector is asked with: known keys may be reworded, custom labels are added."""
    out = {k: overrides.get(k) or v for k, v in base.items()}
    return out | {c["key"]: c.get("description") or c.get("displayLabel", c["key"]) for c in custom}
