"""Detectors: anything that turns (doc_id, text) into a long table of spans.

A span is (doc_id, label, text, start, end, confidence) with a half-open
[start, end) counted in code points.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brakta.functions.text import not_blank

SPAN = ("doc_id", "label", "text", "start", "end", "confidence")

# Patterns in the subset that Java and RE2 share; none looks around, so matches can be located by splitting.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ip_address": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "card_number": r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}",
    "phone": r"\+[0-9]{1,3}[ -]\(?[0-9]{2,4}\)?[ -][0-9][0-9 -]{5,}[0-9]",
}


class Detector(Protocol):
    """``detect`` takes (doc_id, text) rows and returns spans; models are adapters of this shape."""

    def detect(self, docs: DataFrame) -> DataFrame: ...


#: A character that every match of a pattern holds: texts without it are not searched.
GUARDS = {PATTERNS["email"]: "@", PATTERNS["ip_address"]: ".", PATTERNS["phone"]: "+"}
#: A code point that no text holds by Unicode's rules; one that does is read as U+FFFD there.
MARK = "\ufffe"
#: Parts that are folded at a time: a list that grows part by part is copied as often as it has parts.
BLOCK = 256


def located(text: Column, pattern: str) -> Column:
    """Array of (text, start, end) of all matches; the pattern runs once.

    Matches are marked in the text, which is then split at the marks: parts are gaps and matches in turn,
    and each starts where the one before it ends.
    """
    clean = F.when(F.contains(text, F.lit(MARK)), F.replace(text, F.lit(MARK), F.lit("\ufffd"))).otherwise(text)
    parts = F.split(F.regexp_replace(clean, pattern, MARK + "$0" + MARK), MARK, -1)
    none = F.array().cast("array<struct<text:string,start:int,end:int>>")

    def put(acc: Column, part: Column) -> Column:
        end = acc["end"] + F.length(part)
        found = F.struct(part.alias("text"), acc["end"].alias("start"), end.alias("end"))
        return F.struct(end.alias("end"), (~acc["hit"]).alias("hit"), F.when(acc["hit"], F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, parts: Column, first: Column) -> Column:
        start = F.struct(acc["end"].alias("end"), acc["hit"].alias("hit"), none.alias("out"))
        return F.aggregate(F.slice(parts, first, F.lit(BLOCK)), start, put, lambda x: F.struct(x["end"].alias("end"), x["hit"].alias("hit"), F.concat(acc["out"], x["out"]).alias("out")))

    def folded(parts: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(False).alias("hit"), none.alias("out"))
        return F.when(F.size(parts) == 1, none).otherwise(F.aggregate(F.sequence(F.lit(1), F.size(parts), F.lit(BLOCK)), start, lambda acc, first: block(acc, parts, first), lambda acc: acc["out"]))

    # The parts are bound to a name, so that they are made once however often they are read.
    found = F.transform(F.array(parts), folded)[0]
    guard = GUARDS.get(pattern)
    here = F.contains(text, F.lit(guard)) if guard else F.lit(True)
    return F.when(text.isNotNull(), F.when(here, found).otherwise(none))


class PatternDetector:
    """Regular expressions with a fixed confidence each."""

    def __init__(self, patterns: dict[str, str] | None = None, confidence: dict[str, float] | None = None):
        self.patterns, self.confidence = patterns or PATTERNS, confidence or {}

    def detect(self, docs: DataFrame) -> DataFrame:
        """One scan: a document without matches yields no row, and only matches leave the array."""
        lists = [self._labelled(label, located(F.col("text"), p)) for label, p in self.patterns.items()]
        return docs.filter(not_blank(F.col("text"))).select("doc_id", F.inline(F.flatten(F.array(*lists))))

    def _labelled(self, label: str, matches: Column) -> Column:
        sure = F.lit(float(self.confidence.get(label, 1.0)))
        return F.transform(matches, lambda m: F.struct(F.lit(label).alias("label"), m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"), sure.alias("confidence")))


class TableDetector:
    """Spans made elsewhere, as a table of raw candidates."""

    def __init__(self, candidates: DataFrame):
        self.candidates = candidates

    def detect(self, docs: DataFrame) -> DataFrame:
        return clean_candidates(self.candidates).join(docs.filter(not_blank(F.col("text"))).select("doc_id"), "doc_id", "left_semi")


def clean_candidates(raw: DataFrame) -> DataFrame:
    """Raw candidates as spans: without whole-number offsets a row is dropped; no text is '', no confidence is 1."""
    start, end = (F.expr(f"try_cast({c} AS int)").alias(c) for c in ("start", "end"))
    rows = raw.select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text"), start, end, F.coalesce(F.expr("try_cast(confidence AS double)"), F.lit(1.0)).alias("confidence"))
    return rows.filter("start IS NOT NULL AND end IS NOT NULL")


def browser_label(row_label: Column, fallback: Column) -> Column:
    """Labels of a token classifier in lower case; 'misc' if it names none."""
    return F.lower(F.coalesce(row_label, fallback, F.lit("misc")))
