"""Words, phrases and patterns found in lines, and lines ranked for a query."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brakta.operators.detect import located

#: Letters that folding makes plain.
WORD = r"[\p{L}\p{N}]"
FOLD_FROM, FOLD_TO = "åäöéüÅÄÖÉÜ", "aaoeuAAOEU"


def folded(x: Column) -> Column:
    """Lower case without the diacritics of Nordic text; one letter stays one letter, so offsets hold."""
    return F.lower(F.translate(x, FOLD_FROM, FOLD_TO))


def phrase_pattern(words: str) -> str:
    """Words joined by any white space."""
    return r"\s+".join(re.escape(w) for w in words.split())


def find_phrase(lines: DataFrame, words: str, fold: bool = True, whole: bool = False) -> DataFrame:
    """(doc_id, line_no, text, start, end) of a phrase in lines, whatever its case and diacritics; ``whole``: only where no letter or digit touches it."""
    plain = words.lower().translate(str.maketrans(FOLD_FROM.lower(), FOLD_TO.lower(), "")) if fold else words
    hay = lines.withColumn("text", folded(F.col("text"))) if fold else lines
    hits = find_pattern(hay, phrase_pattern(plain))
    if not whole:
        return hits
    # The letters around a hit are read from its line; lines and hits are dealt alike by document and line.
    line = hay.select("doc_id", "line_no", F.col("text").alias("line"), F.col("start").alias("line_start"))
    near = hits.join(line, ["doc_id", "line_no"])
    at, end = F.col("start") - F.col("line_start"), F.col("end") - F.col("line_start")
    before = F.when(at > 0, F.col("line").substr(at.cast("int"), F.lit(1))).otherwise("")
    after = F.col("line").substr((end + 1).cast("int"), F.lit(1))
    return near.filter(~before.rlike(WORD) & ~after.rlike(WORD)).select("doc_id", "line_no", "text", "start", "end")


def boxes_of_hits(lines: DataFrame, hits: DataFrame, whole_line: bool = False) -> DataFrame:
    """(doc_id, line_no, start, end, x, y, w, h): a box for each hit, tight or as wide as its line. lines: with offsets and x, y, w, h."""
    line = lines.select("doc_id", "line_no", F.col("start").alias("line_start"), F.length("text").alias("n"), "x", "y", "w", "h")
    met = hits.join(line, ["doc_id", "line_no"])
    if whole_line:
        return met.select("doc_id", "line_no", "start", "end", "x", "y", "w", "h")
    edge = lambda c: F.floor(F.col("w") * (F.col(c) - F.col("line_start")) / F.greatest(F.col("n"), F.lit(1))).cast("long")
    return met.select("doc_id", "line_no", "start", "end", (F.col("x") + edge("start")).alias("x"), "y", F.greatest(F.lit(1), edge("end") - edge("start")).alias("w"), "h")


def find_pattern(lines: DataFrame, pattern: str) -> DataFrame:
    """Matches in each line, so none goes across lines or pages; offsets count in the document."""
    hits = lines.select("doc_id", "line_no", F.col("start").alias("line_start"), F.inline(located(F.col("text"), pattern)))
    return hits.select("doc_id", "line_no", "text", (F.col("line_start") + F.col("start")).alias("start"), (F.col("line_start") + F.col("end")).alias("end"))


def matches_per_document(hits: DataFrame) -> DataFrame:
    return hits.groupBy("doc_id").agg(F.count("*").alias("n_matches"), F.countDistinct("line_no").alias("n_lines"))


def bm25(lines: DataFrame, query: str, k: int, floor: float = 0.0, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc_id, line_no, score, place): the k best lines for a query, above a floor.

    Only lines with a query word are kept past the first filter; counts and the
    mean length come from one aggregate over all lines.
    """
    words = sorted(set(query.lower().split()))
    tokens = lines.select("doc_id", "line_no", F.split(F.lower("text"), r"\s+").alias("ws"))
    counted = tokens.select("doc_id", "line_no", F.size("ws").alias("len"), *[_count_of("ws", w).alias(f"tf{i}") for i, w in enumerate(words)])
    stats = counted.agg(F.count("*").alias("n_all"), F.avg("len").alias("mean_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    some = F.lit(False)
    for i in range(len(words)):
        some = some | (F.col(f"tf{i}") > 0)
    joined = counted.filter(some).crossJoin(F.broadcast(stats))  # one row of totals
    score = F.lit(0.0)
    for i in range(len(words)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n_all") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("mean_len")))
    scored = joined.select("doc_id", "line_no", score.alias("score")).filter(F.col("score") > floor)
    best = scored.orderBy(F.desc("score"), "doc_id", "line_no").limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id", "line_no")))


def _count_of(words: str, word: str) -> Column:
    return F.size(F.filter(words, lambda x: x == word))


def cursor_spans(text: Column, hits: Column) -> Column:
    """Spans of ordered hits, each looked for from the end of the last found; what is not found is skipped. hits: array of struct(label, text, confidence)."""
    init = F.struct(F.lit(1).alias("pos"), F.array().cast("array<struct<label:string,start:int,end:int>>").alias("out"))

    def put(acc: Column, h: Column) -> Column:
        at = F.position(h["text"], text, acc["pos"])
        end = at + F.length(h["text"])
        more = F.concat(acc["out"], F.array(F.struct(h["label"].alias("label"), (at - 1).alias("start"), (end - 1).alias("end"))))
        return F.struct(F.when(at > 0, end).otherwise(acc["pos"]).alias("pos"), F.when(at > 0, more).otherwise(acc["out"]).alias("out"))

    return F.aggregate(hits, init, put, lambda a: a["out"])
