"""Masking as a stream: the expressions work on one row, so no state is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brakta.functions.text import not_blank
from brakta.operators.detect import PATTERNS, located
from brakta.operators.filters import Rule, passes
from brakta.operators.redact import mask_from_right
from brakta.operators.taxonomy import ALIASES


def _kept(found: Column, key: str, rule: Rule) -> Column:
    passed = F.filter(found, lambda m: passes(rule, m["text"], F.lit(1.0)))
    return F.transform(passed, lambda m: F.struct(m["start"].cast("int").alias("start"), m["end"].cast("int").alias("end"), F.lit(key).alias("label"), m["text"].alias("text")))


def spans_in_row(text: Column, rules: dict[str, Rule], patterns: dict[str, str] | None = None) -> Column:
    """All spans of a text that pass their rules, sorted, as an array in the row."""
    lists = []
    for label, pattern in (patterns or PATTERNS).items():
        key = ALIASES.get(label, label)
        lists.append(_kept(located(text, pattern), key, rules.get(key, Rule())))
    return F.sort_array(F.flatten(F.array(*lists)))


def masked(docs: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """(doc_id, n_spans, masked_text); for batch and streaming DataFrames alike."""
    rows = docs.select("doc_id", "text", spans_in_row(F.col("text"), rules).alias("spans"))
    return rows.select("doc_id", F.size("spans").alias("n_spans"), F.when(F.size("spans") > 0, mask_from_right(F.col("text"), F.col("spans"))).otherwise(F.col("text")).alias("masked_text"))


def masked_stream(spark: SparkSession, path: str, rules: dict[str, Rule], out: str, checkpoint: str) -> None:
    """Reads documents as they arrive and appends them masked; returns when what is there is done."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(path)
    masked(stream, rules).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def progress_frames(pages: DataFrame) -> DataFrame:
    """(image_id, place, stage, error): the stages a page's run reports; the detector starts only on a text that is not blank.

    A run that fails reports what it had begun, and then ``done`` with its error, on which nothing follows.
    pages: (image_id, text), and failed_at (input, ocr or detection; null where nothing failed) with error where
    runs can fail.  A text that is blank reaches no detector, so none fails there.
    """
    spoken = not_blank(F.col("text"))
    failed, error = (F.col("failed_at"), F.col("error")) if "failed_at" in pages.columns else (F.lit(None).cast("string"), F.lit(None).cast("string"))
    stages = lambda *names: F.array(*map(F.lit, names))
    broken = (failed == "input") | (failed == "ocr") | ((failed == "detection") & spoken)
    reported = (
        F.when(failed == "input", stages("done")).when(failed == "ocr", stages("ocr_started", "done"))
        .when(spoken, stages("ocr_started", "ocr_done", "detection_started", "done")).otherwise(stages("ocr_started", "ocr_done", "done"))
    )
    frames = pages.select("image_id", F.when(broken, F.coalesce(error, F.lit("unknown"))).alias("e"), F.posexplode(reported).alias("place", "stage"))
    return frames.select("image_id", "place", "stage", F.when(F.col("stage") == "done", F.col("e")).alias("error"))
