"""Masking text, as expressions over an array of spans in the row: no shuffle beyond gathering the spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brakta.operators.boxes import is_visible
from brakta.operators.detect import Detector
from brakta.operators.filters import Rule, filtered

SPANS = "array<struct<start:int,end:int,ord:int,label:string>>"


def spans_by_document(spans: DataFrame) -> DataFrame:
    """(doc_id, spans, n_spans): sorted by start, end, then label and text."""
    order = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "label", "text", "confidence")
    return spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(order)).alias("spans"), F.count("*").alias("n_spans"))


def mask_from_right(text: Column, spans: Column) -> Column:
    """[LABEL] for each span, from the right; one that reaches into what is replaced already is skipped, or out of the text."""
    init = F.struct(F.array().cast("array<string>").alias("out"), F.length(text).alias("next"))

    # Pieces are kept from the right and joined once; the text itself is never built anew.
    def put(acc: Column, s: Column) -> Column:
        fits = (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= acc["next"])
        behind = text.substr(s["end"] + 1, acc["next"] - s["end"])
        new = F.concat(acc["out"], F.array(F.concat(F.lit("["), F.upper(s["label"]), F.lit("]"), behind)))
        return F.struct(F.when(fits, new).otherwise(acc["out"]).alias("out"), F.when(fits, s["start"]).otherwise(acc["next"]).alias("next"))

    return F.aggregate(F.reverse(spans), init, put, lambda a: F.concat(text.substr(F.lit(1), a["next"]), F.array_join(F.reverse(a["out"]), "")))


def mask_from_left(text: Column, spans: Column, display: Column) -> Column:
    """[display label] for each span, from the left; one that starts before the end of the last is skipped. ``display``: map of label to shown label."""
    init = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("pos"))

    def put(acc: Column, s: Column) -> Column:
        fits = s["start"] >= acc["pos"]
        shown = F.lower(F.coalesce(F.try_element_at(display, s["label"]), s["label"]))
        new = F.concat(acc["out"], F.array(F.concat(text.substr(acc["pos"] + 1, s["start"] - acc["pos"]), F.lit("["), shown, F.lit("]"))))
        return F.struct(F.when(fits, new).otherwise(acc["out"]).alias("out"), F.when(fits, s["end"]).otherwise(acc["pos"]).alias("pos"))

    return F.aggregate(spans, init, put, lambda a: F.concat(F.array_join(a["out"], ""), text.substr(a["pos"] + 1, F.length(text))))


def anonymize(docs: DataFrame, detector: Detector, rules: dict[str, Rule], threshold: float | None = 0.5, allow: list[str] | None = None) -> DataFrame:
    """(doc_id, text, spans, n_spans, masked_text): documents without spans stay as they are."""
    spans = spans_by_document(filtered(detector.detect(docs.select("doc_id", "text")), rules, threshold, allow))
    joined = docs.select("doc_id", "text").join(spans, "doc_id", "left")
    masked = F.when(F.col("spans").isNull(), F.col("text")).otherwise(mask_from_right(F.col("text"), F.col("spans")))
    return joined.select("doc_id", "text", "spans", F.coalesce("n_spans", F.lit(0)).alias("n_spans"), masked.alias("masked_text"))


def fills(boxes: DataFrame, active: list[str], key: str) -> DataFrame:
    """(key, rects): the rectangles that cover an image's visible boxes, in box order."""
    return boxes.filter(is_visible(active)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("box_id", "x", "y", "w", "h"))).alias("rects"))


def painted(images: DataFrame, rects: DataFrame, key: str, color: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """Images with their rectangles filled, as far as they lie in the image. images: (key, width, height, pixels: RGB bytes, row by row); one without rectangles stays."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = []
            for width, height, pixels, found in zip(part["width"], part["height"], part["pixels"], part["rects"], strict=True):
                image = np.frombuffer(pixels, np.uint8).reshape(height, width, 3).copy()
                for r in found if found is not None else ():
                    image[max(0, r["y"]) : max(0, r["y"] + r["h"]), max(0, r["x"]) : max(0, r["x"] + r["w"])] = color
                done.append(image.tobytes())
            yield part.drop(columns="rects").assign(pixels=done)

    plain = images.select(key, "width", "height", "pixels")
    return plain.join(rects.select(key, "rects"), key, "left").mapInPandas(run, plain.schema)
