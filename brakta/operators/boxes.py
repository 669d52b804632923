"""Analytics over the boxes of an editor session, as relations keyed by page and box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brakta.functions.text import stripped
from brakta.plans.order import in_order


def counts_by_label(boxes: DataFrame) -> DataFrame:
    return boxes.filter("label <> 'custom'").groupBy("label").agg(F.count("*").alias("n"))


def is_visible(active: list[str]) -> Column:
    """Enabled, and custom or of an active category; a drawn box with a real label follows the categories too."""
    return F.col("enabled") & ((F.col("label") == "custom") | F.col("label").isin(active))


def duplicates(boxes: DataFrame) -> DataFrame:
    """(label, key, n): texts, trimmed and in lower case, that two boxes or more of a label share."""
    return boxes.withColumn("key", F.lower(stripped(F.col("text")))).filter("key <> ''").groupBy("label", "key").agg(F.count("*").alias("n")).filter("n >= 2")


def duplicate_ids(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("key", F.lower(stripped(F.col("text")))).join(duplicates(boxes).select("label", "key"), ["label", "key"], "left_semi").select("box_id")


def all_boxes(stored: DataFrame, live: DataFrame, page: str = "page_id") -> DataFrame:
    """Boxes of all pages, the live copy in place of a stored page's."""
    return stored.join(live.select(page).distinct(), page, "left_anti").unionByName(live)


def with_confidence(boxes: DataFrame, spans: DataFrame, page: str = "page_id") -> DataFrame:
    """Each box with the confidence of its page's first span of the same label and text; null for custom boxes and without one."""
    first = spans.groupBy(page, "label", "text").agg(F.min_by("confidence", "span_no").alias("confidence"))
    return boxes.join(first, [page, "label", "text"], "left").withColumn("confidence", F.when(~F.col("custom"), F.col("confidence")))


def pills(boxes: DataFrame, meta: DataFrame) -> DataFrame:
    """(label, n, display, color, place): labels by count, equals by first appearance; unknown ones in grey under their own name."""
    seen = boxes.groupBy("label").agg(F.count("*").alias("n"), F.min("box_id").alias("first_seen")).join(F.broadcast(meta), "label", "left")
    return seen.select("label", "n", F.coalesce("display", "label").alias("display"), F.coalesce("color", F.lit("#94a3b8")).alias("color"), F.row_number().over(Window.orderBy(F.desc("n"), "first_seen")).cast("long").alias("place"))


def search_rows(boxes: DataFrame, meta: DataFrame, query: str, labels: list[str] | None = None, page: int | None = None) -> DataFrame:
    """Boxes of a page and label set whose text, shown label or label key holds the query, whatever its case."""
    rows = boxes.join(F.broadcast(meta.select("label", "display")), "label", "left")
    if page is not None:
        rows = rows.filter(F.col("page_id") == page)
    if labels:
        rows = rows.filter(F.col("label").isin(labels))
    q = query.strip().lower()
    hay = [F.lower("text"), F.lower(F.coalesce("display", "label")), F.lower("label")]
    test = hay[0].contains(q) | hay[1].contains(q) | hay[2].contains(q)
    return rows.filter(test) if q else rows


def merged_meta(base: DataFrame, custom: DataFrame) -> DataFrame:
    """Known labels with custom ones laid over."""
    b, c = base.alias("b"), custom.alias("c")
    return b.join(c, "label", "full_outer").select("label", F.coalesce("c.color", "b.color").alias("color"), F.coalesce("c.display", "b.display").alias("display"))


def without(boxes: DataFrame, ids: DataFrame) -> DataFrame:
    return boxes.join(ids, "box_id", "left_anti")


def relabelled(boxes: DataFrame, ids: DataFrame, label: str) -> DataFrame:
    hit = boxes.join(ids.select("box_id", F.lit(True).alias("hit")), "box_id", "left")
    return hit.withColumn("label", F.when(F.col("hit"), label).otherwise(F.col("label"))).drop("hit")


def rerun(old: DataFrame, fresh: DataFrame, failed: DataFrame, page: str = "page_id") -> DataFrame:
    """After a new run: fresh boxes and drawn ones; a page that failed keeps all it had."""
    kept = old.join(failed.select(page), page, "left_semi")
    drawn = old.join(failed.select(page), page, "left_anti").filter("custom")
    return fresh.join(failed.select(page), page, "left_anti").unionByName(drawn).unionByName(kept)


def active_labels(boxes: DataFrame) -> DataFrame:
    return boxes.filter("label <> 'custom'").select("label").distinct()


def edited(boxes: DataFrame, changes: DataFrame) -> DataFrame:
    """Boxes with changed text, label or enabled flag, where a change is given; removed ones left out. changes: (box_id, new_text, new_label, new_enabled, removed)."""
    rows = boxes.join(changes, "box_id", "left").filter(~F.coalesce("removed", F.lit(False)))
    for c in ("text", "label", "enabled"):
        rows = rows.withColumn(c, F.coalesce(f"new_{c}", c))
    return rows.select(boxes.columns)


def numbered(results: DataFrame, first_id: int = 0) -> DataFrame:
    """Result boxes as editor boxes: ids in page and span order, enabled, not custom.

    Ranks are counted in ranges of pages, each a task, and not in one task for all.
    """
    ranked = in_order(results, [F.col("page_id").asc(), F.col("span_no").asc()], "boxes", "box_id")
    return ranked.withColumns({"box_id": F.col("box_id") + first_id, "enabled": F.lit(True), "custom": F.lit(False)})


def select_only(boxes: DataFrame, box_id: int) -> DataFrame:
    """The one box that a click selects."""
    return boxes.filter(F.col("box_id") == box_id).select("box_id")


def select_toggled(boxes: DataFrame, selected: DataFrame, box_id: int) -> DataFrame:
    """The selection with one box taken in, or out if it was in."""
    one = select_only(boxes, box_id)
    return selected.select("box_id").join(one, "box_id", "left_anti").unionByName(one.join(selected.select("box_id"), "box_id", "left_anti"))


def select_all(boxes: DataFrame, active: list[str]) -> DataFrame:
    """All visible boxes."""
    return boxes.filter(is_visible(active)).select("box_id")


def selected_range(boxes: DataFrame, active: list[str], a: int, b: int) -> DataFrame:
    """Visible boxes between two, in list order."""
    return boxes.filter(is_visible(active)).filter(F.col("box_id").between(min(a, b), max(a, b))).select("box_id")
