"""Lines, boxes and what an editor shows of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brakta.operators import boxes as B
from brakta.operators import geometry as G
from brakta.operators import taxonomy
from brakta.operators.redact import fills
from brakta.functions.text import SPACE, not_blank
from brakta.queries.base import BOXES, LINES, NOT_BLANK, boxes, documents, lines
from brakta.queries.detection import _values
from brakta.streaming.masking import progress_frames

POLYS = [(1, 0, ["a b", "", "cd", "x"], [[[1.9, 2.0], [10.2, 8.7]], [[0.0, 0.0], [1.0, 1.0]], [[3.0], [4.0, 4.0]]]), (1, 1, ["next", None], [[[5.0, 6.0], [2.0, 9.5], [7.0, 1.0]], [[0.0, 0.0], [1.0, 1.0]]]), (2, 0, ["solo"], [[[0.0, 0.0], [30.0, 10.0]]])]


def polygon_lines(spark: SparkSession, d: str) -> DataFrame:
    """Skipped blanks and broken polygons, offsets that go on across pages."""
    pages = spark.createDataFrame(POLYS, "image_id int, page_no int, texts array<string>, polys array<array<array<double>>>")
    return G.page_lines(pages).select("image_id", "line_no", "text", "start", "end", "x", "y", "w", "h")


def line_offsets(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("doc_id", "line_no", "text", "start", "end", "y", "w")


def polygon_counters(spark: SparkSession, d: str) -> DataFrame:
    """Lines as recognised texts: every fifth polygon is broken, every other page has one polygon more than texts."""
    i = F.col("doc_id")
    rows = documents(spark, d).select(i.alias("image_id"), F.split("text", "\n", -1).alias("texts"))
    point = lambda k, more: F.array((k + more).cast("double"), (k * 2 + more).cast("double"))
    poly = lambda k: F.when((F.col("image_id") + k) % 5 == 0, F.array(F.array(k.cast("double")))).otherwise(F.array(point(k, 0), point(k, 7)))
    return G.ocr_counters(rows.withColumn("polys", F.transform(F.sequence(F.lit(1), (F.size("texts") + F.col("image_id") % 2).cast("int")), poly)))


def joined_lines(spark: SparkSession, d: str) -> DataFrame:
    return G.joined_text(lines(spark, d), "doc_id")


def line_counters(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d).select(F.explode(F.split("text", "\n", -1)).alias("t"))
    return rows.agg(F.count("*").alias("detected"), F.count_if(F.col("t") != "").alias("recognised"), F.count_if(not_blank(F.col("t"))).alias("kept"))


def lines_for_wire(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).drop("start", "end", "pos", "text")


def span_boxes(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).select("doc_id", "span_no", "label", "text", "x", "y", "w", "h")


def text_under_boxes(spark: SparkSession, d: str) -> DataFrame:
    return G.text_in_box(boxes(spark, d).select("doc_id", "box_id", "x", "y", "w", "h"), lines(spark, d), "doc_id")


def overlapping_boxes(spark: SparkSession, d: str) -> DataFrame:
    visible = boxes(spark, d).filter(B.is_visible(["person", "email"]))
    return G.overlapping_ids(visible, "doc_id")


def hit_boxes(spark: SparkSession, d: str) -> DataFrame:
    points = documents(spark, d).select("doc_id", F.col("doc_id").alias("point_id"), (F.col("doc_id") * 7 % 600).alias("px"), (F.col("doc_id") * 3 % 60).alias("py"))
    return G.hit_test(points, boxes(spark, d), "doc_id")


def box_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Drawing, moving, resizing, rounding and thumbnails, on order keys."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") * 37 % 900 - 50).cast("double").alias("a"), (F.col("o_orderkey") * 53 % 700 - 40).cast("double").alias("b"))
    w, h = F.lit(800.0), F.lit(600.0)
    draw = G.drawn(F.col("a"), F.col("b"), F.col("b"), F.col("a"), w, h)
    move = G.moved(F.col("a") + 0.5, F.col("b") - 0.5, F.lit(40), F.lit(30), F.lit(800), F.lit(600))
    handle = F.element_at(F.array(*map(F.lit, ("n", "se", "w", "nw"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    size = G.resized({"x": F.lit(100.0), "y": F.lit(120.0), "w": F.lit(200.0), "h": F.lit(80.0)}, handle, F.col("a"), F.col("b"), w, h)
    small = G.thumbnail(F.col("o_orderkey") % 900 + 1, F.col("o_orderkey") % 500 + 1)
    part = G.fraction_box(F.lit(801), F.lit(333), F.lit(0.08), F.lit(0.1), (F.col("o_orderkey") % 7) / 10, F.lit(0.001))
    out = {f"{p}_{k}": v for p, m in (("draw", draw), ("move", move), ("size", size), ("thumb", small), ("part", part)) for k, v in m.items()}
    return o.select("o_orderkey", G.big_enough(draw["w"], draw["h"]).alias("accepted"), *[v.cast("long").alias(k) for k, v in out.items()])


def recaptured_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Every third box moved, or its lower right corner dragged; drawn ones take the text under them."""
    b, k = boxes(spark, d), F.col("box_id")
    edits = b.filter(k % 3 == 0).select("box_id", F.when(k % 2 == 1, "se").alias("handle"), (k % 400).cast("double").alias("px"), (k * 7 % 90).cast("double").alias("py"))
    return G.edited(b, edits, lines(spark, d), "doc_id", F.lit(800), F.lit(600)).select("box_id", "x", "y", "w", "h", "text")


def page_fills(spark: SparkSession, d: str) -> DataFrame:
    """The solid rectangles of each page's masks."""
    return fills(boxes(spark, d), ["person", "email"], "page_id").select("page_id", F.inline("rects"))


def custom_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Drawn boxes appended to a page, with the text under them."""
    drawn = documents(spark, d).select("doc_id", (F.col("doc_id") * 1000000 + 999999).alias("box_id"), F.lit(10).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(300).cast("long").alias("w"), F.lit(30).cast("long").alias("h"))
    with_text = drawn.join(G.text_in_box(drawn, lines(spark, d), "doc_id"), "box_id")
    made = with_text.select("doc_id", "box_id", F.lit("custom").alias("label"), "text", F.lit(True).alias("enabled"), F.lit(True).alias("custom"))
    return boxes(spark, d).select("doc_id", "box_id", "label", "text", "enabled", "custom").unionByName(made)


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return B.counts_by_label(boxes(spark, d))


def visible_boxes(spark: SparkSession, d: str) -> DataFrame:
    return boxes(spark, d).filter(B.is_visible(["person", "address"])).select("box_id", "label")


def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return B.duplicates(boxes(spark, d))


def duplicate_box_ids(spark: SparkSession, d: str) -> DataFrame:
    return B.duplicate_ids(boxes(spark, d))


def boxes_of_all_pages(spark: SparkSession, d: str) -> DataFrame:
    stored = boxes(spark, d).select("page_id", "box_id", "label")
    live = stored.filter("page_id % 10 = 0").withColumn("label", F.lit("edited"))
    return B.all_boxes(stored, live)


def boxes_with_confidence(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    spans = b.select("page_id", "label", "text", "span_no", (1 - F.col("span_no") / 100.0).alias("confidence"))
    return B.with_confidence(b, spans).select("box_id", F.round("confidence", 6).alias("confidence"))


def label_pills(spark: SparkSession, d: str) -> DataFrame:
    return B.pills(boxes(spark, d), taxonomy.meta_table(spark))


def searched_boxes(spark: SparkSession, d: str) -> DataFrame:
    return B.search_rows(boxes(spark, d), taxonomy.meta_table(spark), " PERSON", None, None).unionByName(B.search_rows(boxes(spark, d), taxonomy.meta_table(spark), "span 1", ["email", "custom"], 12)).select("box_id", "label")


def label_meta_with_custom(spark: SparkSession, d: str) -> DataFrame:
    custom = spark.createDataFrame([("email", "#000000", "Mail"), ("badge", "#111111", "Badge")], "label string, color string, display string")
    return B.merged_meta(taxonomy.meta_table(spark), custom)


def _picked(b: DataFrame) -> DataFrame:
    return b.filter("box_id % 7 = 0").select("box_id")


def bulk_deleted(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    return B.without(b, _picked(b)).select("box_id", "label")


def bulk_relabelled(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d)
    return B.relabelled(b, _picked(b), "iban").select("box_id", "label")


def rerun_merge(spark: SparkSession, d: str) -> DataFrame:
    old = boxes(spark, d).select("page_id", "box_id", "label", "custom")
    fresh = old.filter("not custom").withColumn("box_id", F.col("box_id") + 500)
    failed = old.filter("page_id % 9 = 0").select("page_id").distinct()
    return B.rerun(old, fresh, failed)


def active_labels(spark: SparkSession, d: str) -> DataFrame:
    return B.active_labels(boxes(spark, d))


def edited_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = boxes(spark, d).select("box_id", "label", "text", "enabled")
    changes = b.filter("box_id % 5 = 0").select("box_id", F.lit("new text").alias("new_text"), F.lit(None).cast("string").alias("new_label"), (F.col("box_id") % 2 == 0).alias("new_enabled"), (F.col("box_id") % 15 == 0).alias("removed"))
    return B.edited(b, changes)


def numbered_boxes(spark: SparkSession, d: str) -> DataFrame:
    rows = boxes(spark, d).select("page_id", "span_no", "label")
    return B.numbered(rows).select("page_id", "span_no", "box_id", "enabled", "custom")


def selected_boxes(spark: SparkSession, d: str) -> DataFrame:
    return B.selected_range(boxes(spark, d), ["person"], 90_000_000, 30_000_000)


def page_progress(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth page fails somewhere."""
    n = F.pmod("doc_id", F.lit(20))
    failed = F.when(n == 3, "input").when(n == 8, "ocr").when(n == 13, "detection").when(n == 18, "detection")
    return progress_frames(documents(spark, d).select(F.col("doc_id").alias("image_id"), "text", failed.alias("failed_at"), F.concat(F.lit("RuntimeError: page "), F.col("doc_id").cast("string")).alias("error")))


QUERIES = {f.__name__: f for f in (polygon_lines, line_offsets, joined_lines, line_counters, polygon_counters, recaptured_boxes, page_fills, lines_for_wire, span_boxes, text_under_boxes, overlapping_boxes, hit_boxes, box_geometry, custom_boxes, label_counts, visible_boxes, duplicate_groups, duplicate_box_ids, boxes_of_all_pages, boxes_with_confidence, label_pills, searched_boxes, label_meta_with_custom, bulk_deleted, bulk_relabelled, rerun_merge, active_labels, edited_boxes, numbered_boxes, selected_boxes, page_progress)}

_VISIBLE = lambda *active: "enabled AND (label = 'custom' OR label IN (" + ", ".join(f"'{a}'" for a in active) + "))"
_MEET = "least(b.x + b.w, n.x + n.w) - greatest(b.x, n.x) > 0 AND least(b.y + b.h, n.y + n.h) - greatest(b.y, n.y) > 0 AND ((n.x + n.w / 2 BETWEEN b.x AND b.x + b.w AND n.y + n.h / 2 BETWEEN b.y AND b.y + b.h) OR (least(b.x + b.w, n.x + n.w) - greatest(b.x, n.x)) * (least(b.y + b.h, n.y + n.h) - greatest(b.y, n.y)) / greatest(1, n.w * n.h) >= 0.3)"
_META = _values([(k, c, v) for k, (c, v) in taxonomy.META.items()], "label, color, display")
_UNDER = lambda rel: f"SELECT b.box_id, coalesce(string_agg(n.text, ' ' ORDER BY n.line_no), '') AS text FROM {rel} b LEFT JOIN lines n ON b.doc_id = n.doc_id AND {_MEET} GROUP BY b.box_id"

SQL = {
    "polygon_lines": "SELECT * FROM " + _values([(1, 0, "a b", 0, 3, 1, 2, 9, 6), (1, 1, "next", 4, 8, 2, 1, 5, 8), (2, 0, "solo", 0, 4, 0, 0, 30, 10)], 'image_id, line_no, text, "start", "end", x, y, w, h'),
    "line_offsets": f'WITH {LINES} SELECT doc_id, line_no, text, "start", "end", y, w FROM lines',
    "joined_lines": f"WITH {LINES} SELECT doc_id, string_agg(text, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY doc_id",
    "line_counters": f"WITH {LINES} SELECT count(*) AS detected, count(*) FILTER (text <> '') AS recognised, count(*) FILTER ({NOT_BLANK}) AS kept FROM lines0",
    "lines_for_wire": f"WITH {LINES} SELECT doc_id, line_no, x, y, w, h FROM lines",
    "span_boxes": f"WITH {BOXES} SELECT doc_id, span_no, label, text, x, y, w, h FROM boxes",
    "text_under_boxes": f"WITH {BOXES} {_UNDER('boxes')}",
    "overlapping_boxes": f"WITH {BOXES}, v AS (SELECT * FROM boxes WHERE {_VISIBLE('person', 'email')}) SELECT DISTINCT a.box_id FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.box_id <> b.box_id AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h",
    "hit_boxes": f"WITH {BOXES} SELECT d.doc_id AS point_id, max(box_id) AS box_id FROM documents d JOIN boxes b ON d.doc_id = b.doc_id AND d.doc_id * 7 % 600 BETWEEN x AND x + w AND d.doc_id * 3 % 60 BETWEEN y AND y + h GROUP BY d.doc_id",
    "box_geometry": """
        WITH p AS (SELECT o_orderkey, o_orderkey % 4 AS hd, CAST(o_orderkey * 37 % 900 - 50 AS DOUBLE) AS a, CAST(o_orderkey * 53 % 700 - 40 AS DOUBLE) AS b FROM orders),
        q AS (SELECT *, ['n','se','w','nw'][hd + 1] AS hn FROM p),
        e AS (SELECT *, greatest(0.0, CASE WHEN contains(hn, 'w') THEN least(a, 296.0) ELSE 100.0 END) AS l, greatest(0.0, CASE WHEN contains(hn, 'n') THEN least(b, 196.0) ELSE 120.0 END) AS t,
                     least(800.0, CASE WHEN contains(hn, 'e') THEN greatest(a, 104.0) ELSE 300.0 END) AS r, least(600.0, CASE WHEN contains(hn, 's') THEN greatest(b, 124.0) ELSE 200.0 END) AS m,
                     least(1.0, 240.0 / greatest(o_orderkey % 900 + 1, o_orderkey % 500 + 1)) AS sc FROM q)
        SELECT o_orderkey, least(abs(b - a), 800.0) > 3 AND least(abs(a - b), 600.0) > 3 AS accepted,
               CAST(greatest(0, least(800.0, least(a, b))) AS BIGINT) AS draw_x, CAST(greatest(0, least(600.0, least(b, a))) AS BIGINT) AS draw_y, CAST(least(abs(b - a), 800.0) AS BIGINT) AS draw_w, CAST(least(abs(a - b), 600.0) AS BIGINT) AS draw_h,
               CAST(greatest(0, least(floor(a + 1.0), 760)) AS BIGINT) AS move_x, CAST(greatest(0, least(floor(b), 570)) AS BIGINT) AS move_y,
               CAST(floor(l + 0.5) AS BIGINT) AS size_x, CAST(floor(t + 0.5) AS BIGINT) AS size_y, CAST(floor(r - l + 0.5) AS BIGINT) AS size_w, CAST(floor(m - t + 0.5) AS BIGINT) AS size_h,
               CAST(greatest(1, floor((o_orderkey % 900 + 1) * sc + 0.5)) AS BIGINT) AS thumb_w, CAST(greatest(1, floor((o_orderkey % 500 + 1) * sc + 0.5)) AS BIGINT) AS thumb_h,
               CAST(64 AS BIGINT) AS part_x, CAST(33 AS BIGINT) AS part_y, CAST(greatest(1, floor(801 * ((o_orderkey % 7) / 10) + 0.5)) AS BIGINT) AS part_w, CAST(1 AS BIGINT) AS part_h
        FROM e""",
    "polygon_counters": f"SELECT doc_id AS image_id, CAST(len(ps) + doc_id % 2 AS BIGINT) AS detected, CAST(len(list_filter(ps, lambda x: regexp_matches(x, '[^{SPACE}]'))) AS BIGINT) AS recognised, CAST(len(list_filter(range(1, len(ps) + 1), lambda i: regexp_matches(ps[i], '[^{SPACE}]') AND (doc_id + i) % 5 <> 0)) AS BIGINT) AS kept FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents)",
    "recaptured_boxes": f"""WITH {BOXES}, a AS (SELECT *, box_id % 3 = 0 AS hit, box_id % 2 = 0 AS mv, box_id % 400 AS px, box_id * 7 % 90 AS py FROM boxes),
        e AS (SELECT doc_id, box_id, text AS before, custom, hit, CAST(CASE WHEN NOT hit THEN a.x WHEN mv THEN greatest(0, least(px, 800 - a.w)) ELSE greatest(0, a.x) END AS BIGINT) AS x, CAST(CASE WHEN NOT hit THEN a.y WHEN mv THEN greatest(0, least(py, 600 - a.h)) ELSE greatest(0, a.y) END AS BIGINT) AS y,
                     CAST(CASE WHEN hit AND NOT mv THEN least(800, greatest(px, a.x + 4)) - greatest(0, a.x) ELSE a.w END AS BIGINT) AS w, CAST(CASE WHEN hit AND NOT mv THEN least(600, greatest(py, a.y + 4)) - greatest(0, a.y) ELSE a.h END AS BIGINT) AS h FROM a),
        c AS (SELECT * FROM e WHERE hit AND custom), u AS ({_UNDER('c')})
        SELECT box_id, x, y, w, h, coalesce(u.text, before) AS text FROM e LEFT JOIN u USING (box_id)""",
    "page_fills": f"WITH {BOXES} SELECT page_id, box_id, x, y, w, h FROM boxes WHERE {_VISIBLE('person', 'email')}",
    "custom_boxes": f"WITH {BOXES}, drawn AS (SELECT doc_id, doc_id * 1000000 + 999999 AS box_id, 10 AS x, 0 AS y, 300 AS w, 30 AS h FROM documents), dt AS ({_UNDER('drawn')}) SELECT doc_id, box_id, label, text, enabled, custom FROM boxes UNION ALL SELECT doc_id, box_id, 'custom', dt.text, true, true FROM drawn JOIN dt USING (box_id)",
    "label_counts": f"WITH {BOXES} SELECT label, count(*) AS n FROM boxes WHERE label <> 'custom' GROUP BY label",
    "visible_boxes": f"WITH {BOXES} SELECT box_id, label FROM boxes WHERE {_VISIBLE('person', 'address')}",
    "duplicate_groups": f"WITH {BOXES} SELECT label, lower(trim(text)) AS key, count(*) AS n FROM boxes WHERE trim(text) <> '' GROUP BY 1, 2 HAVING count(*) >= 2",
    "duplicate_box_ids": f"WITH {BOXES} SELECT box_id FROM (SELECT box_id, count(*) OVER (PARTITION BY label, lower(trim(text))) AS n FROM boxes WHERE trim(text) <> '') WHERE n >= 2",
    "boxes_of_all_pages": f"WITH {BOXES} SELECT page_id, box_id, CASE WHEN page_id % 10 = 0 THEN 'edited' ELSE label END AS label FROM boxes",
    "boxes_with_confidence": f"WITH {BOXES} SELECT box_id, CASE WHEN NOT custom THEN round(1 - CAST(min(span_no) OVER (PARTITION BY page_id, label, text) AS DOUBLE) / 100.0, 6) END AS confidence FROM boxes",
    "label_pills": f"WITH {BOXES}, c AS (SELECT label, count(*) AS n, min(box_id) AS f FROM boxes GROUP BY label) SELECT label, n, coalesce(display, label) AS display, coalesce(color, '#94a3b8') AS color, row_number() OVER (ORDER BY n DESC, f) AS place FROM c LEFT JOIN {_META} USING (label)",
    "searched_boxes": f"WITH {BOXES}, r AS (SELECT b.*, coalesce(display, b.label) AS shown FROM boxes b LEFT JOIN {_META} ON t.label = b.label) SELECT box_id, label FROM r WHERE contains(lower(text), 'person') OR contains(lower(shown), 'person') OR contains(label, 'person') UNION ALL SELECT box_id, label FROM r WHERE page_id = 12 AND label IN ('email', 'custom') AND (contains(lower(text), 'span 1') OR contains(lower(shown), 'span 1') OR contains(label, 'span 1'))",
    "label_meta_with_custom": f"SELECT label, CASE label WHEN 'email' THEN '#000000' ELSE color END AS color, CASE label WHEN 'email' THEN 'Mail' ELSE display END AS display FROM {_META} UNION ALL SELECT 'badge', '#111111', 'Badge'",
    "bulk_deleted": f"WITH {BOXES} SELECT box_id, label FROM boxes WHERE box_id % 7 <> 0",
    "bulk_relabelled": f"WITH {BOXES} SELECT box_id, CASE WHEN box_id % 7 = 0 THEN 'iban' ELSE label END AS label FROM boxes",
    "rerun_merge": f"WITH {BOXES} SELECT page_id, box_id + 500 AS box_id, label, custom FROM boxes WHERE NOT custom AND page_id % 9 <> 0 UNION ALL SELECT page_id, box_id, label, custom FROM boxes WHERE custom OR page_id % 9 = 0",
    "active_labels": f"WITH {BOXES} SELECT DISTINCT label FROM boxes WHERE label <> 'custom'",
    "edited_boxes": f"WITH {BOXES} SELECT box_id, label, CASE WHEN box_id % 5 = 0 THEN 'new text' ELSE text END AS text, CASE WHEN box_id % 5 = 0 THEN box_id % 2 = 0 ELSE enabled END AS enabled FROM boxes WHERE box_id % 15 <> 0",
    "numbered_boxes": f"WITH {BOXES} SELECT page_id, span_no, row_number() OVER (ORDER BY page_id, span_no) - 1 AS box_id, true AS enabled, false AS custom FROM boxes",
    "selected_boxes": f"WITH {BOXES} SELECT box_id FROM boxes WHERE {_VISIBLE('person')} AND box_id BETWEEN 30000000 AND 90000000",
    "page_progress": """
        WITH runs AS (
            SELECT doc_id, trim(text) <> '' AS spoken, CASE doc_id % 20 WHEN 3 THEN 'input' WHEN 8 THEN 'ocr' WHEN 13 THEN 'detection' WHEN 18 THEN 'detection' END AS failed FROM documents
        ), reported AS (
            SELECT doc_id, CASE WHEN failed IN ('input', 'ocr') OR failed = 'detection' AND spoken THEN 'RuntimeError: page ' || doc_id END AS e,
                   CASE WHEN failed = 'input' THEN ['done'] WHEN failed = 'ocr' THEN ['ocr_started', 'done']
                        WHEN spoken THEN ['ocr_started', 'ocr_done', 'detection_started', 'done'] ELSE ['ocr_started', 'ocr_done', 'done'] END AS st
            FROM runs
        )
        SELECT doc_id AS image_id, CAST(i - 1 AS INTEGER) AS place, st[i] AS stage, CASE WHEN st[i] = 'done' THEN e END AS error FROM (SELECT *, unnest(range(1, len(st) + 1)) AS i FROM reported)""",
}
