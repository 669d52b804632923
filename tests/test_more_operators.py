"""Counters, box edits, masks, embedders, uploads, the recipe and the batch jobs, against small independent statements."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from brakta import jobs
from brakta.operators import curate, geometry, redact, synth
from brakta.sources import io


def test_counters_of_null_and_broken_lists(spark):
    square = [[0.0, 0.0], [2.0, 2.0]]
    rows = [(1, ["a", " \t", None, "b"], [square, square, square, [[1.0]]]), (1, ["c"], [square, square]), (2, None, [square]), (3, ["x"], None), (4, None, None)]
    got = geometry.ocr_counters(spark.createDataFrame(rows, "image_id int, texts array<string>, polys array<array<array<double>>>"))
    assert sorted(map(tuple, got.collect())) == [(1, 6, 3, 2), (2, 1, 0, 0), (3, 0, 1, 0), (4, 0, 0, 0)]


def test_edits_move_resize_and_recapture(spark):
    box = "page int, box_id int, x long, y long, w long, h long, text string, custom boolean"
    boxes = spark.createDataFrame([(1, 1, 0, 0, 20, 20, "old", True), (1, 2, 0, 0, 20, 20, "span", False), (1, 3, 5, 5, 9, 9, "stays", True), (1, 4, 0, 0, 20, 20, "old", True)], box)
    lines = spark.createDataFrame([(1, 0, 50, 50, 10, 10, "below"), (1, 1, 0, 0, 10, 10, "top")], "page int, line_no int, x int, y int, w int, h int, text string")
    edits = spark.createDataFrame([(1, None, 45.4, 45.5), (2, None, 500.0, -3.0), (4, "se", 100.0, 1.0)], "box_id int, handle string, px double, py double")
    got = geometry.edited(boxes, edits, lines, "page", F.lit(100), F.lit(80))
    assert sorted((r.box_id, r.x, r.y, r.w, r.h, r.text) for r in got.collect()) == [(1, 45, 46, 20, 20, "below"), (2, 80, 0, 20, 20, "span"), (3, 5, 5, 9, 9, "stays"), (4, 0, 0, 100, 4, "top")]


def test_masks_are_painted_within_the_image(spark):
    white = bytearray(b"\xff" * 3 * 4 * 3)
    images = spark.createDataFrame([(1, 4, 3, white), (2, 4, 3, white)], "page int, width int, height int, pixels binary")
    boxes = spark.createDataFrame([(1, 1, "email", -1, 1, 3, 9, True), (1, 2, "email", 3, 0, 1, 1, False), (1, 3, "phone", 3, 0, 1, 1, True)], "page int, box_id int, label string, x int, y int, w int, h int, enabled boolean")
    got = {r.page: bytes(r.pixels) for r in redact.painted(images, redact.fills(boxes, ["email"], "page"), "page").collect()}
    want = [[0 if y >= 1 and x < 2 else 255 for x in range(4) for _ in range(3)] for y in range(3)]
    assert got == {1: bytes(sum(want, [])), 2: bytes(white)}


def test_embedder_order_batches_and_failures(spark):
    # Vectors by first letter, answered in reverse order; and one vector too few.
    turned = lambda: lambda texts: [(i, [3.0 * (t[:1] == "a"), 4.0 * (t[:1] != "a")]) for i, t in reversed(list(enumerate(texts)))]
    short = lambda: lambda texts: [(i, [1.0]) for i, _ in enumerate(texts[1:])]
    rows = spark.createDataFrame([(1, "ab", 7), (2, "b", 8), (3, "ac", 9), (4, None, 1), (None, "a", 2)], "k long, t string, other int")
    made = curate.embedded(rows, "t", turned, batch=2)
    assert {r.k: list(r.embedding) for r in made.collect()} == {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [1.0, 0.0], 4: [0.0, 1.0], None: [1.0, 0.0]}
    with pytest.raises(PySparkException, match="vectors for"):
        curate.embedded(rows, "t", short).collect()
    kept = lambda df: sorted((r.k is None, r.k or 0) for r in df.collect())
    assert kept(curate.without_near_copies(rows, "k", "t", turned)) == [(False, 1), (False, 2), (True, 0)]
    assert curate.without_near_copies(rows, "k", "t", short).count() == 5
    assert curate.without_near_copies(rows, "k", "missing", turned).count() == 5
    assert curate.without_near_copies(rows.limit(0), "k", "t", turned).count() == 0


def test_uploads_append_replace_and_skip(spark):
    pages = spark.createDataFrame([(0, "old.png", 5, 5, "text")], "page_no long, file_name string, width int, height int, text string")
    files = spark.createDataFrame([(2, "c.png", 3, 3), (0, "a.png", 1, 1), (1, "broken.png", None, None)], "place int, file_name string, width int, height int")
    names = lambda df: [(r.page_no, r.file_name, r.text) for r in df.orderBy("page_no").collect()]
    assert names(io.uploaded(pages, files, True)) == [(0, "old.png", "text"), (1, "a.png", ""), (2, "c.png", "")]
    assert names(io.uploaded(pages, files, False)) == [(0, "a.png", ""), (1, "c.png", "")]
    assert names(io.uploaded(pages, files.limit(0), True)) == [(0, "old.png", "text")]
    with pytest.raises(ValueError, match="no usable images"):
        io.uploaded(pages, files.filter("place = 1"), False)


def test_jobs_from_rows_to_scores(spark, tmp_path, capsys):
    assert jobs.main(["generate", "60", str(tmp_path), "made"], spark) == 0
    rows = spark.read.parquet(f"{tmp_path}/made/parquet-files")
    assert rows.count() == 60 and rows.filter("not (entities_validated and records_validated)").count() == 0
    assert {"seed_card", "seed_dob", "seed_passport", "seed_email", "seed_phone", "seed_personnummer", "seed_address"} <= set(rows.columns)
    assert jobs.main(["convert", f"{tmp_path}/made", f"{tmp_path}/lines"], spark) == 0
    counts = json.loads(capsys.readouterr().out.splitlines()[-1])
    lines = spark.read.text(f"{tmp_path}/lines/split=train")
    assert lines.count() == counts["train"] and sum(counts.values()) == rows.select("text").distinct().count()
    train = f"{tmp_path}/lines/split=train"
    assert jobs.main(["evaluate", train, train], spark) == 0
    scored = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert scored["totals"]["micro_f1"] == 1.0 and {r["label"] for r in scored["labels"]} == {"person", "personnummer", "email", "date"}


def test_jobs_fail_with_status_1(spark, tmp_path, capsys):
    assert jobs.main(["convert", f"{tmp_path}/nothing", f"{tmp_path}/x"], spark) == 1
    assert jobs.main(["evaluate", f"{tmp_path}/nothing", f"{tmp_path}/x"], spark) == 1
    assert jobs.main(["generate", "0", str(tmp_path), "x"], spark) == 1
    assert capsys.readouterr().err.count("error:") == 3


def test_judge_scores_are_text(spark):
    judge = lambda rows: rows.withColumn("judge", F.struct(F.struct(F.when(F.col("row_id") > 0, 3).alias("score")).alias("swedish_naturalness")))
    got = synth.preview(spark, 2, judge=judge, rubrics=("swedish_naturalness",)).select("row_id", "swedish_naturalness_score").collect()
    assert sorted(map(tuple, got)) == [(0, ""), (1, "3")]
