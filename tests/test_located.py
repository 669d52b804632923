"""Matches with their places: against a plain search, on long lists, and in plans."""

import re

import pytest
from pyspark.sql import functions as F

from brakta.operators import detect

TEXTS = ["", None, "no match", "a@b.se", "a@b.se a@b.se", "x a@b.se\nåäö😀 c@d.com.", "@", "1.2.3.4.5.6.7.8", "+46 70 123 45 67 och +46 (70) 123-45-67", "4111 1111 1111 1111 4111111111111111", "mark \ufffe a@b.se \ufffe", "a@b.se " * 1000, "é" * 300 + "9.9.9.9"]


@pytest.mark.parametrize("pattern", [*detect.PATTERNS.values(), r"[a-z]", r"b\b", r"(a|b)(@)", r"^x", r"\s+"])
def test_matches_are_those_of_a_plain_search(spark, pattern):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    got = {r.i: r.m for r in df.select("i", detect.located(F.col("text"), pattern).alias("m")).collect()}
    for i, text in enumerate(TEXTS):
        want = None if text is None else [(m[0], m.start(), m.end()) for m in re.finditer(pattern, text.replace("\ufffe", "\ufffd"))]
        assert (None if got[i] is None else list(map(tuple, got[i]))) == want


def test_each_pattern_stands_once_in_the_plan(spark, data):
    found = detect.PatternDetector().detect(spark.read.parquet(f"{data}/documents.parquet"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("regexp_replace", plan)) == len(detect.PATTERNS) and "regexp_extract_all" not in plan
