"""Operators against small independent specifications."""

import random
import re
import zipfile
from io import BytesIO

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brakta.functions import parsing
from brakta.functions import text as T
from brakta.operators import boxes, curate, detect, filters, metrics, noise, redact, search, synth, taxonomy, validate
from brakta.operators.geometry import overlapping_ids
from brakta.plans import order
from brakta.sources import io
from brakta.streaming import masking

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def masked(text, spans):
    """Right to left: what reaches into what is replaced, or out of the text, is skipped."""
    edge = len(text)
    for s, e, label in sorted(spans, reverse=True):
        if 0 <= s < e <= min(len(text) if edge == len(text) else edge, edge):
            text, edge = text[:s] + f"[{label.upper()}]" + text[e:], s
    return text


def exported(text, spans):
    out, pos = "", 0
    for s, e, label in sorted(spans):
        if s >= pos:
            out, pos = out + text[pos:s] + f"[{label}]", e
    return out + text[pos:]


SPAN = st.tuples(st.integers(-2, 12), st.integers(-2, 14), st.sampled_from(["a", "bb"]))


@SLOW
@given(st.lists(st.tuples(st.text("abåö😀 ", max_size=12), st.lists(SPAN, max_size=5, unique_by=lambda x: x[:2])), min_size=1, max_size=20))
def test_masking(spark, cases):
    rows = [(i, t, sorted(s)) for i, (t, s) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, text string, spans array<struct<start:int,end:int,label:string>>")
    got = {r.i: r.m for r in df.select("i", redact.mask_from_right(F.col("text"), F.col("spans")).alias("m")).collect()}
    assert got == {i: masked(t, s) for i, t, s in rows}
    inside = [(i, t, [x for x in s if 0 <= x[0] < x[1] <= len(t)]) for i, t, s in rows]
    df = spark.createDataFrame(inside, "i int, text string, spans array<struct<start:int,end:int,label:string>>")
    none = F.create_map().cast("map<string,string>")
    got = {r.i: r.m for r in df.select("i", redact.mask_from_left(F.col("text"), F.col("spans"), none).alias("m")).collect()}
    assert got == {i: exported(t, s) for i, t, s in inside}


def test_positions_equal_finditer(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    got = {(r.doc_id, r.label, r.start, r.end, r.text) for r in detect.PatternDetector().detect(docs).collect()}
    want = {(r.doc_id, k, m.start(), m.end(), m[0]) for r in docs.collect() for k, p in detect.PATTERNS.items() for m in re.finditer(p, r.text or "")}
    assert got == want and got


@SLOW
@given(st.lists(st.text("0123456789- x", max_size=20), min_size=1, max_size=30))
def test_luhn(spark, values):
    def ok(x):
        d = [int(c) for c in x if c.isdigit()]
        return sum((c * 2 - 9 * (c > 4)) if i % 2 == len(d) % 2 else c for i, c in enumerate(d)) % 10 == 0

    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r.ok for r in df.select(T.luhn_ok(F.col("v")).alias("ok")).collect()] == [ok(v) for v in values]


def test_full_mode_is_less_than_a_full_match():
    assert filters.usable("a|ab") and not filters.usable("(") and not filters.usable("  ")


def test_threshold_zero_means_the_default(spark):
    spans = spark.createDataFrame([(1, "email", "a@b.se", 0, 6, 0.4), (1, "email", "a@b.se", 0, 6, 0.5)], "doc_id long, label string, text string, start int, end int, confidence double")
    assert filters.filtered(spans, {}, 0.0).count() == 1
    assert filters.filtered(spans, {"email": filters.Rule(threshold=0.5)}, None).count() == 1


def test_token_match_with_quotes_and_unicode(spark):
    cases = [("Anna", "åAnna", False), ("Anna", "(Anna)", True), ("a\\Eb", "x a\\Eb y", True), ("", "x", False), ("a.b", "axb", False), ("ö", "ö", True)]
    df = spark.createDataFrame([(m, t) for m, t, _ in cases], "m string, t string")
    assert [r.x for r in df.select(T.token_match(F.col("m"), F.col("t")).alias("x")).collect()] == [w for _, _, w in cases]


def test_greedy_keep_is_the_sequential_scan(spark):
    rng = random.Random(2)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)})
    kept = []
    for i in range(40):
        if not any((j, i) in pairs for j in kept):
            kept.append(i)
    got = curate.greedy_keep(spark.range(40).withColumnRenamed("id", "k"), spark.createDataFrame(pairs, "a long, b long"), "k")
    assert sorted(r.k for r in got.filter("keep").collect()) == kept


def test_chain_of_neighbours_keeps_both_ends(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.28, 0.96]), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert {r.vec_id: r.keep for r in curate.dedup_texts(v, 0.75).collect()} == {1: True, 2: False, 3: True, 4: True}
    with pytest.raises(ValueError):
        curate.dedup_texts(v, 0)


def test_overlaps_in_cells_equal_all_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(2), i, rng.randrange(2000), rng.randrange(2000), rng.randrange(1, 700), rng.randrange(1, 700)) for i in range(60)]
    got = {r.box_id for r in overlapping_ids(spark.createDataFrame(rows, "p int, box_id long, x long, y long, w long, h long"), "p").collect()}
    want = {i for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and a[2] < b[2] + b[4] and b[2] < a[2] + a[4] and a[3] < b[3] + b[5] and b[3] < a[3] + a[5] for i in (a[1],)}
    assert got == want


NOISE = [
    ("Namn | Åsa Öberg | 19850315-2389", {"person": ["Åsa Öberg"], "personnummer": ["19850315-2389"]}),
    ("mejla björn.åström@exempel.se", {"email": ["björn.åström@exempel.se"]}),
    ("Anna och Anna Svensson ringer 070-123 45 67", {"person": ["Anna", "Anna Svensson"], "phone": ["070-123 45 67"]}),
    ("Bo Bo Bo", {"person": ["Bo", "Bo"]}),
    ("ingen här", {}),
    ("", {"person": ["x"]}),
    ("modern morgon rn m " * 8, {"url": ["modern morgon"]}),
]


@pytest.mark.parametrize("text,entities", NOISE)
def test_noise_keeps_mentions_in_the_text(text, entities):
    changed = False
    for seed in range(30):
        out, found = noise.noised(text, entities, noise.draws_of(str(seed)), 0.12)
        assert all(m and m in out for ms in found.values() for m in ms)
        assert all(len(ms) == len(set(ms)) for ms in found.values())
        assert noise.noised(text, entities, noise.draws_of(str(seed)), 0.12) == (out, found)
        changed |= out != text
    assert changed or len(text) < 10
    clean, same = noise.noised(text, entities, noise.draws_of('1'), 0)
    assert clean == text and all(m in text for ms in same.values() for m in ms)


def test_mentions_take_places_longest_first():
    assert noise.place_mentions("Anna Svensson och Anna", ["Anna", "Anna Svensson", ""]) == [(0, 13), (18, 22)]


def test_config_falls_back_as_a_whole():
    ok = io.PipelineConfig.parse({"threshold": 0.7, "unknown": 1, "rules": {"email": {"regex": "x"}}})
    assert ok.threshold == 0.7 and ok.rules["email"].regex == "x"
    assert io.PipelineConfig.parse({"threshold": 7, "variant": "ft"}) == io.PipelineConfig()
    assert io.PipelineConfig.parse("not json") == io.PipelineConfig() == io.PipelineConfig.parse(None)
    assert ok.merged({"descriptions": {"email": "m"}}).descriptions == {"email": "m"}
    assert io.variant("ft") == "ft" and io.variant("x") == "baseline"


def test_synthesis_config_is_checked():
    for bad in ({"registers": ()}, {"registers": ("a", "a")}, {"labels": ("nope",)}, {"layouts": {"x": 0}}, {"no_pii": 2}):
        with pytest.raises(ValueError):
            synth.SynthesisConfig(**bad)


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("train", "a", {"person": ["A"]}), ("test", "b", {"email": []})], "split string, text string, entities map<string,array<string>>")
    io.write_splits(rows, f"{tmp_path}/out")
    lines = spark.read.text(f"{tmp_path}/out/split=train")
    assert [(r.text, r.label, r.mention) for r in io.gold_from_lines(lines).collect()] == [("a", "person", "a")]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in io.load_rows(spark, f"{tmp_path}/x.jsonl", 1).collect()] == [1]
    rows.write.parquet(f"{tmp_path}/raw/parquet-files")
    assert io.load_rows(spark, f"{tmp_path}/raw").count() == 2
    with pytest.raises(ValueError):
        io.load_rows(spark, f"{tmp_path}/nothing")
    (tmp_path / "img.bin").write_bytes(b"abc")
    got = io.images(spark, f"{tmp_path}/img.bin", lambda b: [{"n": len(b)}], "n long").collect()
    assert got[0].n == 3
    assert "| train | 3 | 0.750 |" in io.card({"rows": 4}, {"train": 3, "test": 1}, ["a"], {"date": "x"})
    assert len(io.report_files([{"metric": "m", "mean_score": 1.0, "passed": 1, "n": 2, "pass_rate": 0.5}])) == 2


def test_stream_equals_batch(spark, data, tmp_path):
    spark.read.parquet(f"{data}/documents.parquet").write.parquet(f"{tmp_path}/in")
    masking.masked_stream(spark, f"{tmp_path}/in", filters.DEFAULT_RULES, f"{tmp_path}/out", f"{tmp_path}/cp")
    batch = masking.masked(spark.read.parquet(f"{data}/documents.parquet"), filters.DEFAULT_RULES)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, batch.collect()))


def test_plans(spark, data):
    """Scans read what they need, filters reach them, and no Python runs in native operators."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plan = redact.anonymize(docs, detect.PatternDetector(), filters.DEFAULT_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
    assert "n_chars" not in plan and "source" not in plan
    b = spark.createDataFrame([(1, 1, "email", "x", True, False)], "page_id int, box_id long, label string, text string, enabled boolean, custom boolean")
    assert "Exchange" not in b.filter(boxes.is_visible(["email"]))._jdf.queryExecution().executedPlan().toString()


def test_taxonomy_covers_all_tiers():
    assert not taxonomy.UNCOVERED
    assert set(taxonomy.names_with("contextual")) == {"date", "url", "ip_address"}
    assert set(taxonomy.IDENTIFIERS) <= set(taxonomy.LABELS)


@pytest.mark.parametrize("as_json", [False, True])
def test_people_of_validated_records_are_in_the_group_key(spark, as_json):
    rows = [
        (1, "Anna och Bo 19850315-2389", {"person": ["Anna"]}, [{"name": "Bo", "personnummer": "19850315-2389"}], True),
        (2, "Anna och Bo", {}, [{"name": "Bo"}, {"name": "Anna", "personnummer": ""}, {"name": "Cia"}], True),
        (3, "Anna och Bo", {"person": ["Anna"]}, [{"name": "Bo"}], False),
        (4, "Anna och Bo", {"person": ["Anna"]}, [{"name": "Bo"}], None),
        (5, "Anna och Bo", {"person": ["Anna"]}, None, True),
    ]
    df = spark.createDataFrame(rows, "row_id int, text string, entities map<string,array<string>>, records array<map<string,string>>, records_validated boolean")
    df = df.withColumn("records", F.to_json("records")) if as_json else df
    got = {r.row_id: r.group_key for r in curate.with_split(df, ["person", "personnummer"]).collect()}
    assert got == {1: "ids::19850315-2389|Anna|Bo", 2: "ids::Anna|Bo", 3: "ids::Anna", 4: "ids::Anna", 5: "ids::Anna"}


def test_pairs_checked_are_the_predicted_ones(spark):
    """The rule: how many owner pairs were asserted, whatever the truth holds."""
    pair = "row_id int, field string, value string, owner string"
    said = spark.createDataFrame([(1, "phone", "1", "a"), (1, "phone", "2", "a"), (1, "email", "x", "b")], pair)
    true = spark.createDataFrame([(1, "phone", "1", "a"), (2, "phone", "9", "c")], pair)
    rows = {r.row_id: r for r in metrics.pairing(said, true, spark.range(1, 4).select(F.col("id").cast("int").alias("row_id"))).collect()}
    assert {i: r.pairs_checked for i, r in rows.items()} == {1: 3, 2: 0, 3: 0}
    assert rows[2].precision == 1.0 and rows[2].recall == 0.0 and rows[3].f1 == 1.0


def test_null_lists_of_mentions_are_skipped(spark):
    rows = [(1, "Anna", {"person": ["Anna"], "mrz": None}), (2, "Anna", {"mrz": None}), (3, "Anna", {"person": ["Bo"], "mrz": None}), (4, None, {"mrz": None}), (5, None, {"person": ["x"]}), (6, "Anna", None), (7, "Anna", {"person": [None, ""]})]
    df = spark.createDataFrame(rows, "i int, text string, entities map<string,array<string>>")
    for rule in (validate.entities_valid, validate.entities_valid_lenient):
        got = {r.i: r.ok for r in df.select("i", rule(F.col("text"), F.col("entities")).alias("ok")).collect()}
        assert got == {1: True, 2: True, 3: False, 4: True, 5: False, 6: False, 7: True}


def test_rules_that_one_engine_cannot_read_are_off(spark):
    """Blank, broken, or valid in one dialect only: no error and no effect; white space around a pattern does not count."""
    ask = lambda regex, text, mode="full": spark.range(1).select(filters.passes(filters.Rule(regex, mode), F.lit(text), F.lit(1.0)).alias("ok")).first().ok
    assert ask("(?P<x>a)", "a") and not ask("(?P<x>a)", "b")
    assert ask(r"(?P<x>a)(?P=x)", "aa") and not ask(r"(?P<x>a)(?P=x)", "ab")
    assert ask("  ab ", "ab") and not ask("  ab ", "xab")
    for off in ("", " \n", "(", "a{2", "(?(1)a|b)", "[[:odd:]&&[^x]]("):
        assert ask(off, "whatever")
    says = spark.range(1).select(*[filters.preview(filters.Rule(r), F.lit(t)).alias(f"c{i}") for i, (r, t) in enumerate((("a", " \t"), ("(", "a"), ("a", "a"), ("a", "b"), ("", "b")))]).first()
    assert list(says) == ["empty", "invalid", "ok", "reject", "ok"]


def test_blank_is_any_white_space(spark):
    texts = [" ", "\n\t", "\x0b\x0c\r", "  　", "\x1c\x85", "", " a ", "\n.\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: (r.kept, r.bare) for r in df.select("i", T.not_blank(F.col("text")).alias("kept"), T.stripped(F.col("text")).alias("bare")).collect()}
    assert got == {i: (bool(t.strip()), t.strip()) for i, t in enumerate(texts)}


def test_rule_tables(spark):
    base = taxonomy.rules_table(spark)
    assert filters.customised(base, base).filter("customised").count() == 0
    assert filters.rule_counts(base).first().n_rules == base.count()
    rules, enabled = filters.without_labels(["url"], base, spark.createDataFrame([("url",), ("email",)], "label string"))
    assert rules.filter("label = 'url'").count() == 0 and [r.label for r in enabled.collect()] == ["email"]


def test_selections(spark):
    b = spark.createDataFrame([(1, "email", True), (2, "email", False), (3, "url", True), (4, "custom", True)], "box_id long, label string, enabled boolean")
    ids = lambda df: sorted(r.box_id for r in df.collect())
    assert ids(boxes.select_all(b, ["email"])) == [1, 4] and ids(boxes.select_only(b, 3)) == [3]
    assert ids(boxes.select_toggled(b, b.filter("box_id < 3"), 3)) == [1, 2, 3] and ids(boxes.select_toggled(b, b.filter("box_id < 3"), 2)) == [1]


def script(**said):
    """Draws as written down: by kind, one for each place from the first; all others choose nothing."""

    def draw(kind, line, place):
        values = said.get({noise.READ_RN: "rn", noise.SPACE: "space", noise.HOW: "how", noise.BARRED: "bar", noise.READ: "read", noise.WHICH: "which", noise.GAINS: "gains", noise.READ_M: "m"}[kind], {})
        return np.array([values.get(p, 0.999) for p in place.tolist()])

    return draw


def test_merged_letters_belong_to_the_mention_that_ends_on_the_first():
    """``rn`` read as m: a mention up to the r keeps the m, one from the n on does not get it."""
    out, found = noise.noised("barn!", {"a": ["bar"], "b": ["n!"]}, script(rn={2: 0.0}), 0.5)
    assert out == "bam!" and found == {"a": ["bam"], "b": ["!"]}


def test_shares_of_what_becomes_of_spaces():
    """Long unstructured lines wrap for draws from .50 to .95, once a line; columns in structured lines are bars in 40 of 100 cases."""
    line = "x" * 50 + " " + "y" * 5
    for how, want in ((0.2, "xy"), (0.4, "x  y"), (0.5, "x\ny"), (0.6, "x\ny"), (0.94, "x\ny"), (0.96, "x y")):
        assert noise.noised_text(line, script(space={50: 0.0}, how={50: how}), 1.0)[0] == want.replace("x", "x" * 50).replace("y", "y" * 5)
    assert noise.noised_text(line + " z z", script(space={50: 0.0, 56: 0.0, 58: 0.0}, how={50: 0.97, 56: 0.6, 58: 0.6}), 1.0)[0] == "x" * 50 + " yyyyy\nz z"
    assert noise.noised_text("a b", script(space={1: 0.0}, how={1: 0.6}), 1.0)[0] == "a b"
    for bar, want in ((0.39, "a | b|"), (0.41, "a   b|")):
        assert noise.noised_text("a b|", script(space={1: 0.0}, how={1: 0.6}, bar={1: bar}), 1.0)[0] == want
    # A mention's slice is taken as it stands.
    assert noise.noised("ab cd", {"k": ["ab cd"]}, script(space={2: 0.0}, how={2: 0.4}), 0.5)[1] == {"k": ["ab  cd"]}


def test_what_characters_are_read_as():
    assert noise.noised_text("mål", script(m={0: 0.3}, read={1: 1.4, 2: 0.9}, which={1: 0.9, 2: 0.4}), 1.0)[0] == "rna1"
    assert noise.noised_text("oOao", script(read=dict.fromkeys(range(4), 0.0), gains={0: 0.05, 2: 0.2, 3: 0.2}, which={0: 0.0, 1: 0.0, 3: 0.0}), 1.0)[0] == "ö0a0"
    for text in ("", "\n", "\n\n", " ", "rn", "😀 日本\n\nrn m"):
        out, begins = noise.noised_text(text, noise.draws_of("k"), 0.9)
        assert len(begins) == len(text) + 1 and begins[-1] == len(out)
        assert noise.noised_text(text, script(), 0.9)[0] == text


def test_draws_are_even_and_told_by_all_that_they_are_drawn_for():
    place, line = np.arange(50_000), np.zeros(50_000, np.int64)
    u = noise.draws_of("7")(noise.READ, line, place)
    assert abs(u.mean() - 0.5) < 0.01 and abs(u.std() - 12**-0.5) < 0.01 and abs((u < 0.06).mean() - 0.06) < 0.005
    others = (noise.draws_of("8")(noise.READ, line, place), noise.draws_of("7")(noise.SPACE, line, place), noise.draws_of("7")(noise.READ, line + 1, place), noise.draws_of("7", 43)(noise.READ, line, place))
    assert all(abs(np.corrcoef(u, v)[0, 1]) < 0.02 for v in (*others, np.roll(u, 1)))


def test_noisy_copies_name_no_employer(spark):
    rows = spark.createDataFrame([(1, "Anna, Norrvik Bygg AB", {"person": ["Anna"]}, "train", "Norrvik Bygg AB")], "row_id int, text string, entities map<string,array<string>>, split string, company string")
    got = {r.noisy: r.company for r in noise.with_noisy_copies(rows, "row_id").collect()}
    assert got == {False: "Norrvik Bygg AB", True: None}


def test_ranks_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 5).alias("v"))
    got = [(r.k, r["rank"], r.before) for r in order.in_order(df, [F.col("k").asc()], "t", totals={"before": F.col("v")}).orderBy("k").collect()]
    values = [r.v for r in df.orderBy("k").collect()]
    assert got == [(i, i, sum(values[:i])) for i in range(1000)]
    assert order.in_order(df.filter("k < 0"), [F.col("k").asc()], "t").count() == 0


def test_numbered_boxes_go_on_from_page_to_page(spark):
    rows = spark.createDataFrame([(p, s) for p in range(30) for s in range(p % 4)], "page_id long, span_no int")
    got = sorted((r.page_id, r.span_no, r.box_id) for r in boxes.numbered(rows, 100).collect())
    assert [x[2] for x in got] == list(range(100, 100 + rows.count()))


def test_grounding_values_of_nested_and_written_seeds(spark):
    """Scalars in order, through lists, objects, and either written as text; what is broken is a scalar."""
    rows = [(1, "Anna", ["x", " "], '[{"name": "Bo", "tel": null}, ["c", 5]]'), (2, None, None, "('a', {'b': 'c'})"), (3, " nan ", [], "[broken"), (4, None, None, None), (5, "{}", None, "")]
    df = spark.createDataFrame(rows, "i int, a string, b array<string>, c string")
    got = {r.i: r.v for r in df.select("i", parsing.grounding([F.col("a"), F.col("b"), F.col("c")]).alias("v")).collect()}
    assert got == {1: ["Anna", "x", "Bo", "c", "5"], 2: ["a", "c"], 3: ["nan", "[broken"], 4: [], 5: []}
    assert parsing.scalars([1.5, float("nan"), True, {"k": [None, "v"]}]) == ["1.5", "True", "v"]


def test_cases_without_seeds(spark):
    df = spark.createDataFrame([(1, None, None)], "row_id int, text string, entities map<string,array<string>>")
    r = validate.test_cases(df, "row_id").first()
    assert r.input.endswith("(no seed values)") and (r.actual_output, r.expected_output, r.context) == ("", "{}", [])


def test_whole_words_and_their_boxes(spark):
    lines = spark.createDataFrame([(1, 0, "Åsa går, asa", 0, 12, 10, 0, 120, 16), (1, 1, "Åsalund asa1", 13, 25, 10, 20, 120, 16)], "doc_id long, line_no int, text string, start long, end long, x int, y int, w int, h int")
    every, whole = (search.find_phrase(lines, "åsa", whole=w).collect() for w in (False, True))
    assert sorted(r.start for r in every) == [0, 9, 13, 21] and sorted(r.start for r in whole) == [0, 9]
    hits = search.find_phrase(lines, "åsa", whole=True)
    assert sorted((r.x, r.y, r.w) for r in search.boxes_of_hits(lines, hits).collect()) == [(10, 0, 30), (100, 0, 30)]
    assert {(r.x, r.w) for r in search.boxes_of_hits(lines, hits, whole_line=True).collect()} == {(10, 120)}


def test_archives_and_text_files(spark, tmp_path):
    pages = spark.createDataFrame([("d", 2, "02_b.png", b"B"), ("d", 1, "01_a.png", b"A"), ("e", 1, "01_c.png", b"C")], "document string, place int, entry string, content binary")
    got = {r.document: bytes(r.zip) for r in io.archive(pages).collect()}
    with zipfile.ZipFile(BytesIO(got["d"])) as z:
        assert z.namelist() == ["01_a.png", "02_b.png"] and z.read("02_b.png") == b"B"
    assert set(got) == {"d", "e"}
    io.write_text_files(spark.createDataFrame([("a.png", "one"), ("b.png", "two")], "file_name string, text string"), f"{tmp_path}/texts")
    assert {(r.name, r.value) for r in spark.read.text(f"{tmp_path}/texts").collect()} == {("a-redacted.txt", "one"), ("b-redacted.txt", "two")}
