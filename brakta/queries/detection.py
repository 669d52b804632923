"""Detection, post-filters and masking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brakta.functions.text import is_label_key, luhn_ok, slug
from brakta.operators import filters, redact, taxonomy
from brakta.operators.detect import TableDetector, browser_label, clean_candidates
from brakta.queries.base import CONFIDENCE, NOT_BLANK, SPANS0, SPANS1, documents, raw_spans
from brakta.operators.detect import PatternDetector
from brakta.streaming import masking

RULES = filters.DEFAULT_RULES | {"phone_number": filters.Rule(r"[0-9]", "partial", 0.6, False), "card_number": filters.Rule(taxonomy.DEFAULT_PATTERNS["card_number"], "full", 0.0, True)}
RAW = [(1, "phone", "070-123 45 67", "3", "16", "0.9"), (1, "email", None, "20", "30", None), (2, "bank", "5050-1055", "x", "9", "0.7"), (2, "person", "Anna", "0", None, "0.7"), (3, "iban", "SE45", "1", "5", "oops")]


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS t({names})"


def detect_spans(spark: SparkSession, d: str) -> DataFrame:
    return raw_spans(spark, d)


def clean_raw_candidates(spark: SparkSession, d: str) -> DataFrame:
    return clean_candidates(spark.createDataFrame(RAW, "doc_id long, label string, text string, start string, end string, confidence string"))


def table_detector(spark: SparkSession, d: str) -> DataFrame:
    return TableDetector(spark.createDataFrame(RAW, "doc_id long, label string, text string, start string, end string, confidence string")).detect(documents(spark, d))


def filter_spans(spark: SparkSession, d: str) -> DataFrame:
    kept = filters.filtered(raw_spans(spark, d), RULES, 0.0, ["email", "phone_number", "card_number", "ip_address"])
    return filters.within(kept, documents(spark, d))


def allow_list_empty(spark: SparkSession, d: str) -> DataFrame:
    return filters.allowed(raw_spans(spark, d), []).groupBy("label").agg(F.count("*").alias("n"))


REGEX_CASES = [("ab", "a|ab", "full"), ("a", "a|ab", "full"), ("xaby", "ab", "partial"), ("xaby", "ab", "exclude"), ("xy", "ab", "exclude"), ("anything", "(", "full"), ("anything", "  ", "full"), ("ab", "ab", "odd")]


def regex_modes(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for i, (text, regex, mode) in enumerate(REGEX_CASES):
        row = spark.range(1).select(F.lit(i).alias("case_no"), filters.passes(filters.Rule(regex, mode), F.lit(text), F.lit(1.0)).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out


def luhn_checks(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", luhn_ok(F.concat(F.lit("79927398"), F.col("o_orderkey").cast("string"))).alias("ok"))


def sorted_spans(spark: SparkSession, d: str) -> DataFrame:
    return redact.spans_by_document(raw_spans(spark, d)).select("doc_id", "n_spans", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["label"])), ",").alias("spans"))


def mask_documents(spark: SparkSession, d: str) -> DataFrame:
    detector = PatternDetector(confidence=CONFIDENCE)
    return redact.anonymize(documents(spark, d), detector, RULES, 0.5).select("doc_id", "n_spans", "masked_text")


def sanitized_text(spark: SparkSession, d: str) -> DataFrame:
    spans = redact.spans_by_document(raw_spans(spark, d).withColumn("label", filters.aliased(F.col("label"))).filter(F.col("label").isin("email", "phone_number", "card_number")))
    display = F.create_map(*[F.lit(x) for k, (_, v) in taxonomy.META.items() for x in (k, v)])
    joined = documents(spark, d).join(spans, "doc_id", "left")
    return joined.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(redact.mask_from_left(F.col("text"), F.col("spans"), display)).alias("sanitized"))


OVERLAPS = [(1, "Anna Svensson bor här", [(0, 4, "person"), (0, 13, "person")]), (2, "abcdef", [(0, 3, "a"), (2, 5, "b")]), (3, "abc", [(-1, 2, "a"), (1, 1, "b"), (2, 9, "c")]), (4, "åäö😀x", [(3, 4, "emoji"), (0, 1, "first")])]


def mask_overlapping(spark: SparkSession, d: str) -> DataFrame:
    """Both policies on nested, crossing, empty and outlying spans."""
    rows = spark.createDataFrame([(i, t, sorted(s)) for i, t, s in OVERLAPS], "doc_id int, text string, spans array<struct<start:int,end:int,label:string>>")
    good = F.filter("spans", lambda s: (s["start"] >= 0) & (s["end"] <= F.length("text")) & (s["start"] < s["end"]))
    none = F.create_map().cast("map<string,string>")
    return rows.select("doc_id", redact.mask_from_right(F.col("text"), F.col("spans")).alias("from_right"), redact.mask_from_left(F.col("text"), good, none).alias("from_left"))


def masked_in_row(spark: SparkSession, d: str) -> DataFrame:
    """The stateless form that also runs on streams."""
    return masking.masked(documents(spark, d), filters.DEFAULT_RULES)


SLUGS = ["  My Label! ", "Ålder", "9lives", "ok_name", "__x__", "A" * 60]


def custom_label_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(SLUGS)], "i int, name string")
    return rows.select("i", slug(F.col("name")).alias("slug"), is_label_key(slug(F.col("name"))).alias("valid"))


def label_dimension(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.labels_table(spark)


def labels_per_tier(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.labels_table(spark).groupBy("tier").agg(F.count("*").alias("n"))


def label_meta(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.meta_table(spark)


def default_rules(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.rules_table(spark)


def changed_rules(spark: SparkSession, d: str) -> DataFrame:
    """Labels whose rule differs from the default, nulls compared as values."""
    base = taxonomy.rules_table(spark)
    now = base.withColumn("threshold", F.when(F.col("label") == "email", 0.7).otherwise(F.col("threshold"))).withColumn("regex", F.when(F.col("label") == "url", F.lit(None)).otherwise(F.col("regex")))
    return filters.customised(now, base)


def toggled_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, ["email", "url"], "url"), (2, ["email"], "url")], "i int, enabled array<string>, label string")
    return rows.select("i", F.array_join(filters.toggled(F.col("enabled"), F.col("label")), ",").alias("enabled"))


def removed_label(spark: SparkSession, d: str) -> DataFrame:
    """A label taken out of the rules, with what hangs on it."""
    (rules,) = filters.without_labels(["iban", "url"], taxonomy.rules_table(spark))
    return rules.select("label", "regex")


def rule_previews(spark: SparkSession, d: str) -> DataFrame:
    """What each rule would say of a document's first word and of nothing; one pattern cannot be read."""
    word = F.split_part("text", F.lit(" "), F.lit(1))
    rules = {"full": filters.Rule("[A-Z][a-z]+"), "exclude": filters.Rule("the", "exclude"), "broken": filters.Rule("("), "open": filters.Rule()}
    return documents(spark, d).select("doc_id", *[filters.preview(r, word).alias(k) for k, r in rules.items()], filters.preview(rules["full"], F.lit(" \n")).alias("none"))


def browser_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "PER", "X"), (2, None, "LOC"), (3, None, None)], "i int, entity_group string, entity string")
    return rows.select("i", browser_label(F.col("entity_group"), F.col("entity")).alias("label"))


def detector_labels(spark: SparkSession, d: str) -> DataFrame:
    got = filters.label_descriptions(dict.fromkeys(taxonomy.TRAINED, "default"), {"email": "mail", "nope": "x", "url": ""}, [{"key": "badge", "displayLabel": "Badge"}])
    return spark.createDataFrame(sorted(got.items()), "label string, description string")


QUERIES = {f.__name__: f for f in (detect_spans, clean_raw_candidates, table_detector, filter_spans, allow_list_empty, regex_modes, luhn_checks, sorted_spans, mask_documents, sanitized_text, mask_overlapping, masked_in_row, custom_label_keys, label_dimension, labels_per_tier, label_meta, default_rules, changed_rules, toggled_labels, removed_label, rule_previews, browser_labels, detector_labels)}

_LUHN = "(list_sum(list_transform(range(1, length(dg) + 1), lambda i: CASE WHEN (i - 1) % 2 = length(dg) % 2 THEN CASE WHEN 2 * CAST(dg[i] AS INTEGER) > 9 THEN 2 * CAST(dg[i] AS INTEGER) - 9 ELSE 2 * CAST(dg[i] AS INTEGER) END ELSE CAST(dg[i] AS INTEGER) END)) % 10 = 0)"


def _rule_sql(rules: dict, luhn: bool = True) -> str:
    """The rules as SQL over spans with digits dg; a full match is the leftmost one being all."""
    tests = []
    for label, r in rules.items():
        parts = ["true"]
        p = r.regex.replace("'", "''")
        if r.threshold > 0:
            parts.append(f"confidence >= {r.threshold}")
        if p.strip():
            parts.append({"full": f"regexp_matches(text, '{p}') AND regexp_extract(text, '{p}') = text", "partial": f"regexp_matches(text, '{p}')", "exclude": f"NOT regexp_matches(text, '{p}')"}[r.mode])
        if r.luhn and luhn:
            parts.append(f"(dg = '' OR {_LUHN})")
        tests.append(f"WHEN '{label}' THEN {' AND '.join(parts)}")
    return "CASE label " + " ".join(tests) + " ELSE true END"


_FILTERED = SPANS1 + f", kept AS (SELECT doc_id, label, text, \"start\", \"end\", confidence FROM (SELECT *, regexp_replace(text, '[^0-9]', '', 'g') AS dg FROM spans1 WHERE confidence >= 0.5) WHERE {_rule_sql(RULES)})"
_FOLD_RIGHT = """list_reduce(list_reverse(ss), lambda a, s: CASE WHEN s.s >= 0 AND s.s < s.e AND s.e <= length(text) AND s.e <= a.s
    THEN {'o': a.o[1:s.s] || '[' || upper(s.l) || ']' || a.o[s.e+1:], 's': s.s, 'e': 0, 'l': ''} ELSE a END, {'o': text, 's': length(text), 'e': 0, 'l': ''}).o"""
_FOLD_LEFT = """list_reduce(ss, lambda a, s: CASE WHEN s.s >= a.e THEN {'o': a.o || text[a.e+1:s.s] || '[' || lower(s.l) || ']', 's': s.s, 'e': s.e, 'l': ''} ELSE a END, {'o': '', 's': 0, 'e': 0, 'l': ''})"""
_LIST = "list({'o': '', 's': CAST(\"start\" AS BIGINT), 'e': CAST(\"end\" AS BIGINT), 'l': label} ORDER BY \"start\", \"end\", label)"
_META = _values([(k, v) for k, (_, v) in taxonomy.META.items()], "label, display")

SQL = {
    "detect_spans": f"WITH {SPANS0} SELECT doc_id, label, text, \"start\", \"end\", confidence FROM spans0",
    "clean_raw_candidates": f"SELECT doc_id::BIGINT AS doc_id, label, coalesce(text, '') AS text, TRY_CAST(\"start\" AS INTEGER) AS \"start\", TRY_CAST(\"end\" AS INTEGER) AS \"end\", coalesce(TRY_CAST(confidence AS DOUBLE), 1.0) AS confidence FROM {_values(RAW, 'doc_id, label, text, \"start\", \"end\", confidence')} WHERE TRY_CAST(\"start\" AS INTEGER) IS NOT NULL AND TRY_CAST(\"end\" AS INTEGER) IS NOT NULL",
    "table_detector": f"SELECT doc_id::BIGINT AS doc_id, label, coalesce(text, '') AS text, TRY_CAST(\"start\" AS INTEGER) AS \"start\", TRY_CAST(\"end\" AS INTEGER) AS \"end\", coalesce(TRY_CAST(confidence AS DOUBLE), 1.0) AS confidence FROM {_values(RAW, 'doc_id, label, text, \"start\", \"end\", confidence')} WHERE TRY_CAST(\"start\" AS INTEGER) IS NOT NULL AND TRY_CAST(\"end\" AS INTEGER) IS NOT NULL AND doc_id IN (SELECT doc_id FROM documents WHERE {NOT_BLANK})",
    "filter_spans": f"WITH {_FILTERED} SELECT k.* FROM kept k JOIN documents d USING (doc_id) WHERE k.\"end\" <= length(d.text) AND label IN ('email', 'phone_number', 'card_number', 'ip_address')",
    "allow_list_empty": f"WITH {SPANS0} SELECT label, count(*) AS n FROM spans0 GROUP BY label",
    "regex_modes": f"SELECT case_no, passed FROM {_values([(0, False), (1, True), (2, True), (3, False), (4, True), (5, True), (6, True), (7, True)], 'case_no, passed')}",
    "luhn_checks": f"SELECT o_orderkey, {_LUHN} AS ok FROM (SELECT o_orderkey, '79927398' || CAST(o_orderkey AS VARCHAR) AS dg FROM orders)",
    "sorted_spans": f"WITH {SPANS0} SELECT doc_id, count(*) AS n_spans, string_agg(CAST(\"start\" AS VARCHAR) || ':' || CAST(\"end\" AS VARCHAR) || ':' || label, ',' ORDER BY \"start\", \"end\", label) AS spans FROM spans0 GROUP BY doc_id",
    "mask_documents": f"WITH {_FILTERED}, g AS (SELECT doc_id, {_LIST} AS ss, count(*) AS n_spans FROM kept GROUP BY doc_id) SELECT d.doc_id, coalesce(n_spans, 0) AS n_spans, CASE WHEN ss IS NULL THEN text ELSE {_FOLD_RIGHT} END AS masked_text FROM documents d LEFT JOIN g USING (doc_id)",
    "sanitized_text": f"WITH {SPANS1}, g AS (SELECT doc_id, list({{'o': '', 's': CAST(\"start\" AS BIGINT), 'e': CAST(\"end\" AS BIGINT), 'l': display}} ORDER BY \"start\", \"end\", label) AS ss FROM spans1 JOIN {_META} USING (label) WHERE label IN ('email', 'phone_number', 'card_number') GROUP BY doc_id), f AS (SELECT d.doc_id, text, CASE WHEN ss IS NOT NULL THEN {_FOLD_LEFT} END AS r FROM documents d LEFT JOIN g USING (doc_id)) SELECT doc_id, CASE WHEN r IS NULL THEN text ELSE r.o || text[r.e+1:] END AS sanitized FROM f",
    "mask_overlapping": "SELECT * FROM " + _values([(1, "[PERSON] bor här", "[person] Svensson bor här"), (2, "ab[B]f", "[a]def"), (3, "abc", "abc"), (4, "[FIRST]äö[EMOJI]x", "[first]äö[emoji]x")], "doc_id, from_right, from_left"),
    "masked_in_row": f"WITH {SPANS1}, kept AS (SELECT * FROM spans1 WHERE {_rule_sql(filters.DEFAULT_RULES, False)}), g AS (SELECT doc_id, {_LIST} AS ss, count(*) AS n FROM kept GROUP BY doc_id) SELECT d.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_spans, CASE WHEN ss IS NULL THEN text ELSE {_FOLD_RIGHT} END AS masked_text FROM documents d LEFT JOIN g USING (doc_id)",
    "custom_label_keys": f"SELECT i, slug, regexp_matches(slug, '^[a-z][a-z0-9_]*$') AND length(slug) <= 48 AS valid FROM (SELECT i, regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM {_values(list(enumerate(SLUGS)), 'i, name')})",
    "label_dimension": f"SELECT * FROM {_values([(i, n, t) for i, (n, t) in enumerate(taxonomy.LABELS.items())], 'ord, label, tier')}",
    "labels_per_tier": f"SELECT tier, count(*) AS n FROM {_values([(n, t) for n, t in taxonomy.LABELS.items()], 'label, tier')} GROUP BY tier",
    "label_meta": f"SELECT * FROM {_values([(k, c, v) for k, (c, v) in taxonomy.META.items()], 'label, color, display')}",
    "default_rules": f"SELECT label, regex, mode, CAST(threshold AS DOUBLE) AS threshold, luhn FROM {_values([(k, taxonomy.DEFAULT_PATTERNS.get(k, ''), 'full', 0.0, False) for k in taxonomy.DEFAULT_ENABLED], 'label, regex, mode, threshold, luhn')}",
    "changed_rules": f"SELECT label, label IN ('email', 'url') AS customised FROM {_values([(k,) for k in taxonomy.DEFAULT_ENABLED], 'label')}",
    "toggled_labels": f"SELECT * FROM {_values([(1, 'email'), (2, 'email,url')], 'i, enabled')}",
    "removed_label": f"SELECT * FROM {_values([(k, taxonomy.DEFAULT_PATTERNS.get(k, '')) for k in taxonomy.DEFAULT_ENABLED], 'label, regex')} WHERE label NOT IN ('iban', 'url')",
    "rule_previews": f"SELECT doc_id, CASE WHEN b THEN 'empty' WHEN regexp_extract(w, '[A-Z][a-z]+') = w AND w <> '' THEN 'ok' ELSE 'reject' END AS full, CASE WHEN b THEN 'empty' WHEN contains(w, 'the') THEN 'reject' ELSE 'ok' END AS exclude, CASE WHEN b THEN 'empty' ELSE 'invalid' END AS broken, CASE WHEN b THEN 'empty' ELSE 'ok' END AS open, 'empty' AS none FROM (SELECT doc_id, w, NOT {NOT_BLANK.replace('(text,', '(w,')} AS b FROM (SELECT doc_id, split_part(text, ' ', 1) AS w FROM documents))",
    "browser_labels": f"SELECT * FROM {_values([(1, 'per'), (2, 'loc'), (3, 'misc')], 'i, label')}",
    "detector_labels": f"SELECT label, CASE label WHEN 'email' THEN 'mail' ELSE 'default' END AS description FROM {_values([(k,) for k in taxonomy.TRAINED], 'label')} UNION ALL SELECT 'badge', 'Badge'",
}
