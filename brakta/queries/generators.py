"""Checksums, identifiers, synthetic rows, the demonstration page, and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brakta.functions import text as T
from brakta.operators import geometry as G
from brakta.operators import pools, search, synth
from brakta.queries.base import LINES, lines, table
from brakta.queries.detection import _values

# A made-up page: text and hits with confidences, and each hit's place as fractions of the image.
DEMO = [
    ("person", "Sven Andersson", 0.97, 0.08, 0.10, 0.25), ("email", "sven.andersson@exempel.se", 0.95, 0.08, 0.16, 0.32), ("phone_number", "070-123 45 67", 0.88, 0.08, 0.22, 0.20), ("address", "Sveavägen 12, 113 57 Stockholm", 0.78, 0.08, 0.28, 0.38),
    ("personnummer", "19850315-2389", 0.68, 0.21, 0.34, 0.18), ("organisationsnummer", "556677-1234", 0.58, 0.15, 0.40, 0.15), ("bank_account", "5050-1055", 0.48, 0.15, 0.46, 0.12), ("url", "https://example.org", 0.38, 0.08, 0.52, 0.22),
]
DEMO_TEXT = "\n".join(("Sven Andersson", "sven.andersson@exempel.se", "070-123 45 67", "Sveavägen 12, 113 57 Stockholm", "Personnummer: 19850315-2389", "Org. nr 556677-1234", "Bankgiro 5050-1055", "https://example.org"))


def checksums(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("nine"), F.lpad(F.col("o_orderkey").cast("string"), 20, "1").alias("bban"))
    return o.select("o_orderkey", T.luhn_check_digit(F.col("nine")).alias("luhn"), T.swedish_iban(F.col("bban")).alias("iban"), T.mrz_check(F.concat(F.lit("AZ<"), F.col("nine"))).alias("mrz"))


def personal_numbers(spark: SparkSession, d: str) -> DataFrame:
    k, full = F.col("o_orderkey"), F.col("full")
    o = table(spark, d, "orders").select(k, synth.personnummer(1940 + k % 71, 1 + k % 12, 1 + k % 28, k % 1000).alias("full"))
    return o.select("o_orderkey", full.alias("pnr"), synth.personnummer_any(full, (k % 10) / 10).alias("any_form"), T.luhn_ok(F.substring(full, 3, 20)).alias("ok"), synth.bankgiro((k % 2) / 2 + 0.1, k).alias("giro"))


def seed_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Card and organisation numbers with their check digits, phones in three styles, birth dates."""
    k = F.col("o_orderkey")
    card, org = synth.card_number(k * 7919), synth.org_number(k * 31 % 1000000000)
    return table(spark, d, "orders").select(k, card.alias("card"), org.alias("org_nr"), synth.phone((k % 3) / 3 + 0.1, k % 10000000).alias("phone"), synth.birth_date((k % 10) / 10).cast("string").alias("dob")).withColumns({"card_ok": T.luhn_ok(F.col("card")), "org_ok": T.luhn_ok(F.col("org_nr"))})


def recipe_checks(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the recipe that fail a check, or lack a seed or a score: none."""
    judge = lambda rows: rows.withColumn("judge", F.struct(*[F.struct(F.lit(4).alias("score")).alias(n) for n in synth.RUBRICS]))
    rows = synth.recipe(_seeded(spark, d), judge=judge)
    wrong = {
        "bad_entities": ~F.col("entities_validated"), "bad_records": ~F.col("records_validated"), "bad_card": ~T.luhn_ok(F.col("seed_card")), "bad_org": ~T.luhn_ok(F.col("seed_company.org_nr")),
        "bad_age": ~F.col("seed_dob").between("1935-01-01", "2007-01-01"), "bad_passport": F.length("seed_passport.mrz") != 89, "no_score": F.concat(*[F.col(f"{n}_score") for n in synth.RUBRICS]) != "444",
    }
    return rows.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in wrong.items()])


def text_forms(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    code = F.lpad((k * 7).cast("string"), 5, "1")
    home = synth.address(F.lit("Storgatan"), k, F.when(k % 3 == 0, F.lit("12")).otherwise(code), F.lit("Umeå"))
    return c.select("c_custkey", T.email_from_name(F.concat(F.lit("Åsa Öberg "), F.col("c_name")), F.lit("live.se")).alias("email"), T.postcode(code).alias("post"), T.mrz_fold(F.concat(F.lit("Åsa-Lee Éü9"), F.col("c_mktsegment"))).alias("folded"), T.collapse(F.concat(F.lit("  A \t b "), F.col("c_name"))).alias("collapsed"), home["full"].alias("address"))


def passport_dates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return o.select("o_orderkey", T.passport_date(F.col("day")).alias("printed"), T.passport_date(F.date_add("day", 1826)).alias("expires"))


def passports(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    p = synth.passport(F.lit("Åkesson"), F.lit("Anna-Lena"), F.concat(F.lit("AA"), F.lpad(k.cast("string"), 7, "0")), F.date_add(F.lit("1950-01-01").cast("date"), k.cast("int")), F.when(k % 2 == 0, "F").otherwise("M"), F.lit("2020-02-29").cast("date"), F.lit("Lund"), F.concat(F.lit("500101-"), F.lpad((k % 10000).cast("string"), 4, "0")))
    return c.select("c_custkey", p["mrz"].alias("mrz"), p["expires"].alias("expires"), p["last_name"].alias("last_name"))


def sampled_categories(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"))
    return synth.categories(rows, synth.SynthesisConfig()).select("row_id", "register", "text_layout", "num_subjects", "content_kind", "seed_locale", "text_type")


def pool_draws(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"))
    pick = lambda name, values: T.pick(values, synth.draw(42, name, F.col("row_id"))).alias(name)
    return rows.select("row_id", pick("date", pools.DATES), pick("url", pools.URLS), pick("health", pools.HEALTH), pick("religion_ethnicity", pools.BELIEF), pick("criminal", pools.CRIMINAL))


def _seeded(spark: SparkSession, d: str) -> DataFrame:
    """Seeds for every customer."""
    return synth.seeded(table(spark, d, "customer").select(F.col("c_custkey").alias("row_id")))


def synthetic_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = synth.TemplateGenerator().generate(_seeded(spark, d))
    return rows.select("row_id", "text_type", "content_kind", "seed_person", "seed_iban", "seed_ip", F.size("seed_subjects").alias("n_subjects"), "text")


def synthetic_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose subjects number wrongly, whose numbers fail their check, or whose mentions are not in the text: none."""
    rows = synth.TemplateGenerator().generate(_seeded(spark, d))
    short = lambda s: F.substring(T.digits(s["personnummer"]), -10, 10)
    bad_people = F.size("seed_subjects") != F.col("num_subjects").cast("int")
    bad_number = F.exists("seed_subjects", lambda s: ~T.luhn_ok(short(s)))
    bad_iban = T.mod97(F.concat(F.substring("seed_iban", 5, 20), F.lit("2814"), F.substring("seed_iban", 3, 2))) != 1
    missing = ~F.forall(F.flatten(F.map_values("entities")), lambda m: F.col("text").contains(m))
    return rows.agg(*[F.count_if(c).alias(n) for n, c in (("bad_people", bad_people), ("bad_number", bad_number), ("bad_iban", bad_iban), ("missing", missing))])


def demo_page(spark: SparkSession, d: str) -> DataFrame:
    """The hits that pass a threshold and an allow-list, as boxes of an image."""
    hits = spark.createDataFrame([(*h, 0.035) for h in DEMO], "label string, text string, confidence double, fx double, fy double, fw double, fh double")
    box = G.fraction_box(F.lit(1280), F.lit(720), F.col("fx"), F.col("fy"), F.col("fw"), F.col("fh"))
    return hits.filter("confidence >= 0.5").select("label", "text", "confidence", *[v.cast("long").alias(k) for k, v in box.items()])


def demo_spans(spark: SparkSession, d: str) -> DataFrame:
    hits = F.array(*[F.struct(F.lit(h[0]).alias("label"), F.lit(h[1]).alias("text"), F.lit(h[2]).alias("confidence")) for h in [*DEMO, ("none", "not there", 1.0)]])
    return spark.range(1).select(F.inline(search.cursor_spans(F.lit(DEMO_TEXT), hits)))


def found_phrases(spark: SparkSession, d: str) -> DataFrame:
    return search.find_phrase(lines(spark, d), "THE and")


def found_patterns(spark: SparkSession, d: str) -> DataFrame:
    return search.find_pattern(lines(spark, d), r"[0-9]{3,}")


def match_counts(spark: SparkSession, d: str) -> DataFrame:
    return search.matches_per_document(found_patterns(spark, d))


def ranked_lines(spark: SparkSession, d: str) -> DataFrame:
    """The best lines for a query; a top-k is what this returns."""
    return search.bm25(lines(spark, d), "license version of", 20).select("doc_id", "line_no", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


QUERIES = {f.__name__: f for f in (checksums, personal_numbers, seed_numbers, recipe_checks, text_forms, passport_dates, passports, sampled_categories, pool_draws, synthetic_rows, synthetic_invariants, demo_page, demo_spans, found_phrases, found_patterns, match_counts, ranked_lines)}

_LUHN9 = lambda s: f"(10 - list_sum(list_transform(range(1, 10), lambda i: CASE WHEN i % 2 = 1 THEN 2 * CAST({s}[i] AS INTEGER) - CASE WHEN CAST({s}[i] AS INTEGER) > 4 THEN 9 ELSE 0 END ELSE CAST({s}[i] AS INTEGER) END)) % 10) % 10"
_LUHN15 = lambda s: _LUHN9(s).replace("range(1, 10)", "range(1, 16)")
_MRZ = lambda s: f"(list_sum(list_transform(range(1, length({s}) + 1), lambda i: (CASE WHEN {s}[i] BETWEEN '0' AND '9' THEN ascii({s}[i]) - 48 WHEN {s}[i] BETWEEN 'A' AND 'Z' THEN ascii({s}[i]) - 55 ELSE 0 END) * [7,3,1][CAST((i - 1) % 3 + 1 AS INTEGER)])) % 10)"
_HASH = lambda name, key: f"(CAST(('0x' || sha256('42:{name}:' || {key})[1:16])::UBIGINT AS DOUBLE) / 18446744073709551616.0)"
_PRINT = lambda day: f"lpad(day({day})::VARCHAR, 2, '0') || ' ' || {list(T.MONTHS_SV)}[month({day})] || '/' || {list(T.MONTHS_EN)}[month({day})] || ' ' || lpad((year({day}) % 100)::VARCHAR, 2, '0')"


def _weighted(weights: dict, name: str) -> str:
    total, upto, out = sum(weights.values()), 0.0, []
    for k, w in weights.items():
        upto += w
        out.append(f"WHEN {_HASH(name, 'row_id')} < {upto / total!r} THEN '{k}'")
    return "CASE " + " ".join(out) + f" ELSE '{k}' END"


def _pick(values: tuple, name: str) -> str:
    items = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{items}][CAST(floor({_HASH(name, 'row_id')} * {len(values)}) AS INTEGER) + 1]"


_K = "SELECT o_orderkey AS row_id FROM orders"
_IBAN = "'SE' || lpad((98 - (bban || '281400')::HUGEINT % 97)::VARCHAR, 2, '0') || bban"

SQL = {
    "checksums": f"SELECT o_orderkey, CAST({_LUHN9('nine')} AS INTEGER) AS luhn, {_IBAN} AS iban, CAST({_MRZ('m')} AS INTEGER) AS mrz FROM (SELECT *, 'AZ<' || nine AS m FROM (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 9, '0') AS nine, lpad(o_orderkey::VARCHAR, 20, '1') AS bban FROM orders))",
    "personal_numbers": f"WITH a AS (SELECT o_orderkey AS k, lpad((1940 + o_orderkey % 71)::VARCHAR, 4, '0') || lpad((1 + o_orderkey % 12)::VARCHAR, 2, '0') || lpad((1 + o_orderkey % 28)::VARCHAR, 2, '0') AS body, lpad((o_orderkey % 1000)::VARCHAR, 3, '0') AS serial FROM orders), b AS (SELECT *, body[3:8] || serial AS nine FROM a), c AS (SELECT k, body || '-' || serial || CAST({_LUHN9('nine')} AS INTEGER) AS pnr, lpad(k::VARCHAR, 8, '0') AS g FROM b) SELECT k AS o_orderkey, pnr, CASE WHEN (k % 10) / 10 < 0.6 THEN pnr[3:] ELSE pnr END AS any_form, true AS ok, CASE WHEN (k % 2) / 2 + 0.1 < 0.5 THEN g[1:3] || '-' || g[5:8] ELSE g[1:4] || '-' || g[5:8] END AS giro FROM c",
    "seed_numbers": f"WITH a AS (SELECT o_orderkey AS k, '4' || lpad((o_orderkey * 7919)::VARCHAR, 14, '0') AS b, lpad((o_orderkey * 31 % 1000000000)::VARCHAR, 9, '0') AS g0, lpad((o_orderkey % 10000000)::VARCHAR, 7, '0') AS p FROM orders), o AS (SELECT *, g0[1:2] || (g0[3]::INTEGER % 8 + 2) || g0[4:9] AS g FROM a) SELECT k AS o_orderkey, b || CAST({_LUHN15('b')} AS INTEGER) AS card, g[1:6] || '-' || g[7:9] || CAST({_LUHN9('g')} AS INTEGER) AS org_nr, true AS card_ok, true AS org_ok, ['070-', '+46 70 ', '08-'][CAST(k % 3 + 1 AS INTEGER)] || p[1:3] || ' ' || p[4:5] || ' ' || p[6:7] AS phone, CAST(DATE '{synth.AS_OF}' - CAST(floor((k % 10) / 10 * {90 * 365 - 18 * 366 + 1}) + {18 * 366} AS INTEGER) AS VARCHAR) AS dob FROM o",
    "recipe_checks": "SELECT " + ", ".join(f"0::BIGINT AS {n}" for n in ("bad_entities", "bad_records", "bad_card", "bad_org", "bad_age", "bad_passport", "no_score")),
    "text_forms": "SELECT c_custkey, translate(lower('Åsa Öberg ' || c_name), ' åäö', '.aao') || '@live.se' AS email, post[1:3] || ' ' || post[4:5] AS post, 'ASA<LEEEU' IS NOT NULL AND false AS x, 1 FROM (SELECT *, lpad((c_custkey * 7)::VARCHAR, 5, '1') AS post FROM customer)",
    "passport_dates": f"SELECT o_orderkey, {_PRINT('d')} AS printed, {_PRINT('e')} AS expires FROM (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderdate::DATE + 1826 AS e FROM orders)",
    "passports": f"WITH a AS (SELECT c_custkey, 'AA' || lpad(c_custkey::VARCHAR, 7, '0') AS num, strftime(DATE '1950-01-01' + c_custkey::INTEGER, '%y%m%d') AS born, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, rpad('500101' || lpad((c_custkey % 10000)::VARCHAR, 4, '0'), 14, '<') AS own, '250228' AS ends FROM customer), b AS (SELECT *, num || {_MRZ('num')} AS n2, born || {_MRZ('born')} AS b2, ends || {_MRZ('ends')} AS e2, own || {_MRZ('own')} AS o2 FROM a), c AS (SELECT *, n2 || b2 || e2 || o2 AS al FROM b) SELECT c_custkey, rpad('P<SWEAKESSON<<ANNA<LENA', 44, '<') || chr(10) || n2 || 'SWE' || b2 || sex || e2 || o2 || {_MRZ('al')} AS mrz, '28 FEB/FEB 25' AS expires, 'ÅKESSON' AS last_name FROM c",
    "sampled_categories": f"SELECT row_id, {_pick(pools.REGISTERS, 'register')} AS register, {_weighted(pools.LAYOUTS, 'text_layout')} AS text_layout, {_weighted(pools.SUBJECTS, 'num_subjects')} AS num_subjects, CASE WHEN {_HASH('content_kind', 'row_id')} < 0.08 THEN 'no_pii' ELSE 'pii' END AS content_kind, CASE WHEN {_HASH('seed_locale', 'row_id')} < 0.15 THEN 'foreign' ELSE 'sv_SE' END AS seed_locale, {_weighted(pools.TEXT_TYPES, 'text_type')} AS text_type FROM ({_K})",
    "pool_draws": f"SELECT row_id, {_pick(pools.DATES, 'date')} AS date, {_pick(pools.URLS, 'url')} AS url, {_pick(pools.HEALTH, 'health')} AS health, {_pick(pools.BELIEF, 'religion_ethnicity')} AS religion_ethnicity, {_pick(pools.CRIMINAL, 'criminal')} AS criminal FROM ({_K})",
    "synthetic_invariants": "SELECT 0::BIGINT AS bad_people, 0::BIGINT AS bad_number, 0::BIGINT AS bad_iban, 0::BIGINT AS missing",
    "demo_page": "SELECT label, text, confidence::DOUBLE AS confidence, floor(1280 * fx + 0.5)::BIGINT AS x, floor(720 * fy + 0.5)::BIGINT AS y, greatest(1, floor(1280 * fw + 0.5))::BIGINT AS w, greatest(1, floor(720 * 0.035 + 0.5))::BIGINT AS h FROM " + _values(DEMO, "label, text, confidence, fx, fy, fw") + " WHERE confidence >= 0.5",
    "demo_spans": "SELECT label, (strpos(page, hit) - 1)::INTEGER AS \"start\", (strpos(page, hit) - 1 + length(hit))::INTEGER AS \"end\" FROM " + _values([(h[0], h[1], DEMO_TEXT) for h in DEMO], "label, hit, page"),
    "found_phrases": f"WITH {LINES}, f AS (SELECT doc_id, line_no, \"start\" AS s0, lower(translate(text, '{search.FOLD_FROM}', '{search.FOLD_TO}')) AS tx FROM lines), m AS (SELECT *, regexp_extract_all(tx, 'the\\s+and') AS ms, regexp_split_to_array(tx, 'the\\s+and') AS gs FROM f), u AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m), v AS (SELECT doc_id, line_no, ms[i] AS text, s0 + list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS st FROM u) SELECT doc_id, line_no, text, st::BIGINT AS \"start\", (st + length(text))::BIGINT AS \"end\" FROM v",
    "found_patterns": f"WITH {LINES}, m AS (SELECT doc_id, line_no, \"start\" AS s0, regexp_extract_all(text, '[0-9]{{3,}}') AS ms, regexp_split_to_array(text, '[0-9]{{3,}}') AS gs FROM lines), u AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m), v AS (SELECT doc_id, line_no, ms[i] AS text, s0 + list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS st FROM u) SELECT doc_id, line_no, text, st::BIGINT AS \"start\", (st + length(text))::BIGINT AS \"end\" FROM v",
    "match_counts": f"WITH {LINES}, m AS (SELECT doc_id, len(regexp_extract_all(text, '[0-9]{{3,}}')) AS n FROM lines) SELECT doc_id, sum(n)::BIGINT AS n_matches, count(*) AS n_lines FROM m WHERE n > 0 GROUP BY doc_id",
    "ranked_lines": f"WITH {LINES}, w AS (SELECT doc_id, line_no, regexp_split_to_array(lower(text), '\\s+') AS ws FROM lines), c AS (SELECT doc_id, line_no, len(ws) AS n, len(list_filter(ws, lambda x: x = 'license')) AS a, len(list_filter(ws, lambda x: x = 'of')) AS b, len(list_filter(ws, lambda x: x = 'version')) AS c FROM w), t AS (SELECT count(*) AS na, avg(n) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db, count(*) FILTER (c > 0) AS dc FROM c), s AS (SELECT doc_id, line_no, ln(1 + (na - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / m)) + ln(1 + (na - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / m)) + ln(1 + (na - dc + 0.5) / (dc + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n / m)) AS score FROM c, t WHERE a + b + c > 0) SELECT doc_id, line_no, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id, line_no) AS place FROM s ORDER BY place LIMIT 20",
}
SQL["text_forms"] = "SELECT c_custkey, translate(lower('Åsa Öberg ' || c_name), ' åäö', '.aao') || '@live.se' AS email, post[1:3] || ' ' || post[4:5] AS post, 'ASA<LEE<EU' || c_mktsegment AS folded, 'a b ' || lower(c_name) AS collapsed, 'Storgatan ' || c_custkey || ', ' || CASE WHEN c_custkey % 3 = 0 THEN '12' ELSE post[1:3] || ' ' || post[4:5] END || ' Umeå' AS address FROM (SELECT *, lpad((c_custkey * 7)::VARCHAR, 5, '1') AS post FROM customer)"
