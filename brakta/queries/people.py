"""Labelled rows made of customers, several people a row, and the operators that read them; rules and labels on tables."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from io import BytesIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brakta import jobs
from brakta.functions import parsing
from brakta.functions.text import is_label_key, slug
from brakta.operators import boxes, curate, filters, geometry, search, synth, tasks, taxonomy, validate
from brakta.operators.detect import browser_label, clean_candidates
from brakta.queries.base import LINES, SPANS0, documents, lines, raw_spans, table
from brakta.queries.detection import _values
from brakta.queries.generators import _HASH, _weighted
from brakta.queries.rows import _CLASS, _SPLIT, NAMES
from brakta.operators import pools
from brakta.plans.staging import folder
from brakta.sources import io, sinks


def letters(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, text, entities, company, records, records_validated): three customers share a letter, which is about none to three of them.

    Every fifth customer's address is not in the text; every fifth letter names its people in its records only.
    """
    k = F.col("c_custkey")
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    one = F.struct(k.alias("k"), F.col("c_name").alias("name"), F.concat(F.lpad(k.cast("string"), 8, "0"), F.lit("-"), F.lpad((k % 10000).cast("string"), 4, "0")).alias("number"), F.concat(F.lit("c"), k.cast("string"), F.lit("@mail.se")).alias("email"))
    all_ = c.groupBy(F.floor(k / 3).alias("row_id")).agg(F.sort_array(F.collect_list(one)).alias("all"), F.min_by("n_name", k).alias("company"))
    rows = all_.withColumn("p", F.filter("all", lambda x: x["k"] % 3 < F.col("row_id") % 4))
    said = F.transform("p", lambda x: F.concat(x["name"], F.lit(", "), x["number"], F.when(x["k"] % 5 != 0, F.concat(F.lit(", "), x["email"])).otherwise("")))
    text = F.concat(F.array_join(said, ". "), F.when(F.col("row_id") % 2 == 0, F.concat(F.lit(" hos "), "company")).otherwise(""), F.when(F.col("row_id") % 3 == 0, " har astma").otherwise(" ."))
    none = F.array().cast("array<string>")
    named = F.col("row_id") % 5 != 1
    each = lambda f: F.transform("p", lambda x: x[f])
    entities = F.create_map(F.lit("person"), F.when(named, each("name")).otherwise(none), F.lit("personnummer"), F.when(named, each("number")).otherwise(none), F.lit("email"), each("email"), F.lit("health"), F.when(F.col("row_id") % 3 == 0, F.array(F.lit("astma"))).otherwise(none))
    records = F.transform("p", lambda x: F.create_map(F.lit("name"), x["name"], F.lit("personnummer"), x["number"], F.lit("email"), x["email"]))
    return rows.select("row_id", text.alias("text"), entities.alias("entities"), "company", records.alias("records"), (F.col("row_id") % 7 != 0).alias("records_validated"))


def _examples(spark: SparkSession, d: str) -> DataFrame:
    rows = letters(spark, d)
    return rows.select("row_id", tasks.example(F.col("text"), F.col("entities"), F.col("company"), F.col("records"), F.col("records_validated")).alias("e")).select("row_id", "e.*")


def letter_examples(spark: SparkSession, d: str) -> DataFrame:
    e = _examples(spark, d)
    return e.select("row_id", F.array_join("sensitivity", ",").alias("classes"), "structures", F.array_join(F.transform("relations", lambda r: F.concat_ws(":", r["span"], r["label"], r["owner"])), ",").alias("relations"))


def letter_coverage(spark: SparkSession, d: str) -> DataFrame:
    return curate.coverage(_examples(spark, d))


def letter_splits(spark: SparkSession, d: str) -> DataFrame:
    return curate.with_split(letters(spark, d), NAMES).select("row_id", "group_key", "split")


def letter_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities as JSON cells, and which labels are left when these are read again."""
    rows = letters(spark, d).withColumn("cell", F.to_json("entities"))
    return rows.select("row_id", "cell", F.array_join(F.array_sort(F.map_keys(parsing.sparse_entities(F.col("cell"), NAMES))), ",").alias("labels"))


def listed_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities as a list of labels with mentions, one label twice and one unknown."""
    cell = F.concat(F.lit('[{"label":"person","mentions":["'), "c_name", F.lit('"]},{"label":"odd","mentions":["x"]},{"label":"email","mentions":["",null]}'), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(',{"label":"person","mentions":["'), "c_mktsegment", F.lit('",""]}'))).otherwise(""), F.lit("]"))
    found = parsing.sparse_entities(cell, NAMES)
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.map_keys(found), ",").alias("labels"), F.array_join(found["person"], "/").alias("people"))


def record_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of records in several forms, as the three readers of such cells take them."""
    k, name = F.col("c_custkey") % 6, F.col("c_name")
    cell = (
        F.when(k == 0, F.concat(F.lit('[{"name":"'), name, F.lit('","phone":null},{"name":"B"}]'))).when(k == 1, F.concat(F.lit('{"name":"'), name, F.lit('"}')))
        .when(k == 2, F.concat(F.lit('[5,{"name":"'), name, F.lit('"}]'))).when(k == 3, F.concat(F.lit('"'), name, F.lit('"'))).when(k == 4, F.concat(F.lit("[{'name': '"), name, F.lit("'}, {}]")))
    )
    rows = parsing.as_json(table(spark, d, "customer").withColumn("cell", cell), "cell", "json")
    shown = lambda r: F.array_join(F.transform(r, lambda x: F.coalesce(x["name"], F.lit("-"))), ",")
    return rows.select("c_custkey", F.coalesce(shown(parsing.strict_records(F.col("json"))), F.lit("none")).alias("strict"), shown(parsing.found_records(F.col("json"))).alias("found"), shown(parsing.sequence(F.col("json"))).alias("sequence"))


def customer_addresses(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("c_custkey"), F.col("c_name")
    rec = F.when(k % 5 == 0, F.concat(F.upper(name), F.lit("  Gatan"))).when(k % 5 == 1, "").when(k % 5 == 2, name).when(k % 5 == 3, F.concat(F.lit("x"), name))
    seed = F.when(k % 7 == 0, " ").otherwise(F.concat(name, F.lit(" gatan, Umeå")))
    return table(spark, d, "customer").select("c_custkey", validate.address_matches(rec, seed).alias("matches"))


def event_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Events as a model's raw candidates, some without whole-number offsets, a text or a confidence."""
    k, text = F.col("event_id"), lambda c: c.cast("string")
    raw = table(spark, d, "events").select(
        k.alias("doc_id"), F.col("event_type").alias("label"), F.when(k % 5 != 0, F.col("props")).alias("text"), F.when(k % 3 == 1, "x").otherwise(text(k)).alias("start"),
        F.when(k % 4 != 1, text(k + 5)).alias("end"), F.when(k % 6 == 1, "oops").when(k % 6 != 2, text(F.col("value"))).alias("confidence"))
    return clean_candidates(raw)


def part_keys(spark: SparkSession, d: str) -> DataFrame:
    made = slug(F.concat(F.lit("  "), "p_name", F.lit("! "), "p_type", F.lit("_")))
    return table(spark, d, "part").select("p_partkey", made.alias("slug"), is_label_key(made).alias("valid"))


def labels_left(spark: SparkSession, d: str) -> DataFrame:
    (left,) = filters.without_labels(["email", "phone"], raw_spans(spark, d))
    return left.groupBy("label").agg(F.count("*").alias("n"))


def _rules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(F.col("c_name").alias("label"), F.when(k % 3 != 0, "a+").alias("regex"), F.lit("full").alias("mode"), F.when(k % 4 == 0, 0.5).otherwise(0.0).alias("threshold"), (k % 11 == 0).alias("luhn"))


def customised_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules by name against the same with every fifth taken back."""
    base = _rules(spark, d)
    n = F.substring("label", -4, 4).cast("int")
    return filters.customised(base.withColumn("regex", F.when(n % 5 == 0, F.lit(None)).otherwise(F.col("regex"))), base)


def active_rules(spark: SparkSession, d: str) -> DataFrame:
    return filters.rule_counts(_rules(spark, d))


def toggled_segments(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("other")
    return table(spark, d, "customer").select("c_custkey", F.array_join(filters.toggled(F.array("c_mktsegment", F.lit("URL")), label), ",").alias("enabled"))


def words_in_turn(spark: SparkSession, d: str) -> DataFrame:
    """The second, first and fourth word of a turn, each looked for behind the one found before it."""
    word = lambda n: F.split_part("text", F.lit(" "), F.lit(n))
    rows = table(spark, d, "conversations").filter((word(1) != "") & (word(2) != "") & (word(4) != ""))
    hits = F.array(*[F.struct(F.lit(k).alias("label"), word(n).alias("text"), F.lit(1.0).alias("confidence")) for k, n in (("second", 2), ("first", 1), ("fourth", 4))])
    return rows.select("conv_id", "turn", F.inline(search.cursor_spans(F.col("text"), hits)))


def event_labels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, d, "events").select("event_id", browser_label(F.when(k % 2 == 0, F.upper("event_type")), F.when(k % 3 == 0, F.concat(F.lit("B-"), "event_type"))).alias("label"))


def nation_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of nations with those of supplied ones laid over, which may be new."""
    base = table(spark, d, "nation").filter("n_nationkey % 3 <> 0").select(F.col("n_name").alias("label"), F.lit("#000000").alias("color"), F.lower("n_name").alias("display"))
    custom = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return boxes.merged_meta(base, custom.select(F.col("n_name").alias("label"), F.when(F.col("n_nationkey") % 2 == 0, "#ffffff").alias("color"), F.concat("n_name", F.lit(" "), F.col("n").cast("string")).alias("display")))


def detector_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """What a detector is asked with when nations are labels of their own; a label a row."""
    custom = [{"key": r["key"], "displayLabel": r["n_name"]} for r in table(spark, d, "nation").select(slug(F.col("n_name")).alias("key"), "n_name").collect()]  # as many as people write
    got = filters.label_descriptions(dict.fromkeys(taxonomy.TRAINED, "default"), {"email": "mail", "nope": "x", "url": ""}, custom)
    return spark.createDataFrame(sorted(got.items()), "label string, description string")


def shown_labels(spark: SparkSession, d: str) -> DataFrame:
    """What is found in documents, with tier, colour, name and default pattern of each label."""
    found = raw_spans(spark, d).groupBy("label").agg(F.count("*").alias("n")).join(taxonomy.labels_table(spark), "label").withColumn("key", filters.aliased(F.col("label")))
    meta, rules = taxonomy.meta_table(spark).withColumnRenamed("label", "key"), taxonomy.rules_table(spark).withColumnRenamed("label", "key")
    return found.join(meta, "key").join(rules, "key").select("key", "n", "tier", "color", "display", "regex", "mode")


def name_pools(spark: SparkSession, d: str) -> DataFrame:
    pools_ = table(spark, d, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list("c_name")).alias("names"))
    return pools_.select("c_nationkey", F.size("names").cast("long").alias("n"), curate.pool_hash(F.col("names")).alias("sha"))


def synthetic_people(spark: SparkSession, d: str) -> DataFrame:
    """How many people each row has, whether the first is foreign, and how many of them have no address of a name."""
    rows = synth.seeded(table(spark, d, "customer").select(F.col("c_custkey").alias("row_id")))
    bad = F.size(F.filter("seed_subjects", lambda s: (s["name"] == "") | ~s["email"].contains("@") | (F.length(F.regexp_replace(s["personnummer"], "[^0-9]", "")) < 10)))
    return rows.select("row_id", F.size("seed_subjects").cast("long").alias("n_people"), (F.col("seed_locale") == "foreign").alias("is_foreign"), bad.cast("long").alias("n_bad"))


def uploaded_pages(spark: SparkSession, d: str) -> DataFrame:
    """Even pages as a session, odd ones as files added to it, some of which could not be read."""
    p, k = table(spark, d, "pages"), F.col("page_id")
    session = p.filter(k % 2 == 0).select(k.alias("page_no"), F.col("url").alias("file_name"), F.lit(800).alias("width"), F.lit(600).alias("height"), F.length("html").cast("string").alias("text"))
    files = p.filter(k % 2 == 1).select(k.alias("place"), F.col("url").alias("file_name"), F.when(k % 3 != 0, 640).alias("width"), F.lit(480).alias("height"))
    return io.uploaded(session, files, append=True)


def pages_as_files(spark: SparkSession, d: str) -> DataFrame:
    """Every page as a file, read back."""
    out = folder(spark, "files")
    sinks.save_files(table(spark, d, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit("-redacted.txt")).alias("name"), F.col("html").alias("content")), out)
    back = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(out)
    return back.select(F.regexp_extract("path", r"page-(\d+)-redacted", 1).cast("long").alias("page_id"), F.col("length"), F.sha2("content", 256).alias("sha"))


def pages_as_archives(spark: SparkSession, d: str) -> DataFrame:
    """Pages in archives of a hundred, by their directories as they are read back."""
    out = folder(spark, "archives")
    p = table(spark, d, "pages").select(F.concat(F.floor(F.col("page_id") / 100).cast("string"), F.lit(".zip")).alias("name"), F.col("page_id").alias("place"), io.archive_entry(F.col("page_id") % 100, F.col("url")).alias("entry"), F.col("html").alias("content"))
    sinks.save_archives(p, out)
    back = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(out).select("path", "content")
    return back.mapInPandas(_entries, "archive string, place int, entry string, bytes long")


def _entries(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for path, content in zip(part["path"], part["content"], strict=True):
            with zipfile.ZipFile(BytesIO(content)) as z:
                yield pd.DataFrame([(path.rsplit("/", 1)[1], i, e.filename, e.file_size) for i, e in enumerate(z.infolist())], columns=["archive", "place", "entry", "bytes"])


def document_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as polygons that an OCR engine gives, read back as lines."""
    rows = documents(spark, d).select(F.col("doc_id").alias("image_id"), F.lit(1).alias("page_no"), F.split("text", "\n", -1).alias("texts"))
    corner = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    box = lambda t, i: F.array(corner(F.lit(0.9), i * 20), corner(F.length(t) * 8, i * 20), corner(F.length(t) * 8, i * 20 + 16), corner(F.lit(0), i * 20 + 16))
    found = geometry.page_lines(rows.withColumn("polys", F.transform("texts", box)))
    return found.select("image_id", "line_no", "start", "end", "x", "y", "w", "h")


def converted_lines(spark: SparkSession, d: str) -> DataFrame:
    """Training lines of labelled documents, valid where their quality is 1, and what an OCR engine would make of them."""
    mail = raw_spans(spark, d).filter("label in ('email', 'ip_address')").groupBy("doc_id", "label").agg(F.array_sort(F.collect_set("text")).alias("ms")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "ms")))).alias("entities"))
    valid = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("entities_validated"))
    rows = documents(spark, d).join(valid, "doc_id").join(mail, "doc_id", "left").withColumn("entities", F.coalesce("entities", F.create_map().cast("map<string,array<string>>")))
    made = jobs.converted(rows, "doc_id", noise_rate=0.0)
    return io.example_lines(made.drop("noisy")).select("split", F.col("value").alias("line"), F.lit(1).alias("one")).groupBy("split", "line").agg(F.count("one").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        letter_examples, letter_coverage, letter_splits, letter_entities, listed_entities, record_cells, customer_addresses, event_candidates, part_keys, labels_left, customised_rules, active_rules, toggled_segments,
        words_in_turn, event_labels, nation_labels, detector_descriptions, shown_labels, name_pools, synthetic_people, uploaded_pages, pages_as_files, pages_as_archives, document_polygons, converted_lines,
    )
}

_LETTERS = """people AS (
    SELECT c_custkey AS k, c_custkey // 3 AS row_id, c_name AS name, lpad(c_custkey::VARCHAR, 8, '0') || '-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS number, 'c' || c_custkey || '@mail.se' AS email, n_name,
           c_custkey % 3 < (c_custkey // 3) % 4 AS inside FROM customer JOIN nation ON c_nationkey = n_nationkey
), letters AS (
    SELECT row_id, arg_min(n_name, k) AS company, row_id % 7 <> 0 AS ok, row_id % 5 <> 1 AS named, count(*) FILTER (inside) AS n,
           coalesce(list(name ORDER BY k) FILTER (inside), []) AS names, coalesce(list(number ORDER BY k) FILTER (inside), []) AS numbers, coalesce(list(email ORDER BY k) FILTER (inside), []) AS emails, coalesce(list(email ORDER BY k) FILTER (inside AND k % 5 <> 0), []) AS told,
           coalesce(string_agg(name || ', ' || number || CASE WHEN k % 5 <> 0 THEN ', ' || email ELSE '' END, '. ' ORDER BY k) FILTER (inside), '') || CASE WHEN row_id % 2 = 0 THEN ' hos ' || arg_min(n_name, k) ELSE '' END || CASE WHEN row_id % 3 = 0 THEN ' har astma' ELSE ' .' END AS text,
           '[' || string_agg('{"name":"' || name || '","personnummer":"' || number || '"' || CASE WHEN k % 5 <> 0 THEN ',"email":"' || email || '"' ELSE '' END || '}', ',' ORDER BY k) FILTER (inside) || ']' AS several,
           string_agg(number || ':personnummer:' || name || CASE WHEN k % 5 <> 0 THEN ',' || email || ':email:' || name ELSE '' END, ',' ORDER BY k) FILTER (inside) AS edges
    FROM people GROUP BY row_id
), seen AS (
    SELECT *, CASE WHEN named THEN names ELSE [] END AS persons, CASE WHEN named THEN numbers ELSE [] END AS ids, company LIKE '% %' AND row_id % 2 = 0 AS employed FROM letters
), examples AS (
    SELECT row_id, CASE WHEN len(persons) + len(told) > 0 THEN CASE WHEN row_id % 3 = 0 THEN 'direct_pii,art9_health' ELSE 'direct_pii' END WHEN row_id % 3 = 0 THEN 'art9_health' ELSE 'no_sensitive' END AS classes,
           CASE WHEN ok AND n > 1 THEN several WHEN len(persons) > 1 OR (len(persons) = 0 AND len(told) = 0 AND NOT employed) THEN '[]'
                ELSE '[{' || array_to_string(list_filter([CASE WHEN len(persons) > 0 THEN '"name":"' || persons[1] || '"' END, CASE WHEN len(ids) > 0 THEN '"personnummer":"' || ids[1] || '"' END, CASE WHEN len(told) > 0 THEN '"email":"' || told[1] || '"' END, CASE WHEN employed THEN '"employer":"' || company || '"' END], lambda x: x IS NOT NULL), ',') || '}]' END AS structures,
           CASE WHEN ok AND n > 1 THEN edges WHEN len(persons) = 1 THEN ids[1] || ':personnummer:' || persons[1] || CASE WHEN len(told) > 0 THEN ',' || told[1] || ':email:' || persons[1] ELSE '' END ELSE '' END AS relations
    FROM seen
)"""
_SLUG = lambda x: f"regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')"
_EVEN = lambda x: f"trim(regexp_replace(lower(coalesce({x}, '')), '\\s+', ' ', 'g'))"
_TOKEN = lambda m: f"regexp_matches(text, '(?:^|[^' || {_CLASS} || '])' || regexp_escape({m}) || '(?:$|[^' || {_CLASS} || '])')"

SQL = {
    "letter_examples": f"WITH {_LETTERS} SELECT * FROM examples",
    "letter_coverage": f"WITH {_LETTERS} SELECT count(*) AS entities, count(*) AS classification, count(*) FILTER (structures <> '[]') AS structures, count(*) FILTER (relations <> '') AS relations, count(*) AS rows FROM examples",
    "letter_splits": f"WITH {_LETTERS}, g AS (SELECT row_id, CASE WHEN n > 0 AND (named OR ok) THEN 'ids::' || array_to_string(list_sort(list_distinct(list_concat(names, numbers))), '|') ELSE 'text::' || sha256(text) END AS group_key FROM letters) SELECT row_id, group_key, {_SPLIT('group_key')} AS split FROM g",
    "letter_entities": f"""WITH {_LETTERS} SELECT row_id, '{{"person":' || to_json(persons) || ',"personnummer":' || to_json(ids) || ',"email":' || to_json(emails) || ',"health":' || CASE WHEN row_id % 3 = 0 THEN '["astma"]' ELSE '[]' END || '}}' AS cell,
        array_to_string(list_filter([CASE WHEN len(emails) > 0 THEN 'email' END, CASE WHEN row_id % 3 = 0 THEN 'health' END, CASE WHEN len(persons) > 0 THEN 'person' END, CASE WHEN len(ids) > 0 THEN 'personnummer' END], lambda x: x IS NOT NULL), ',') AS labels FROM seen""",
    "listed_entities": "SELECT c_custkey, 'person' AS labels, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS people FROM customer",
    "record_cells": "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN c_name || ',B' WHEN 4 THEN c_name || ',-' ELSE 'none' END AS strict, CASE c_custkey % 6 WHEN 0 THEN c_name || ',B' WHEN 4 THEN c_name || ',-' WHEN 3 THEN '' WHEN 5 THEN '' ELSE c_name END AS found, CASE c_custkey % 6 WHEN 0 THEN c_name || ',B' WHEN 2 THEN c_name WHEN 4 THEN c_name ELSE '' END AS sequence FROM customer",
    "customer_addresses": f"SELECT c_custkey, CASE WHEN r = '' THEN true WHEN s = '' THEN false ELSE contains(r, s) OR contains(s, r) END AS matches FROM (SELECT c_custkey, {_EVEN('rec')} AS r, {_EVEN('seed')} AS s FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN upper(c_name) || '  Gatan' WHEN 1 THEN '' WHEN 2 THEN c_name WHEN 3 THEN 'x' || c_name END AS rec, CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE c_name || ' gatan, Umeå' END AS seed FROM customer))",
    "event_candidates": "SELECT event_id AS doc_id, event_type AS label, CASE WHEN event_id % 5 <> 0 THEN props ELSE '' END AS text, event_id::INTEGER AS \"start\", (event_id + 5)::INTEGER AS \"end\", CASE WHEN event_id % 6 IN (1, 2) THEN 1.0::DOUBLE ELSE value END AS confidence FROM events WHERE event_id % 3 <> 1 AND event_id % 4 <> 1",
    "part_keys": f"SELECT p_partkey, slug, regexp_matches(slug, '^[a-z][a-z0-9_]*$') AND length(slug) <= 48 AS valid FROM (SELECT p_partkey, {_SLUG(chr(39) + '  ' + chr(39) + ' || p_name || ' + chr(39) + '! ' + chr(39) + ' || p_type || ' + chr(39) + '_' + chr(39))} AS slug FROM part)",
    "labels_left": f"WITH {SPANS0} SELECT label, count(*) AS n FROM spans0 WHERE label NOT IN ('email', 'phone') GROUP BY label",
    "customised_rules": "SELECT c_name AS label, c_custkey % 3 <> 0 AND c_custkey % 5 = 0 AS customised FROM customer",
    "active_rules": "SELECT count(*) AS n_rules, count(*) FILTER (c_custkey % 3 <> 0 OR c_custkey % 4 = 0 OR c_custkey % 11 = 0) AS n_active FROM customer",
    "toggled_segments": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'URL' ELSE c_mktsegment || ',URL,other' END AS enabled FROM customer",
    "words_in_turn": """
        WITH w AS (SELECT conv_id, turn, text, split_part(text, ' ', 2) AS a, split_part(text, ' ', 1) AS b, split_part(text, ' ', 4) AS c FROM conversations),
        one AS (SELECT *, strpos(text, a) - 1 AS s1, strpos(text, a) - 1 + length(a) AS e1 FROM w WHERE a <> '' AND b <> '' AND c <> ''),
        two AS (SELECT *, strpos(text[e1 + 1:], b) AS f2 FROM one),
        placed AS (SELECT *, CASE WHEN f2 > 0 THEN e1 + f2 - 1 END AS s2, CASE WHEN f2 > 0 THEN e1 + f2 - 1 + length(b) ELSE e1 END AS e2 FROM two),
        three AS (SELECT *, strpos(text[e2 + 1:], c) AS f3 FROM placed)
        SELECT conv_id, turn, 'second' AS label, s1::INTEGER AS "start", e1::INTEGER AS "end" FROM three
        UNION ALL SELECT conv_id, turn, 'first', s2::INTEGER, e2::INTEGER FROM three WHERE f2 > 0
        UNION ALL SELECT conv_id, turn, 'fourth', (e2 + f3 - 1)::INTEGER, (e2 + f3 - 1 + length(c))::INTEGER FROM three WHERE f3 > 0""",
    "event_labels": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN lower(event_type) WHEN event_id % 3 = 0 THEN 'b-' || lower(event_type) ELSE 'misc' END AS label FROM events",
    "nation_labels": "WITH b AS (SELECT n_name AS label, lower(n_name) AS display FROM nation WHERE n_nationkey % 3 <> 0), c AS (SELECT n_name AS label, any_value(n_nationkey) AS k, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name) SELECT coalesce(c.label, b.label) AS label, coalesce(CASE WHEN k % 2 = 0 THEN '#ffffff' END, CASE WHEN b.label IS NOT NULL THEN '#000000' END) AS color, coalesce(c.label || ' ' || n, b.display) AS display FROM b FULL JOIN c ON b.label = c.label",
    "detector_descriptions": f"SELECT label, CASE label WHEN 'email' THEN 'mail' ELSE 'default' END AS description FROM {_values([(k,) for k in taxonomy.TRAINED], 'label')} UNION ALL SELECT {_SLUG('n_name')}, n_name FROM nation",
    "shown_labels": f"WITH {SPANS0}, f AS (SELECT label, count(*) AS n FROM spans0 GROUP BY label) SELECT m.label AS key, n, tier, color, display, regex, 'full' AS mode FROM f JOIN {_values(list(taxonomy.LABELS.items()), 'label, tier')} USING (label) JOIN {_values([(k, c, v) for k, (c, v) in taxonomy.META.items()], 'label, color, display').replace('AS t(', 'AS m(')} ON m.label = CASE f.label WHEN 'phone' THEN 'phone_number' WHEN 'bank' THEN 'bank_account' ELSE f.label END JOIN {_values([(k, taxonomy.DEFAULT_PATTERNS.get(k, '')) for k in taxonomy.DEFAULT_ENABLED], 'label, regex').replace('AS t(', 'AS r(')} ON r.label = m.label",
    "name_pools": "SELECT c_nationkey, count(*) AS n, sha256('[\"' || string_agg(c_name, '\", \"' ORDER BY c_name) || '\"]')[1:16] AS sha FROM customer GROUP BY c_nationkey",
    "synthetic_people": f"SELECT row_id, CAST({_weighted(pools.SUBJECTS, 'num_subjects')} AS BIGINT) AS n_people, {_HASH('seed_locale', 'row_id')} < {synth.SynthesisConfig().foreign} AS is_foreign, 0::BIGINT AS n_bad FROM (SELECT c_custkey AS row_id FROM customer)",
    "uploaded_pages": "SELECT page_id AS page_no, url AS file_name, 800 AS width, 600 AS height, length(html)::VARCHAR AS text FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT (SELECT max(page_id) FROM pages WHERE page_id % 2 = 0) + row_number() OVER (ORDER BY page_id), url, 640, 480, '' FROM pages WHERE page_id % 2 = 1 AND page_id % 3 <> 0",
    "pages_as_files": "SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS length, sha256(coalesce(html, '')) AS sha FROM pages",
    "pages_as_archives": r"""SELECT CAST(page_id // 100 AS VARCHAR) || '.zip' AS archive, CAST(row_number() OVER (PARTITION BY page_id // 100 ORDER BY page_id) - 1 AS INTEGER) AS place, lpad(CAST(page_id % 100 AS VARCHAR), 2, '0') || '_' || regexp_replace(regexp_replace(url, '\.[^.]*$', ''), '[/\\:*?"<>|]+', '_', 'g') || '-redacted.png' AS entry, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS bytes FROM pages""",
    "document_polygons": f"WITH {LINES} SELECT doc_id AS image_id, line_no, \"start\", \"end\", x, y, w, h FROM lines",
    "converted_lines": f"""
        WITH {SPANS0}, m AS (
            SELECT doc_id, coalesce(list_sort(list_distinct(list(text) FILTER (label = 'email'))), []) AS mails, coalesce(list_sort(list_distinct(list(text) FILTER (label = 'ip_address'))), []) AS ips FROM spans0 WHERE label IN ('email', 'ip_address') GROUP BY doc_id
        ), kept AS (
            SELECT text, min(doc_id) AS doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY text
        ), rows AS (
            SELECT text, coalesce(mails, []) AS mails, coalesce(ips, []) AS ips FROM kept LEFT JOIN m USING (doc_id) WHERE text <> ''
        ), told AS (
            SELECT *, list_filter(mails, lambda x: {_TOKEN('x')}) AS said FROM rows
        ), lines AS (
            SELECT {_SPLIT("'text::' || sha256(text)")} AS split, '{{"input":' || CAST(to_json(text) AS VARCHAR) || ',"output":{{"entities":{{' || {" || ',' || ".join(f"'{chr(34)}{k}{chr(34)}:' || " + ({'email': 'CAST(to_json(mails) AS VARCHAR)', 'ip_address': 'CAST(to_json(ips) AS VARCHAR)'}.get(k, "'[]'")) for k in NAMES)} || '}},"sensitivity":["' || CASE WHEN len(said) > 0 THEN 'direct_pii' ELSE 'no_sensitive' END
                || '"],"structures":' || CAST(to_json(CASE WHEN len(said) > 0 THEN '[{{"email":"' || said[1] || '"}}]' ELSE '[]' END) AS VARCHAR) || ',"relations":[]}}}}' AS line FROM told
        )
        SELECT split, line, CAST(2 * count(*) AS BIGINT) AS n FROM lines GROUP BY split, line""",
}
