"""Labelled rows: parsing, validation, tasks, curation, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brakta.functions import parsing
from brakta.functions.text import token_match
from brakta.operators import curate, noise, pools, similarity, tasks, validate
from brakta.operators.taxonomy import LABELS
from brakta.queries.base import SPANS0, documents, raw_spans, table
from brakta.queries.detection import _values
from brakta.sources import io

NAMES = list(LABELS)
CELLS = [
    (1, '{"person": ["Anna", "Bo"], "email": "x@y.se", "phone": []}'),
    (2, "{'person': ['Anna'], 'bank': (1, 2)}"),
    (3, "[]"),
    (4, "broken {"),
    (5, None),
    (6, '{"person": [1, null, ""], "nope": ["x"]}'),
    (7, '[{"label": "person", "mentions": ["A"]}, {"label": "person", "mentions": ["B", ""]}, {"label": "odd", "mentions": ["C"]}]'),
]
ENTITY_ROWS = [
    (1, "Anna Ek, 19850315-2389, anna@x.se", {"person": ["Anna Ek"], "personnummer": ["19850315-2389"], "email": ["anna@x.se"]}, "Norrvik Bygg"),
    (2, "Anna och Bo har astma; Norrvik Bygg AB", {"person": ["Anna", "Bo"], "health": ["astma"]}, "Norrvik Bygg AB"),
    (3, "Annabella i Umeå", {"person": ["Anna"], "address": ["Umeå"]}, None),
    (4, "Bo dömd för stöld, muslim, 2024-05-20", {"person": ["Bo", "Bo"], "criminal": ["dömd för stöld"], "religion_ethnicity": ["muslim"], "date": ["2024-05-20"]}, None),
    (5, "inget här", {}, None),
    (6, "åAnna a|b", {"person": ["Anna"], "phone": ["a|b", "saknas"]}, "AB"),
    (7, "", {"person": ["x"]}, None),
]
ENTITY_SCHEMA = "row_id int, text string, entities map<string,array<string>>, company string"


def _sorted_map(m: Column) -> Column:
    """A map as text, whatever the order of its keys."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "/", "NULL")))), ";")


def _cells(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CELLS, "row_id int, cell string")


def _entities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTITY_ROWS, ENTITY_SCHEMA)


def parsed_mappings(spark: SparkSession, d: str) -> DataFrame:
    """Objects from JSON and from Python literals; all else is empty."""
    j = parsing.as_json(_cells(spark), "cell", "json")
    return j.select("row_id", F.array_join(F.array_sort(F.map_keys(parsing.mapping(F.col("json")))), ",").alias("keys"))


def coerced_entities(spark: SparkSession, d: str) -> DataFrame:
    j = parsing.as_json(_cells(spark), "cell", "json")
    return j.select("row_id", _sorted_map(parsing.entities(F.col("json"))).alias("entities"))


def sparse_entities(spark: SparkSession, d: str) -> DataFrame:
    """Known labels, no empty mentions, the last of a label given twice."""
    j = parsing.as_json(_cells(spark), "cell", "json")
    return j.select("row_id", _sorted_map(parsing.sparse_entities(F.col("json"), NAMES)).alias("entities"))


RECORD_CELLS = [(1, '[{"name": "A", "phone": null}, 5, {"name": "B"}]'), (2, '{"name": "C"}'), (3, "no"), (4, None), (5, "[{'name': 'D'}]")]


def parsed_records(spark: SparkSession, d: str) -> DataFrame:
    j = parsing.as_json(spark.createDataFrame(RECORD_CELLS, "row_id int, cell string"), "cell", "json")
    r = parsing.records(F.col("json"))
    return j.select("row_id", F.coalesce(F.array_join(F.transform(r, lambda x: F.concat_ws("/", x["name"], x["phone"])), ","), F.lit("")).alias("records"))


def event_properties(spark: SparkSession, d: str) -> DataFrame:
    """JSON cells of a large table."""
    e = table(spark, d, "events")
    return e.select("event_id", F.size(F.map_keys(parsing.mapping(F.col("props")))).cast("long").alias("n_keys"))


def validated_entities(spark: SparkSession, d: str) -> DataFrame:
    e = _entities(spark).withColumn("with_blank", F.map_concat("entities", F.create_map(F.lit("mrz"), F.array(F.lit(None).cast("string"), F.lit("")))))
    return e.select("row_id", validate.entities_valid(F.col("text"), F.col("with_blank")).alias("valid"), validate.entities_valid_lenient(F.col("text"), F.col("with_blank")).alias("lenient"))


def cleaned_entities(spark: SparkSession, d: str) -> DataFrame:
    return _entities(spark).select("row_id", _sorted_map(validate.clean_entities(F.col("text"), F.col("entities"), NAMES)).alias("entities"))


def flattened_entities(spark: SparkSession, d: str) -> DataFrame:
    return _entities(spark).filter("size(entities) = 1").select("row_id", F.to_json("entities").alias("entities"))


SEEDS = [{"name": "Anna", "personnummer": "1", "address": "Storgatan 1, 123 45 Umeå"}, {"name": "Bo", "email": "b@x.se"}, {"name": "Bo", "email": "c@x.se"}]
RECORD_ROWS = [
    (1, "Anna 1 storgatan 1", [{"name": "Anna", "personnummer": "1", "address": "storgatan  1"}], SEEDS),
    (2, "Anna 2", [{"name": "Anna", "personnummer": "2"}], SEEDS),
    (3, "Cia", [{"name": "Cia"}], SEEDS),
    (4, "", [], SEEDS),
    (5, "x", None, SEEDS),
    (6, "Bo c@x.se", [{"name": "Bo", "email": "c@x.se"}], SEEDS),
    (7, "Bo b@x.se", [{"name": "Bo", "email": "b@x.se"}], SEEDS),
    (8, "Anna", [{"name": "Anna", "personnummer": "1"}], SEEDS),
]


def validated_records(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(RECORD_ROWS, "row_id int, text string, records array<map<string,string>>, seed_subjects array<map<string,string>>")
    # An address in other case and spacing is not in the text as it stands, so row 1 fails there.
    return validate.records_valid(rows)


ADDRESSES = [(1, "Storgatan 1", "storgatan  1, Umeå"), (2, "", "x"), (3, "x", ""), (4, "Kyrkvägen 2, Lund", "kyrkvägen 2"), (5, "a", "b"), (6, None, None)]


def matched_addresses(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(ADDRESSES, "i int, rec string, seed string")
    return rows.select("i", validate.address_matches(F.col("rec"), F.col("seed")).alias("matches"))


def seed_values(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    leaves = parsing.leaves([F.array("c_name", "c_mktsegment"), F.array(F.lit("  "), F.lit(" x "))])
    return c.select("c_custkey", F.array_join(leaves, "|").alias("leaves"))


def test_cases(spark: SparkSession, d: str) -> DataFrame:
    """Customers as rows to judge: a name, an object, a list with a blank, and a list written as text; every seventh has no seeds."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    some = k % 7 != 0
    rows = c.select(
        "c_custkey", F.concat_ws(", ", "c_name", "c_mktsegment").alias("text"), F.create_map(F.lit("person"), F.array("c_name")).alias("entities"),
        F.when(some, F.col("c_name")).alias("seed_person"), F.when(some, F.struct(F.col("c_mktsegment").alias("name"), k.alias("no"))).alias("seed_company"),
        F.when(some, F.array(F.lit(" "), F.lit(" x "))).alias("seed_subjects"), F.when(some, F.concat(F.lit("['a', {'b': "), k.cast("string"), F.lit("}]"))).alias("seed_url"))
    return validate.test_cases(rows, "c_custkey").withColumn("context", F.array_join("context", "|"))


def token_matches(spark: SparkSession, d: str) -> DataFrame:
    """Whether a turn's third word, and the first two letters of it, stand in the turn as whole tokens."""
    rows = table(spark, d, "conversations").withColumn("m", F.split_part("text", F.lit(" "), F.lit(3)))
    return rows.select("conv_id", "turn", token_match(F.col("m"), F.col("text")).alias("matched"), token_match(F.substring("m", 1, 2), F.col("text")).alias("part_matched"))


def sensitivity_classes(spark: SparkSession, d: str) -> DataFrame:
    return _entities(spark).select("row_id", F.array_join(tasks.sensitivity(F.col("entities"), F.col("text")), ",").alias("classes"))


def person_records(spark: SparkSession, d: str) -> DataFrame:
    r = tasks.person_record(F.col("entities"), F.col("text"), F.col("company"))
    return _entities(spark).withColumn("r", r).select("row_id", F.col("r.name").alias("name"), F.col("r.personnummer").alias("personnummer"), F.col("r.phone").alias("phone"), F.array_join("r.address", "/").alias("address"), F.col("r.employer").alias("employer"))


def ownership(spark: SparkSession, d: str) -> DataFrame:
    e = _entities(spark).select("row_id", F.inline(tasks.belongs_to(F.col("entities"), F.col("text"))))
    return e.select("row_id", "span", "label", "owner")


def tasks_from_records(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "Anna 1, Bo b@x.se", [{"name": "Anna", "personnummer": "1"}, {"name": "Bo", "email": "b@x.se", "phone": "no"}, {"name": "Cia", "phone": "1"}])], "row_id int, text string, records array<map<string,string>>")
    structures, edges = tasks.tasks_of_records(F.col("records"), F.col("text"))
    return rows.select("row_id", F.size(structures).alias("n_structures"), F.array_join(F.transform(edges, lambda e: F.concat_ws(":", e["span"], e["label"], e["owner"])), ",").alias("edges"))


def dense_entities(spark: SparkSession, d: str) -> DataFrame:
    dense = tasks.dense(F.col("entities"))
    return _entities(spark).select("row_id", F.size(dense).alias("n_labels"), F.size(F.map_filter(dense, lambda k, v: F.size(v) > 0)).alias("n_present"))


def _examples(spark: SparkSession) -> DataFrame:
    none = F.array().cast("array<map<string,string>>")
    e = tasks.example(F.col("text"), F.col("entities"), F.col("company"), none, F.lit(True))
    return _entities(spark).withColumn("e", e).filter("e is not null").select("row_id", "e.*")


def training_examples(spark: SparkSession, d: str) -> DataFrame:
    return _examples(spark).select("row_id", F.array_join("sensitivity", ",").alias("classes"), (F.col("structures") != "[]").alias("has_structure"), F.size("relations").alias("n_relations"))


def task_coverage(spark: SparkSession, d: str) -> DataFrame:
    return curate.coverage(_examples(spark))


def deduped_documents(spark: SparkSession, d: str) -> DataFrame:
    return curate.exact_dedup(documents(spark, d), "text", "doc_id").select("doc_id")


def valid_documents(spark: SparkSession, d: str) -> DataFrame:
    """Rows validated as true: here those labelled as good; unlabelled ones are not."""
    said = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("entities_validated"))
    return curate.valid_only(documents(spark, d).join(said, "doc_id", "left")).select("doc_id")


def _document_entities(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text, entities): what the patterns find, sorted, by label; in every third document in capitals, and a label with a null list."""
    found = raw_spans(spark, d).groupBy("doc_id", "label").agg(F.array_sort(F.collect_set(F.when(F.col("doc_id") % 3 == 0, F.upper("text")).otherwise(F.col("text")))).alias("ms"))
    maps = found.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "ms"))).alias("m"))
    none = F.create_map(F.lit("mrz"), F.lit(None).cast("array<string>"))
    return documents(spark, d).join(maps, "doc_id").withColumn("entities", F.map_concat("m", none)).drop("m")


def validated_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whether what is said of a document stands in it, and what is left of it."""
    e = _document_entities(spark, d)
    kept = validate.clean_entities(F.col("text"), F.col("entities"), NAMES)
    return e.select("doc_id", validate.entities_valid(F.col("text"), F.col("entities")).alias("valid"), validate.entities_valid_lenient(F.col("text"), F.col("entities")).alias("lenient"), _sorted_map(kept).alias("kept"))


def document_cells(spark: SparkSession, d: str) -> DataFrame:
    """Entities of documents, written as JSON cells and parsed again."""
    e = _document_entities(spark, d).withColumn("cell", F.to_json(F.map_filter("entities", lambda k, v: v.isNotNull())))
    return e.select("doc_id", _sorted_map(parsing.sparse_entities(F.col("cell"), NAMES)).alias("entities"))


def document_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Classes and the dense form of every document's entities."""
    e = _document_entities(spark, d).withColumn("clean", validate.clean_entities(F.col("text"), F.col("entities"), NAMES))
    dense = tasks.dense(F.col("clean"))
    return e.select("doc_id", F.array_join(tasks.sensitivity(F.col("clean"), F.col("text")), ",").alias("classes"), F.size(F.map_filter(dense, lambda k, v: F.size(v) > 0)).alias("n_present"))


def customer_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of customers against seeds: every fourth says another phone, every sixth what its text does not hold; every ninth has no seeds."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").withColumn("c_phone", F.concat(F.lit("+46 "), k.cast("string")))
    record = F.create_map(F.lit("name"), F.col("c_name"), F.lit("phone"), F.when(k % 4 == 0, F.lit("0")).otherwise(F.col("c_phone")))
    seeds = F.when(k % 9 != 0, F.array(F.create_map(F.lit("name"), F.col("c_name"), F.lit("phone"), F.col("c_phone"))))
    rows = c.select(k.alias("row_id"), F.concat_ws(" ", F.col("c_name"), F.when(k % 6 != 0, F.col("c_phone"))).alias("text"), F.array(record).alias("records"), seeds.alias("seed_subjects"))
    return validate.records_valid(rows)


def document_splits(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share a detected mention of a kind share a key, and so a split."""
    m = raw_spans(spark, d).filter("label in ('email', 'card_number')").groupBy("doc_id").agg(F.collect_set("text").alias("mentions"))
    rows = documents(spark, d).join(m, "doc_id", "left")
    key = curate.group_key(F.col("text"), F.coalesce("mentions", F.array().cast("array<string>")))
    return rows.select("doc_id", key.alias("group_key"), curate.split_of(key).alias("split"))


def split_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of a dataset card."""
    return document_splits(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("group_key").alias("n_groups"))


def cleaned_splits(spark: SparkSession, d: str) -> DataFrame:
    """Records: one that says what the entities say, one not validated, one that the text does not hold."""
    r = spark.createDataFrame([(1, [{"name": "Anna Ek", "personnummer": "19850315-2389"}], True), (3, [{"name": "Annabella"}], False), (5, [{"name": "Cia", "personnummer": "1"}], True)], "row_id int, records array<map<string,string>>, records_validated boolean")
    rows = curate.with_split(_entities(spark).filter("text <> ''").join(r, "row_id", "left"), NAMES)
    return rows.select("row_id", "group_key", "split")


def random_split_sizes(spark: SparkSession, d: str) -> DataFrame:
    parts = curate.random_split(documents(spark, d), 0.9, 0.05, 42)
    out = None
    for name, p in zip(("train", "val", "test"), parts, strict=True):
        row = p.agg(F.lit(name).alias("split"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("u", similarity.normalised(F.col("embedding")))
    return e.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"), F.round(F.col("u")[0], 6).alias("first"))


def similar_vector_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity.close_pairs(table(spark, d, "embeddings"), 0.3, "vec_id", "embedding")


def semantic_keep_mask(spark: SparkSession, d: str) -> DataFrame:
    return curate.dedup_texts(table(spark, d, "embeddings"), 0.3)


def _copied(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings, each with three copies drifting away from it, the last one below the usual threshold."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("of"), "embedding").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(3))))
    drift = F.transform("embedding", lambda x, i: x.cast("double") * (1 + F.col("copy") * 0.04 * (F.pmod(i * 7 + F.col("of") * 3, F.lit(11)) - 5)))
    return e.select((F.col("of") * 4 + F.col("copy")).alias("vec_id"), drift.alias("embedding"))


def near_copies(spark: SparkSession, d: str) -> DataFrame:
    return similarity.close_pairs(_copied(spark, d), 0.95, "vec_id", "embedding")


def kept_of_near_copies(spark: SparkSession, d: str) -> DataFrame:
    return curate.dedup_texts(_copied(spark, d))


def pinned_pools(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(k, list(v)) for k, v in pools.PINNED.items()], "pool string, entries array<string>")
    return rows.select("pool", curate.pool_hash(F.col("entries")).alias("sha"))


def gold_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Gold mentions from lines of training examples."""
    e = raw_spans(spark, d).groupBy("doc_id", "label").agg(F.collect_list("text").alias("ms")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "ms"))).alias("entities"))
    lines = io.example_lines(documents(spark, d).join(e, "doc_id").select(F.lit("test").alias("split"), "text", "entities"))
    return io.gold_from_lines(lines.select("value"))


def example_json(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").filter("quality is not null and toxic is not null").join(documents(spark, d), "doc_id").select(F.lit("train").alias("split"), "text", "quality", "toxic")
    return io.example_lines(rows)


def first_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of a folder or file, in file order; a limit is what this reader is for."""
    return io.load_rows(spark, f"{d}/nation.parquet", 10)


def export_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.concat(F.col("url"), F.lit("/a:b*c.tar.png")).alias("f"), F.concat(F.lit("Scan "), F.col("page_id").cast("string"), F.lit(".PDF")).alias("pdf"))
    return p.select("page_id", io.archive_entry(F.col("page_id") % 100, F.col("f")).alias("entry"), io.redacted_name(F.col("f")).alias("text_name"), io.pdf_page_name(F.col("pdf"), F.lit(3)).alias("pdf_page"), io.is_pdf(F.col("pdf"), F.lit(None).cast("string")).alias("is_pdf"))


def appended_pages(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", "url")
    return p.filter("page_id % 2 = 0").unionByName(p.filter("page_id % 2 = 1 and url is not null"))


def line_structure(spark: SparkSession, d: str) -> DataFrame:
    rows = documents(spark, d).select("doc_id", F.posexplode(noise.line_flags(F.col("text"))).alias("pos", "f"))
    return rows.select("doc_id", "pos", F.col("f.structured").alias("structured"), F.col("f.length").alias("length"))


def _noisy(spark: SparkSession, d: str) -> DataFrame:
    m = raw_spans(spark, d).groupBy("doc_id", "label").agg(F.collect_list("text").alias("ms")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "ms"))).alias("entities"))
    rows = documents(spark, d).join(m, "doc_id").withColumn("split", curate.split_of(F.col("doc_id").cast("string")))
    return noise.with_noisy_copies(rows, "doc_id", 0.12)


def noisy_examples(spark: SparkSession, d: str) -> DataFrame:
    return _noisy(spark, d).select("doc_id", "noisy", "split", "text")


def noise_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Mentions that a noised text does not hold, and noised rows in another split than their clean one: none."""
    n = _noisy(spark, d)
    lost = n.select(F.size(F.filter(F.flatten(F.map_values("entities")), lambda m: ~F.col("text").contains(m))).alias("lost")).agg(F.coalesce(F.sum("lost"), F.lit(0)).alias("lost_mentions"))
    moved = n.groupBy("doc_id").agg(F.countDistinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("moved_rows"))
    return lost.withColumn("one", F.lit(1)).join(moved.withColumn("one", F.lit(1)), "one").drop("one")


QUERIES = {f.__name__: f for f in (parsed_mappings, coerced_entities, sparse_entities, parsed_records, event_properties, validated_entities, cleaned_entities, flattened_entities, validated_records, matched_addresses, seed_values, test_cases, token_matches, sensitivity_classes, person_records, ownership, tasks_from_records, dense_entities, training_examples, task_coverage, deduped_documents, valid_documents, validated_documents, document_cells, document_sensitivity, customer_records, document_splits, split_sizes, cleaned_splits, random_split_sizes, unit_vectors, similar_vector_pairs, semantic_keep_mask, near_copies, kept_of_near_copies, pinned_pools, gold_mentions, example_json, first_rows, export_names, appended_pages, line_structure, noisy_examples, noise_invariants)}

_SPLIT = lambda key: f"CASE WHEN CAST(('0x' || sha256('42:' || {key})[1:16])::UBIGINT AS DOUBLE) / 18446744073709551616.0 < 0.9 THEN 'train' WHEN CAST(('0x' || sha256('42:' || {key})[1:16])::UBIGINT AS DOUBLE) / 18446744073709551616.0 < 0.9 + 0.05 THEN 'val' ELSE 'test' END"
_KEYS = f"WITH {SPANS0}, m AS (SELECT doc_id, string_agg(DISTINCT text, '|' ORDER BY text) AS ids FROM spans0 WHERE label IN ('email', 'card_number') GROUP BY doc_id), k AS (SELECT doc_id, CASE WHEN ids IS NOT NULL THEN 'ids::' || ids ELSE 'text::' || sha256(text) END AS group_key FROM documents LEFT JOIN m USING (doc_id)), s AS (SELECT doc_id, group_key, {_SPLIT('group_key')} AS split FROM k)"
_CLASS = "'\\p{L}\\p{M}\\p{N}\\p{Pc}'"
_FOUND = f"{SPANS0}, found AS (SELECT DISTINCT doc_id, d.text, label, CASE WHEN doc_id % 3 = 0 THEN upper(s.text) ELSE s.text END AS m FROM spans0 s JOIN documents d USING (doc_id))"
_WORD = "[\\p{L}\\p{M}\\p{N}\\p{Pc}]"
# An occurrence counts if neither neighbour is a word character: every suffix that starts with the mention is tried.
_TOKEN = lambda m: f"({m} <> '' AND len(list_filter(range(1, length(text) - length({m}) + 2), lambda i: text[i:i + length({m}) - 1] = {m} AND (i = 1 OR NOT regexp_matches(text[i - 1], '{_WORD}')) AND (i + length({m}) > length(text) OR NOT regexp_matches(text[i + length({m})], '{_WORD}')))) > 0)"
_quoted = lambda text: "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
_E = lambda rows: _values(rows, "row_id, v")

_COPIED = "copied AS MATERIALIZED (SELECT e.vec_id * 4 + c AS vec_id, list_transform(e.embedding, lambda x, i: CAST(x AS DOUBLE) * (1 + c * 0.04::DOUBLE * (((i - 1) * 7 + e.vec_id * 3) % 11 - 5))) AS embedding FROM embeddings e CROSS JOIN range(0, 4) t(c))"
_PAIRS = lambda rows, least: f"SELECT a.vec_id AS a, b.vec_id AS b FROM {rows} a JOIN {rows} b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {least}"
# In id order: a row is kept unless an earlier kept row is close to it.
_KEPT = lambda rows, least, first="": f"WITH RECURSIVE {first}p AS MATERIALIZED ({_PAIRS(rows, least)}), n AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS k, coalesce(before, []) AS before FROM {rows} LEFT JOIN (SELECT b, list(a) AS before FROM p GROUP BY b) ON b = vec_id), g AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept UNION ALL SELECT n.k, CASE WHEN list_has_any(g.kept, n.before) THEN g.kept ELSE list_append(g.kept, n.vec_id) END FROM g JOIN n ON n.k = g.k + 1) SELECT vec_id, list_contains((SELECT kept FROM g ORDER BY k DESC LIMIT 1), vec_id) AS keep FROM {rows}"

SQL = {
    "parsed_mappings": "SELECT row_id, v AS keys FROM " + _E([(1, "email,person,phone"), (2, "bank,person"), (3, ""), (4, ""), (5, ""), (6, "nope,person"), (7, "")]),
    "coerced_entities": "SELECT row_id, v AS entities FROM " + _E([(1, "person=Anna/Bo;phone="), (2, "bank=1/2;person=Anna"), (3, ""), (4, ""), (5, ""), (6, "nope=x;person=1/NULL/"), (7, "")]),
    "sparse_entities": "SELECT row_id, v AS entities FROM " + _E([(1, "person=Anna/Bo"), (2, "bank=1/2;person=Anna"), (3, ""), (4, ""), (5, ""), (6, "person=1"), (7, "person=B")]),
    "parsed_records": "SELECT row_id, v AS records FROM " + _E([(1, "A,B"), (2, "C"), (3, ""), (4, ""), (5, "D")]),
    "event_properties": "SELECT event_id, CASE WHEN json_type(props) = 'OBJECT' THEN len(json_keys(props)) ELSE 0 END::BIGINT AS n_keys FROM events",
    "validated_entities": "SELECT row_id, v = 'true' AS valid, v = 'true' AS lenient FROM " + _E([(1, "true"), (2, "true"), (3, "true"), (4, "true"), (5, "true"), (6, "false"), (7, "false")]),
    "cleaned_entities": "SELECT row_id, v AS entities FROM " + _E([(1, "email=anna@x.se;person=Anna Ek;personnummer=19850315-2389"), (2, "health=astma;person=Anna/Bo"), (3, "address=Umeå;person=Anna"), (4, "criminal=dömd för stöld;date=2024-05-20;person=Bo/Bo;religion_ethnicity=muslim"), (5, ""), (6, "person=Anna;phone=a|b"), (7, "")]),
    "flattened_entities": "SELECT row_id, v AS entities FROM " + _E([(7, '{"person":["x"]}')]),
    "validated_records": "SELECT row_id, v = 'true' AS valid FROM " + _E([(1, "false"), (2, "false"), (3, "false"), (4, "true"), (5, "false"), (6, "true"), (7, "false"), (8, "false")]),
    "matched_addresses": "SELECT row_id AS i, v = 'true' AS matches FROM " + _E([(1, "true"), (2, "true"), (3, "false"), (4, "true"), (5, "false"), (6, "true")]),
    "seed_values": "SELECT c_custkey, c_name || '|' || c_mktsegment || '|x' AS leaves FROM customer",
    "test_cases": f"SELECT c_custkey, {_quoted(validate.TASK)} || CASE WHEN len(v) = 0 THEN '(no seed values)' ELSE array_to_string(list_transform(v, lambda x: '- ' || x), chr(10)) END AS input, c_name || ', ' || c_mktsegment AS actual_output, '{{\"person\":[\"' || c_name || '\"]}}' AS expected_output, array_to_string(v, '|') AS context FROM (SELECT *, CASE WHEN c_custkey % 7 = 0 THEN []::VARCHAR[] ELSE [c_name, c_mktsegment, CAST(c_custkey AS VARCHAR), 'a', CAST(c_custkey AS VARCHAR), 'x'] END AS v FROM customer)",
    "token_matches": f"SELECT conv_id, turn, {_TOKEN('m')} AS matched, {_TOKEN('m[1:2]')} AS part_matched FROM (SELECT *, split_part(text, ' ', 3) AS m FROM conversations)",
    "sensitivity_classes": "SELECT row_id, v AS classes FROM " + _E([(1, "direct_pii"), (2, "direct_pii,art9_health"), (3, "direct_pii"), (4, "direct_pii,art9_religion_ethnicity,art10_criminal"), (5, "no_sensitive"), (6, "direct_pii"), (7, "no_sensitive")]),
    "person_records": "SELECT * FROM " + _values([(1, "Anna Ek", "19850315-2389", None, None, None), (2, None, None, None, None, None), (3, None, None, None, "Umeå", None), (4, "Bo", None, None, None, None), (5, None, None, None, None, None), (6, None, None, "a|b", None, None), (7, None, None, None, None, None)], "row_id, name, personnummer, phone, address, employer"),
    "ownership": "SELECT * FROM " + _values([(1, "19850315-2389", "personnummer", "Anna Ek"), (1, "anna@x.se", "email", "Anna Ek")], "row_id, span, label, owner"),
    "tasks_from_records": "SELECT * FROM " + _values([(1, 2, "1:personnummer:Anna,b@x.se:email:Bo")], "row_id, n_structures, edges"),
    "dense_entities": "SELECT * FROM " + _values([(1, 22, 3), (2, 22, 2), (3, 22, 2), (4, 22, 4), (5, 22, 0), (6, 22, 2), (7, 22, 1)], "row_id, n_labels, n_present"),
    "training_examples": "SELECT row_id, classes, has_structure, n_relations FROM " + _values([(1, "direct_pii", True, 2), (2, "direct_pii,art9_health", False, 0), (3, "direct_pii", True, 0), (4, "direct_pii,art9_religion_ethnicity,art10_criminal", True, 0), (5, "no_sensitive", False, 0), (6, "direct_pii", True, 0)], "row_id, classes, has_structure, n_relations"),
    "task_coverage": "SELECT 5::BIGINT AS entities, 6::BIGINT AS classification, 4::BIGINT AS structures, 1::BIGINT AS relations, 6::BIGINT AS rows",
    "deduped_documents": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "valid_documents": "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1",
    "validated_documents": f"WITH {_FOUND} SELECT doc_id, bool_and(ok) AS valid, bool_and(ok) AS lenient, coalesce(string_agg(label || '=' || kept, ';' ORDER BY label) FILTER (kept IS NOT NULL), '') AS kept FROM (SELECT doc_id, label, bool_and(contains(text, m)) AS ok, string_agg(m, '/' ORDER BY m) FILTER (contains(text, m)) AS kept FROM found GROUP BY ALL) GROUP BY doc_id",
    "document_cells": f"WITH {_FOUND} SELECT doc_id, string_agg(label || '=' || ms, ';' ORDER BY label) AS entities FROM (SELECT doc_id, label, string_agg(m, '/' ORDER BY m) AS ms FROM found GROUP BY ALL) GROUP BY doc_id",
    "document_sensitivity": f"WITH {_FOUND} SELECT doc_id, CASE WHEN count(*) FILTER (contains(text, m) AND label <> 'ip_address' AND regexp_matches(text, '(?:^|[^' || {_CLASS} || '])' || regexp_escape(m) || '(?:$|[^' || {_CLASS} || '])')) > 0 THEN 'direct_pii' ELSE 'no_sensitive' END AS classes, CAST(count(DISTINCT label) FILTER (contains(text, m)) AS INTEGER) AS n_present FROM found GROUP BY doc_id",
    "customer_records": "SELECT c_custkey AS row_id, c_custkey % 9 <> 0 AND c_custkey % 4 <> 0 AND c_custkey % 6 <> 0 AS valid FROM customer",
    "document_splits": f"{_KEYS} SELECT doc_id, group_key, split FROM s",
    "split_sizes": f"{_KEYS} SELECT split, count(*) AS n, count(DISTINCT group_key) AS n_groups FROM s GROUP BY split",
    "cleaned_splits": f"SELECT row_id, k AS group_key, {_SPLIT('k')} AS split FROM (SELECT row_id, CASE WHEN v LIKE 'ids::%' THEN v ELSE 'text::' || sha256(v) END AS k FROM {_E([(1, 'ids::19850315-2389|Anna Ek'), (2, 'ids::Anna|Bo'), (3, 'ids::Anna'), (4, 'ids::Bo'), (5, 'inget här'), (6, 'ids::Anna')])})",
    "unit_vectors": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / n) * (x::DOUBLE / n))), 6) AS norm, round(embedding[1]::DOUBLE / n, 6) AS first FROM (SELECT *, greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-12) AS n FROM embeddings)",
    "similar_vector_pairs": _PAIRS("embeddings", 0.3),
    "near_copies": f"WITH {_COPIED} " + _PAIRS("copied", 0.95),
    "semantic_keep_mask": _KEPT("embeddings", 0.3),
    "kept_of_near_copies": _KEPT("copied", 0.95, _COPIED + ", "),
    "pinned_pools": "SELECT pool, sha256('[\"' || v || '\"]')[1:16] AS sha FROM " + _values([(k, '", "'.join(v)) for k, v in pools.PINNED.items()], "pool, v"),
    "gold_mentions": f"WITH {SPANS0} SELECT DISTINCT d.text, label, lower(s.text) AS mention FROM spans0 s JOIN documents d USING (doc_id)",
    "example_json": "SELECT 'train' AS split, '{\"input\":' || CAST(to_json(text) AS VARCHAR) || ',\"output\":{\"quality\":' || quality || ',\"toxic\":' || toxic || '}}' AS value FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL",
    "first_rows": "SELECT n_nationkey, n_name, n_regionkey FROM nation ORDER BY n_nationkey LIMIT 10",
    "export_names": r"""SELECT page_id, lpad(CAST(page_id % 100 AS VARCHAR), 2, '0') || '_' || regexp_replace(regexp_replace(f, '\.[^.]*$', ''), '[/\\:*?"<>|]+', '_', 'g') || '-redacted.png' AS entry, regexp_replace(f, '\.[^.]*$', '') || '-redacted.txt' AS text_name, 'Scan ' || page_id || '-p3.png' AS pdf_page, true AS is_pdf FROM (SELECT page_id, url || '/a:b*c.tar.png' AS f FROM pages)""",
    "appended_pages": "SELECT page_id, url FROM pages WHERE page_id % 2 = 0 OR url IS NOT NULL",
    "line_structure": "SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, contains(ps[i], '|') OR contains(ps[i], '  ') AS structured, CAST(length(ps[i]) AS INTEGER) AS length FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents))",
    "noisy_examples": f"WITH {SPANS0}, spoken AS (SELECT doc_id, text, {_SPLIT('doc_id')} AS split FROM documents WHERE doc_id IN (SELECT doc_id FROM spans0)) SELECT doc_id, false AS noisy, split, text FROM spoken UNION ALL SELECT doc_id, true, split, n.text FROM spoken JOIN (" + noise.noisy_sql("spoken", "doc_id", 0.12) + ") n USING (doc_id)",
    "noise_invariants": "SELECT 0::BIGINT AS lost_mentions, 0::BIGINT AS moved_rows",
}
