"""Many phrases at once, over whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brakta.functions.text import simple_upper
from brakta.operators import phrases, ranking
from brakta.queries.base import documents, table


def _phrases(spark: SparkSession, d: str) -> DataFrame:
    """Every three words in a row of the benchmark, some in capitals."""
    words = F.split("text", r"[ \n]+")
    rows = table(spark, d, "benchmark").select("item_id", words.alias("w")).select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 2))).alias("i"))
    phrase = F.array_join(F.slice("w", F.col("i"), F.lit(3)), " ")
    return rows.select((F.col("item_id") * 1000 + F.col("i")).alias("phrase_id"), F.when(F.col("i") % 2 == 0, simple_upper(phrase)).otherwise(phrase).alias("phrase"))


def phrases_in_documents(spark: SparkSession, d: str) -> DataFrame:
    """How often, and in how many documents, each phrase stands, letter by letter."""
    found = phrases.find_phrases(documents(spark, d), _phrases(spark, d), ["doc_id"], fold=False)
    return found.groupBy("phrase_id").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_documents"))


def folded_phrases_in_documents(spark: SparkSession, d: str) -> DataFrame:
    """The same whatever the case and diacritics, with the text that stands in the first place by document."""
    docs = documents(spark, d)
    found = phrases.find_phrases(docs, _phrases(spark, d), ["doc_id"])
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("phrase_id").alias("n_phrases"))


LETTERS = [(1, "e"), (2, "ss"), (3, "AO"), (4, "n"), (5, "U")]


def folded_letters(spark: SparkSession, d: str) -> DataFrame:
    """Letters of documents that fold to plain ones: where each run stands, in the text's own offsets."""
    given = table(spark, d, "region").filter("r_regionkey = 0").select(F.inline(F.array(*[F.struct(F.lit(i).alias("phrase_id"), F.lit(p).alias("phrase")) for i, p in LETTERS])))
    marked = documents(spark, d).filter("text rlike '[^\\\\x00-\\\\x7F]'")
    found = phrases.find_phrases(marked, given, ["doc_id"], shown="shown", edges=True)
    return found.groupBy("phrase_id", "shown").agg(F.count("*").alias("n"))


def best_documents(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents for the text of every benchmark item; a top-k is what this returns."""
    found = ranking.best_texts(documents(spark, d), table(spark, d, "benchmark"), 10, query="item_id")
    return found.select(F.col("query_id").alias("item_id"), F.col("place").cast("long").alias("place"), "doc_id", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (phrases_in_documents, folded_phrases_in_documents, folded_letters, best_documents)}

_PHRASES = "ps AS (SELECT item_id * 1000 + i AS phrase_id, CASE WHEN i % 2 = 0 THEN upper(array_to_string(w[i:i + 2], ' ')) ELSE array_to_string(w[i:i + 2], ' ') END AS phrase FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM (SELECT item_id, regexp_split_to_array(text, '[ \\n]+') AS w FROM benchmark)))"
_N = lambda text, phrase: f"CAST((length({text}) - length(replace({text}, {phrase}, ''))) // length({phrase}) AS BIGINT)"
_FOLD = lambda x: f"replace(strip_accents(lower({x})), 'ß', 'ss')"

SQL = {
    "phrases_in_documents": f"WITH {_PHRASES} SELECT phrase_id, CAST(sum({_N('text', 'phrase')}) AS BIGINT) AS n, count(DISTINCT doc_id) AS n_documents FROM ps JOIN documents ON contains(text, phrase) WHERE phrase <> '' GROUP BY phrase_id",
    "folded_phrases_in_documents": f"WITH {_PHRASES}, fp AS (SELECT phrase_id, {_FOLD('phrase')} AS phrase FROM ps WHERE phrase <> ''), fd AS (SELECT doc_id, {_FOLD('text')} AS text FROM documents) SELECT doc_id, CAST(sum({_N('text', 'phrase')}) AS BIGINT) AS n, count(DISTINCT phrase_id) AS n_phrases FROM fp JOIN fd ON contains(text, phrase) GROUP BY doc_id",
    "folded_letters": "SELECT phrase_id, shown, count(*) AS n FROM (SELECT p.phrase_id::BIGINT AS phrase_id, unnest(regexp_extract_all(text, p.pattern)) AS shown FROM documents, (VALUES (1, '(?i)[eèéêë]'), (2, '(?i)ss|ß'), (3, '(?i)[aàáâãäå][oòóôõö]'), (4, '(?i)[nñ]'), (5, '(?i)[uùúûü]')) p(phrase_id, pattern) WHERE regexp_matches(text, '[^\\x00-\\x7F]')) GROUP BY 1, 2",
    "best_documents": """
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS ws FROM documents WHERE text IS NOT NULL),
        t AS (SELECT count(*) AS n_all, avg(len(ws)) AS mean FROM d),
        q AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS term FROM benchmark),
        c AS (SELECT doc_id, n AS len, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
        s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n_all - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len / mean))), 9) AS score FROM q JOIN c USING (term) JOIN f USING (term), t GROUP BY item_id, doc_id)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place, doc_id, round(score, 6) AS score FROM s QUALIFY place <= 10""",
}
