"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brakta.llm import clustering, embed_dedup, langid, mixing, ngram_join, packing, quality, spelling, suffix_dedup, token_count, topk, toxicity, warc
from brakta.llm.common import id_crc, read


def tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer())


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.pmod(id_crc(), F.lit(5)) == 0
    return langid.identify(docs, langid.learn(docs.filter(~held_out)), held_out)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read(spark, sf_dir, "documents"), tokenizer())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.pmod(id_crc(), F.lit(4)) == 2
    machine = toxicity.fit(docs.select("doc_id", "text"), read(spark, sf_dir, "labels").filter(~held_out))
    return toxicity.score(docs, machine, held_out)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.pmod(id_crc(), F.lit(4)) == 2
    voters = quality.fit(docs.select("doc_id", "text"), read(spark, sf_dir, "labels").filter(~held_out))
    return quality.score(docs, voters, held_out)


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.filter(F.pmod(F.col("vec_id"), F.lit(50)) == 0), vectors)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(read(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_suffix_array_dedup, op3_language_id, op4_mixing, op5_token_counts, op6_toxicity, op7_ngram_join, op8_embedding_near_dedup, op9_quality, op10_exact_top_k,
        op11_spelling_variants, op12_warc, op13_centroid_clustering,
    )
}

#: Top-k search and clusters of integers, archives read back and cosines are exact in SQL; the others need a tokenizer, a model
#: or hash functions that SQL lacks, or would take too long over whole tables.
SQL = {
    "op12_warc": warc.SQL,
    "op13_centroid_clustering": clustering.sql(),
    "op10_exact_top_k": """
        WITH usable AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS score
            FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
            WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 5
    """,
    "op8_embedding_near_dedup": """
        WITH RECURSIVE usable AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), pairs AS (
            SELECT a.vec_id AS a, b.vec_id AS b
            FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= 0.93
        ), reach(node, other) AS (
            SELECT vec_id, vec_id FROM embeddings
            UNION SELECT r.node, p.b FROM reach r JOIN pairs p ON p.a = r.other
        ), roots AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
        counts AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
        SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
        FROM embeddings e JOIN roots ON node = e.vec_id LEFT JOIN counts ON a = e.vec_id
    """,
}
