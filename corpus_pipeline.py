"""From documents to training sequences: five stages, each on all that the one before kept.

Each stage is (name, function of (spark, docs, sf_dir)); its rows are written as
Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brakta.llm import mixing, ngram_join, packing, suffix_dedup, toxicity
from brakta.llm.common import id_crc, read
from brakta.llm.registry import tokenizer
from brakta.plans.staging import stage, stage_alone, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ROW = "__row"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs``, staged, with a key of each row: an id may be null, or stand for several texts."""
    return stage(docs.select(*COLUMNS).withColumn(ROW, F.monotonically_increasing_id()), "pipeline-rows")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the factorization machine rejects go."""
    learned_from = read(spark, sf_dir, "labels").filter(F.pmod(id_crc(), F.lit(4)) != 2)
    machine = toxicity.fit(docs.select("doc_id", "text"), learned_from)
    return toxicity.reject(docs.select(*COLUMNS), machine)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of rows linked by shared five-word runs, the one with the smallest id stays (a null id comes last); of repeated rows with an id, one."""
    rows = numbered(docs)
    found = ngram_join.near_duplicates(rows.select(ROW, "text"), key=ROW).withColumnRenamed("doc_id", ROW)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", ROW)
    stays = found.join(rows.select(ROW, "doc_id"), ROW).groupBy("class_id").agg(F.min(order)[ROW].alias(ROW)).select(ROW)
    # Texts without a word are in no class; they are told by id and text, without an id by row.
    left = rows.join(stays, ROW, "left_semi").withColumn(ROW, F.when(F.col("doc_id").isNull(), F.col(ROW)))
    return left.dropDuplicates(["doc_id", "text", ROW]).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: strings of 100 bytes that start earlier in the corpus are cut out."""
    return suffix_dedup.remove_repeats(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: every row as often as the mix takes it, whatever its id."""
    rows = numbered(docs)
    taken = mixing.mix(rows.select(ROW, "doc_id", "text", "source"), row=ROW).filter("copies > 0").select(ROW, "copies")
    return rows.join(taken, ROW).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the pieces of all documents in sequences of 4096 tokens."""
    return packing.pack_documents(docs, tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The first stage is a learned model, the last a tokenizer; SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each returns is written to the shared folder and read again, and the tables it made on the way are deleted."""
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        mark = staged()
        docs = stage_alone(function(spark, docs, sf_dir), f"pipeline-{name}", mark)
    return STAGES[-1][1](spark, docs, sf_dir)
