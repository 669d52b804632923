"""BM25 for many queries at once: postings with block maxima, read only where a block can still matter.

Texts are dealt into blocks.  For each term of the queries the postings hold, text by
text, what the term adds to its score, and for each block the most it adds there.
The sum of a query's maxima bounds every score in a block.  The blocks with the
highest bounds are scored first, which gives each query a k-th best score; blocks
whose bound is below it hold none of the k best and are not scored at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brakta.plans.staging import stage, unstage

#: Texts in a block, about, and the blocks of each query that are scored first.
BLOCK, FIRST = 64, 4


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def postings(texts: DataFrame, queries: DataFrame, key: str, text: str, k1: float, b: float, block: int) -> DataFrame:
    """(term, block, key, impact) of the queries' terms: what each adds to a text's score.

    Words are counted within a text before anything is dealt, and only the queries' terms go on.  The number of
    texts and their mean length are one row; a term's number of texts is joined by term, aggregated first.
    """
    rows = texts.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), words_of(F.col(text)).alias("ws"))
    sized = rows.select("key", "ws", F.size("ws").alias("len"))
    totals = sized.agg(F.count("*").alias("n_all"), F.avg("len").alias("mean")).first()
    n_all, mean = totals["n_all"], totals["mean"] or 1.0
    asked = queries.select(F.explode("terms").alias("term")).distinct()
    counted = sized.select("key", "len", F.explode("ws").alias("term")).join(asked, "term", "left_semi").groupBy("key", "len", "term").agg(F.count("*").alias("tf"))
    df = counted.groupBy("term").agg(F.count("*").alias("df"))
    tf, n = F.col("tf"), F.col("df")
    idf = F.log(1 + (F.lit(n_all) - n + 0.5) / (n + 0.5))
    impact = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / mean))
    blocks = max(1, -(-n_all // block))
    return counted.join(df, "term").select("term", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), "key", impact.alias("impact"))


def best_texts(texts: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", query: str = "query_id", wanted: str = "text", k1: float = 1.2, b: float = 0.75, block: int = BLOCK, first: int = FIRST) -> DataFrame:
    """(query_id, place, key, score): the k best texts of each query, by score and then key; texts without a word of the query are not among them.

    A word counts once in a query; null or blank queries have no answer.  Runs: postings and bounds are staged,
    the first blocks scored, and then those whose bound reaches the k-th score found (with room for rounding).
    """
    asked = stage(queries.filter(F.col(wanted).isNotNull()).select(F.col(query).alias("query_id"), F.array_distinct(words_of(F.col(wanted))).alias("terms")), "bm25-queries")
    index = stage(postings(texts, asked, key, text, k1, b, block), "bm25-postings")
    terms = asked.select("query_id", F.explode("terms").alias("term"))
    most = index.groupBy("term", "block").agg(F.max("impact").alias("most"))
    bounds = stage(terms.join(most, "term").groupBy("query_id", "block").agg(F.sum("most").alias("bound")), "bm25-bounds")
    ranked = bounds.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")))
    early = _scored(ranked.filter(F.col("nth") <= first).select("query_id", "block"), asked, index, k)
    early = stage(early, "bm25-first")
    floor = early.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0.0).alias("floor"))
    rest = ranked.filter(F.col("nth") > first).join(floor, "query_id").filter(F.col("bound") >= F.col("floor") * (1 - 1e-9)).select("query_id", "block")
    late = _scored(rest, asked, index, k)
    both = early.unionByName(late)
    out = stage(both.withColumn("place", F.row_number().over(_order())).filter(F.col("place") <= k), "bm25-best")
    for done in (early, bounds, index, asked):
        unstage(done)
    return out.select("query_id", "place", F.col("key").alias(key), "score")


def _order() -> Window:
    return Window.partitionBy("query_id").orderBy(F.desc("score"), "key")


def _scored(blocks: DataFrame, asked: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(query_id, key, score): the k best texts of each query in some blocks.

    A block is one group, with its postings and the queries that look at it: so what is dealt grows with both,
    and not with each posting for each query that asks for its term.
    """
    query, key = dict(asked.dtypes)["query_id"], dict(index.dtypes)["key"]

    def score(postings: pa.Table, queries: pa.Table) -> pa.Table:
        texts = postings.column("key").combine_chunks().dictionary_encode(null_encoding="encode")
        place, impact = texts.indices.to_numpy(), postings.column("impact").to_numpy()
        rows: dict[str, list[int]] = {}
        for i, term in enumerate(postings.column("term").to_pylist()):
            rows.setdefault(term, []).append(i)
        found, whose, scores = [], [], []
        for q, terms in enumerate(queries.column("terms").to_pylist()):
            hit = [i for t in sorted(terms) for i in rows.get(t, ())]
            if not hit:
                continue
            sums, met = np.bincount(place[hit], impact[hit], len(texts.dictionary)), np.unique(place[hit])
            if len(met) > k:  # with room for rounding, which makes ties
                met = met[sums[met] >= np.partition(sums[met], -k)[-k] - 1e-8]
            found.append(met)
            whose.append(np.full(len(met), q))
            scores.append(sums[met])
        none = [np.zeros(0, np.int64)]
        return pa.table({"query_id": queries.column("query_id").take(pa.array(np.concatenate(whose or none))), "key": texts.dictionary.take(pa.array(np.concatenate(found or none))), "score": pa.array(np.concatenate(scores or none).astype(float))})

    wanted = blocks.join(asked, "query_id").select("block", "query_id", "terms")
    met = index.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(score, f"query_id {query}, key {key}, score double")
    # Rounded sums: the order in which terms are added must not decide between ties.
    scores = met.withColumn("score", F.round("score", 9))
    return scores.withColumn("n", F.row_number().over(_order())).filter(F.col("n") <= k).drop("n")


def blocks_scored(bounds: DataFrame, floor: DataFrame, first: int = FIRST) -> DataFrame:
    """(query_id, scored, blocks): how many of a query's blocks are scored, given its bounds (query_id, block, bound) and k-th score (query_id, floor)."""
    ranked = bounds.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")))
    kept = (F.col("nth") <= first) | (F.col("bound") >= F.col("floor") * (1 - 1e-9))
    return ranked.join(floor, "query_id").groupBy("query_id").agg(F.count_if(kept).alias("scored"), F.count("*").alias("blocks"))
