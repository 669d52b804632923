"""Curation: validity, exact and semantic dedup, leakage-safe splits, conversion."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from brakta.functions import parsing
from brakta.functions.text import hash_fraction
from brakta.operators.similarity import by_length, close_pairs, comparable
from brakta.operators.validate import clean_entities
from brakta.plans.staging import stage, unstage


def valid_only(rows: DataFrame) -> DataFrame:
    """Rows validated as true, where there is such a column."""
    return rows.filter(F.col("entities_validated").eqNullSafe(F.lit(True))) if "entities_validated" in rows.columns else rows


def exact_dedup(rows: DataFrame, text: str, ordinal: str) -> DataFrame:
    """The first row of each text. Texts travel as sha256, and the least ordinal is found by a combining aggregate, so a text that a third of all rows share costs each task one row."""
    firsts = rows.groupBy(F.sha2(text, 256).alias("sha")).agg(F.min(ordinal).alias(ordinal))
    return rows.join(firsts.select(F.col(ordinal)), ordinal, "left_semi")


def embedded(rows: DataFrame, text: str, make: Callable[[], Callable[[list[str]], list[tuple[int, list[float]]]]], batch: int = 64, vec: str = "embedding") -> DataFrame:
    """Adds the unit vector of each text, null as the empty text.

    make() is called once a task and gives embed(texts) -> (place in texts, vector), in any order, for at most
    ``batch`` texts at a time.  An answer that does not have one vector for each text ends the query in a ValueError.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = make()
        for part in parts:
            out: list[np.ndarray] = []
            for at in range(0, len(part), batch):
                chunk = [x or "" for x in part[text].iloc[at : at + batch]]
                said = sorted(embed(chunk), key=lambda x: x[0])
                if [i for i, _ in said] != list(range(len(chunk))):
                    raise ValueError(f"{len(said)} vectors for {len(chunk)} texts, or not one for each")
                v = np.asarray([x for _, x in said], np.float32)
                out.extend(v / np.clip(np.linalg.norm(v, axis=1, keepdims=True), 1e-12, None))
            yield part.assign(**{vec: out})

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField(vec, ArrayType(FloatType()))]))


def without_near_copies(rows: DataFrame, key: str, text: str, make: Callable, threshold: float = 0.95, batch: int = 64) -> DataFrame:
    """Rows that greedy semantic dedup keeps, at a threshold brought into [0.5, 1]; a row without a key stays.

    Rows without the text column, and no rows, pass as they are; so does all when the embedder fails, with a warning.
    """
    if text not in rows.columns or rows.isEmpty():
        return rows
    try:
        vectors = stage(embedded(rows.filter(F.col(key).isNotNull()).select(key, text), text, make, batch).drop(text), "text-vectors")
    except (PySparkException, Py4JJavaError) as e:
        logging.getLogger(__name__).warning("no semantic dedup, all rows are kept: %s", e)
        return rows
    gone = dedup_texts(vectors, threshold, key, clamp=True).filter("not keep")
    return rows.join(gone.select(key), key, "left_anti")


def greedy_keep(ids: DataFrame, pairs: DataFrame, key: str, gone: DataFrame | None = None) -> DataFrame:
    """(key, keep): in id order, a row is kept unless an earlier kept row is close to it.

    Rounds instead of a scan: what has no earlier open or kept neighbour is kept,
    and drops its later neighbours; each round is staged in the shared folder.
    ``gone`` (id) has further rows that are not kept.
    """
    others, gone = gone, None
    live, dropped = stage(pairs.select("a", "b"), "close-pairs"), None
    while True:
        # Rows that are the later end of a live pair wait; all other earlier ends are kept and drop their later ends.
        waiting = live.select(F.col("b").alias("a")).distinct()
        kept_now = live.select("a").distinct().join(waiting, "a", "left_anti")
        gone = live.join(kept_now, "a", "left_semi").select(F.col("b").alias("id")).distinct()
        gone = stage(gone, "dropped")
        before, dropped = dropped, gone if dropped is None else stage(dropped.unionByName(gone), "all-dropped")
        if before is not None:
            unstage(before)
        rest = live.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
        rest = stage(rest.join(kept_now, "a", "left_anti"), "live-pairs")
        unstage(live)
        if rest.isEmpty():
            unstage(rest)
            break
        live = rest
    if others is not None:
        dropped = dropped.unionByName(others).distinct()
    marks = dropped.select(F.col("id").alias(key), F.lit(False).alias("keep"))
    return ids.select(key).join(marks, key, "left").withColumn("keep", F.coalesce("keep", F.lit(True)))


#: Rows that are decided at once before the pairs of the others are looked for, and their bytes.
LEAD, LEAD_BYTES = 4096, 16 << 20


def _first_kept(rows: list, threshold: float) -> tuple[dict[int, np.ndarray], list[int]]:
    """(length -> vectors that the sequential scan of ``rows``, in id order, keeps; ids that it does not keep)."""
    of_length: dict[int, list] = {}
    for r in rows:
        of_length.setdefault(len(r["v"]), []).append(r)
    out, dropped = {}, []
    for d, some in of_length.items():
        v = np.array([r["v"] for r in some])
        near, kept = v @ v.T >= threshold, np.ones(len(v), bool)
        for i in range(len(v)):
            if kept[i]:
                kept[i + 1 :] &= ~near[i, i + 1 :]
        out[d] = v[kept]
        dropped += [r["id"] for r, stays in zip(some, kept, strict=True) if not stays]
    return out, dropped


def led(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame | None]:
    """(rows left, ids that are not kept) of the scan in id order over unit vectors (id, v), each id once: the first rows are decided, and what is close to those kept goes.

    Repeated while this halves what is left, so at a low threshold, where pairs are a share of all pairs, few
    rows are left to pair; nothing is dealt.  At most LEAD vectors, or LEAD_BYTES, reach the driver at a time.
    """
    n, most = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    lead, gone = max(1, min(LEAD, LEAD_BYTES // (8 * max(1, most or 1)))), None
    while n:
        head = sorted(rows.orderBy("id").limit(lead).collect(), key=lambda r: r["id"])
        (kept, dropped), last = _first_kept(head, threshold), head[-1]["id"]

        def near(batches: Iterator[pa.RecordBatch], kept: dict = kept, last: int = last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, v in by_length(batch):
                    close = np.zeros(len(ids), bool)
                    if v.shape[1] in kept:
                        close = (v @ kept[v.shape[1]].T >= threshold).any(1)
                    later = ids > last
                    yield pa.RecordBatch.from_arrays([pa.array(ids[later]), pa.FixedSizeListArray.from_arrays(pa.array(v[later].ravel()), v.shape[1]).cast(pa.list_(pa.float64())), pa.array(close[later])], ["id", "v", "close"])

        marked = stage(rows.select("id", "v").mapInArrow(near, "id long, v array<double>, close boolean"), "led")
        now = marked.filter("close").select("id").unionByName(rows.sparkSession.createDataFrame([(i,) for i in dropped], "id long"))
        gone = now if gone is None else gone.unionByName(now)
        rows, was = marked.filter("not close").select("id", "v"), n
        n = rows.count()
        if 2 * n > was:
            break
    return rows, gone


def dedup_texts(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", vec: str = "embedding", clamp: bool = False) -> DataFrame:
    """Keep mask of greedy semantic dedup; ``clamp`` brings the threshold into [0.5, 1]. Needs 0 < threshold <= 1.

    Of equal vectors all but the first go, whatever becomes of it: what drops it drops them.  So only firsts
    are compared, and a vector that a third of all rows share is one of them.  Vectors that are null, zero or
    not finite stay.
    """
    if clamp:
        threshold = min(1.0, max(0.5, threshold))
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    rows = comparable(vectors, key, vec).filter(F.exists("v", lambda x: x != 0))
    if threshold > 1 - 1e-9:  # rounding decides what is close: every row for itself
        return greedy_keep(vectors, close_pairs(rows, threshold, "id", "v"), key)
    firsts = stage(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")), "distinct-vectors")
    many = firsts.filter("n > 1").select("v", F.col("id").alias("first"))
    copies = rows.join(many, "v").filter("id > first").select("id")
    single, left = firsts.groupBy("id").count().filter("count > 1").isEmpty(), firsts
    if single:  # each id stands for one vector, so the first rows can be decided by themselves
        left, gone = led(firsts.select("id", "v"), threshold)
        copies = copies if gone is None else copies.unionByName(gone)
    return greedy_keep(vectors, close_pairs(left, threshold, "id", "v"), key, copies)


def group_key(text: Column, mentions: Column) -> Column:
    """Rows that share people share a key: their names and numbers, sorted; without any, the text's hash."""
    ids = F.array_sort(F.array_distinct(mentions))
    return F.when(F.size(ids) > 0, F.concat(F.lit("ids::"), F.array_join(ids, "|"))).otherwise(F.concat(F.lit("text::"), F.sha2(text, 256)))


def split_of(key: Column, seed: int = 42, train: float = 0.9, validation: float = 0.05) -> Column:
    """train, val or test by a hash of the key, whatever the row order or the number of rows."""
    x = hash_fraction(F.lit(seed), key)
    return F.when(x < train, "train").when(x < train + validation, "val").otherwise("test")


def pool_hash(values: Column) -> Column:
    """First 16 hex digits of sha256 of a list of strings as JSON."""
    return F.substring(F.sha2(F.concat(F.lit('["'), F.array_join(values, '", "'), F.lit('"]')), 256), 1, 16)


def random_split(rows: DataFrame, train: float, validation: float, seed: int) -> list[DataFrame]:
    """The older split, row by row."""
    return rows.randomSplit([train, validation, max(0.0, 1 - train - validation)], seed)


def coverage(examples: DataFrame) -> DataFrame:
    """Rows per task family. examples: (entities map, sensitivity array, structures string, relations array)."""
    return examples.agg(F.count_if(F.size("entities") > 0).alias("entities"), F.count_if(F.size("sensitivity") > 0).alias("classification"), F.count_if(F.col("structures") != "[]").alias("structures"), F.count_if(F.size("relations") > 0).alias("relations"), F.count("*").alias("rows"))


def with_split(rows: DataFrame, labels: list[str], seed: int = 42, train: float = 0.9, validation: float = 0.05) -> DataFrame:
    """Adds clean entities, group_key and split. rows: (text, entities map), and records (array of maps, or JSON) with records_validated where there are any: names and numbers of validated records that stand in the text count as mentions."""
    clean = rows.withColumn("entities", clean_entities(F.col("text"), F.col("entities"), labels))
    people = F.concat(*[F.coalesce(F.try_element_at("entities", F.lit(k)), F.array().cast("array<string>")) for k in ("person", "personnummer")])
    if {"records", "records_validated"} <= set(rows.columns):
        given = parsing.records(F.col("records")) if rows.schema["records"].dataType == StringType() else F.col("records")
        named = F.flatten(F.transform(F.filter(given, lambda r: r.isNotNull()), lambda r: F.array(F.try_element_at(r, F.lit("name")), F.try_element_at(r, F.lit("personnummer")))))
        found = F.filter(named, lambda v: v.isNotNull() & (v != "") & F.col("text").contains(v))
        people = F.concat(people, F.when(F.col("records_validated"), F.coalesce(found, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    keyed = clean.withColumn("group_key", group_key(F.col("text"), people))
    return keyed.withColumn("split", split_of(F.col("group_key"), seed, train, validation))


def first_in_window(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """First row per key by window, for small groups."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal))).filter("__n = 1").drop("__n")
