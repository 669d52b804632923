"""Helpers shared by the training-data operators."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from sys import getsizeof

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def hashed_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df``, chosen by a hash of ``key``: the same rows at every run.

    Runs one count.  All rows are returned when there are no more than ``rows``.
    """
    n = df.count()
    if n <= rows:
        return df
    cut = int(rows / n * (1 << 30))
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(20)), F.lit(1 << 30)) < cut)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, size: int, key: str, text: str) -> DataFrame:
    """(doc_id, y, text): labelled texts, ``rows`` at most and ``size`` bytes at most in all, the same at every run.

    They are taken in the order of a hash of id and text, passing over those that do not fit any more.
    Equal rows count once; an id with two labels, or texts, is a row for each.  Runs two jobs; what is
    broadcast, and what the driver sees, is bounded by ``rows``.
    """
    said = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), (F.col(label) > 0).cast("int").alias("y")).distinct()
    chosen = hashed_sample(said, "doc_id", rows)
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    found = own.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text_hash", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).distinct()
    left, taken = size, []
    for r in found.orderBy(F.xxhash64("doc_id", "text_hash", F.lit(22)), "doc_id", "text_hash", "y").limit(rows).collect():
        if r["n"] <= left:
            left -= r["n"]
            taken.append((r["doc_id"], r["y"], r["text_hash"]))
    kind = dict(own.dtypes)["doc_id"]
    few = docs.sparkSession.createDataFrame(taken, f"doc_id {kind}, y int, text_hash long")
    return own.join(F.broadcast(few), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "y", "text_hash"]).select("doc_id", "y", "text")


class Memo(dict):
    """A dictionary that computes what is missing, within a budget of bytes.

    It holds two generations of at most about ``limit`` bytes each, by their size
    as Python objects: when the younger is full it becomes the elder, so what is
    asked for often stays.  An entry of more than a thousandth of that is not kept,
    so words of megabytes displace nothing.  With ``twice``, an entry is kept from
    the second time on that it is computed: most words of a corpus occur once, and
    take a byte of a table then, which they may share.
    """

    #: What an entry's place in the dictionary takes beside its objects.
    SLOT = 80
    #: Bytes, a power of two, that tell what was computed once.
    ONCE = 1 << 21

    def __init__(self, compute: Callable, limit: int = 48 << 20, base: dict | None = None, twice: bool = False):
        super().__init__()
        self.compute, self.limit, self.left, self.elder, self.base = compute, limit, limit, {}, base or {}
        self.once = bytearray(self.ONCE) if twice else None

    def __missing__(self, key):
        value = self.elder.get(key)
        if value is None:
            value = self.base.get(key)
            if value is None:
                value = self.compute(key)
            if self.once is not None:
                at = hash(key) & (self.ONCE - 1)
                if not self.once[at]:
                    self.once[at] = 1
                    return value
        cost = getsizeof(key) + getsizeof(value) + self.SLOT
        if cost > self.limit >> 10:
            return value
        self.left -= cost
        if self.left < 0:
            self.elder, self.left = self.copy(), self.limit - cost
            self.clear()
            if self.once is not None:
                self.once = bytearray(self.ONCE)
        self[key] = value
        return value


#: What a Python worker keeps from task to task: the tables of one operator, told by a key.
_KEPT: dict = {}


def kept(key, make: Callable):
    """What ``make`` returns, kept for the worker's next tasks until another operator keeps something, or runs a task without.

    So what a worker holds is bounded by one operator's memos.
    """
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    _KEPT[None] = True
    return _KEPT[key]


def term_hash(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass"))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with ``make()`` called once a task, so that tables are built once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _KEPT.pop(None, None)
        step = make()
        if None not in _KEPT:
            _KEPT.clear()
        for batch in batches:
            # At most some 16 MB and 2048 rows at a time, but a row at least.
            rows = max(1, min(2048, (batch.num_rows << 24) // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, rows):
                yield step(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], make: Callable[[], Callable[[pa.Table], pa.Table]], schema: str) -> DataFrame:
    """Like ``applyInArrow`` for very many small groups: each call gets a table of whole groups, next to each other.

    Rows are dealt and sorted by ``keys``; a group is held until its last row, so groups must be bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, held = make(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            last = held.num_rows - 1
            tail = [held.column(k)[last] for k in keys]
            low, high = 0, last  # the first row of the last group: rows are sorted
            while low < high:
                mid = (low + high) // 2
                same = all(held.column(k)[mid].equals(v) for k, v in zip(keys, tail, strict=True))
                low, high = (low, mid) if same else (mid + 1, high)
            if low:
                yield from step(held.slice(0, low).combine_chunks()).to_batches()
                held = held.slice(low)
        if held is not None and held.num_rows:
            yield from step(held.combine_chunks()).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
