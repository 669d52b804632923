"""Packing documents into training sequences by best-fit decreasing.

One pass over the texts cuts every document, at multiples of the window, into
pieces: full windows, which are sequences by themselves, and a rest.  Only the
rests' lengths are packed.  They are dealt by hash into groups of about a
million tokens, and each group is packed alone: pieces in falling length, each
into the tightest open window, found in a segment tree over remaining capacity.
A group has some hundred windows, so its last few open ones are little padding,
and its size does not grow with the corpus.

A null or empty text is the end token alone.  Repeated rows are packed as often
as they occur.  Very long texts become many full windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brakta.llm.bpe import encoder
from brakta.llm.common import map_arrow, texts
from brakta.plans.staging import stage

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long"


class OpenWindows:
    """Windows by remaining capacity: a segment tree whose leaves count the open windows of each capacity."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.ids: list[list[int]] = [[] for _ in range(window + 1)]

    def push(self, capacity: int, window: int) -> None:
        self.ids[capacity].append(window)
        self._add(capacity, 1)

    def _add(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, length: int) -> tuple[int, int] | None:
        """(capacity, window) of the open window with the least capacity of ``length`` or more; it is taken out."""
        node = self.leaves + length
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.ids[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each length, taken in the order given, which must not rise."""
    open_, bins, offsets, n = OpenWindows(window), [], [], 0
    for length in lengths:
        found = open_.tightest(length)
        if found is None:
            found, n = (window, n), n + 1
        capacity, at = found
        bins.append(at)
        offsets.append(window - capacity)
        if capacity > length:
            open_.push(capacity - length, at)
    return bins, offsets


def cut(docs: DataFrame, make_encoder: Callable[[], Callable[[str], bytes]], window: int, end: int | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every document, with a checksum of their ids; ``row`` tells repeated rows apart."""
    tail = b"" if end is None else end.to_bytes(4, "little")

    def make():
        encode = make_encoder()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(6)]
            for doc, row, value in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), texts(batch), strict=True):
                ids = encode(value) + tail
                for at in range(0, len(ids), 4 * window):
                    piece = ids[at : at + 4 * window]
                    for column, x in zip(out, (doc, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, row), strict=True):
                        column.append(x)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])

        return step

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    return map_arrow(rows, make, PIECES)


def pack(pieces: DataFrame, window: int = 4096, group_tokens: int = 1 << 20) -> DataFrame:
    """Adds sequence_id and offset to staged ``pieces``; one job sums the lengths of what is to be packed."""
    rest = pieces.filter(F.col("length") < window)
    tokens = rest.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(tokens / group_tokens))

    def one(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("row", "start", "length")}
        order = np.lexsort((col["start"], col["row"], -col["length"]))
        bins, offsets = best_fit_decreasing(col["length"][order].tolist(), window)
        group = table.column("grp")[0].as_py()
        table = table.take(pa.array(order))
        return table.drop_columns(["grp"]).append_column("sequence_id", pa.array((np.int64(group) << 32) + np.array(bins, np.int64))).append_column("offset", pa.array(offsets, pa.int64()))

    dealt = rest.withColumn("grp", F.pmod(F.xxhash64("row", "start"), F.lit(groups)))
    packed = dealt.groupBy("grp").applyInArrow(one, f"{PIECES}, sequence_id long, offset long")
    # Full windows: above all packed sequences (2^62), numbered by the scan's partition and row.
    full = pieces.filter(F.col("length") >= window).withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(1 << 62)).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 4096, end: int | None = 2) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): every id lies in exactly one piece."""
    pieces = stage(cut(docs, lambda: encoder(tokenizer), window, end), "pieces")
    return pack(pieces, window).drop("row")
