"""Removing repeated byte strings: a suffix array made by two-stage sorting.

A byte goes if it lies in a string of ``width`` bytes that also starts earlier.
No single suffix array holds a corpus, so the text is first cut to what can
repeat, without losing any repeat:

1. Every string of ``width`` bytes (a window) has one anchor: the k-gram with the
   least hash in it.  Equal windows have equal anchors.  The windows of one
   anchor are a short stretch of text, its context.
2. Anchors are dealt by hash.  One that occurs once has no repeats.  Of contexts
   that are equal, all but the first are repeats entirely, and only firsts go on.
3. Firsts whose anchor has other contexts too are fetched and dealt by anchor, so
   equal windows meet in one task, which sorts their suffixes to ``width`` bytes:
   only suffixes whose first byte is not above their successor's (and the last of
   each context) are sorted directly; the others are induced, bucket by bucket,
   from their successors.  Where adjacent suffixes share ``width`` bytes, all but
   the earliest repeat.
4. An anchor with very many contexts (text around a passage that is everywhere) is
   dealt by its windows instead, each task first keeping its earliest of a kind.

Equal contexts meet within each scan task before anything is dealt, so copies
and common passages cost one row a task.  Null is the empty text.  Texts below
``width`` bytes keep everything.  Very long texts are read in overlapping slices.
Rows that share an id are one document if their texts are equal; if not, they are
documents of their own, in the order of a hash of the text (64 bits, ``variant``).
A null id comes after all others.  Parts are as many as the texts' bytes ask for.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brakta.llm.common import map_arrow
from brakta.plans.staging import stage

GRAM = 32
SLICE = 1 << 18
LAST_ID = 2**63 - 1
#: Contexts of one anchor, in one scan batch and in all, beyond which it is dealt by window.
HOT_IN_BATCH, HOT = 64, 20_000

_BYTE = np.random.default_rng(17).integers(0, 2**64, 256, dtype=np.uint64)


def gram_order(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each k-gram, by doubling."""
    h, base, span = _BYTE[data], 0x9E3779B97F4A7C15, 1
    while span < GRAM:
        h = h[:-span] * np.uint64(base) + h[span:]
        base = base * base % (1 << 64)
        span *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, number of windows) of each anchor; windows are told by their start."""
    grams = gram_order(data)
    reach = width - GRAM + 1
    # Order by the hash's upper half, then by place: the least is the leftmost.
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < reach:
        rest = reach - span
        least = np.minimum(least[: len(least) - rest], least[rest:])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return grams[place[first]], first, np.diff(first, append=len(place))


def contexts_of(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a whole text, slice by slice; slices overlap by a window less one, so each window is in one."""
    if len(data) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = []
    for at in range(0, len(data) - width + 1, SLICE):
        h, first, n = anchors(np.frombuffer(data, np.uint8, min(SLICE + width - 1, len(data) - at), at), width)
        parts.append((h, first + at, n))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


# Packed lists travel as bytes: a count, hashes as they are, small columns compressed.
# A document is told by doc and var, its id and the hash of its text.
def pack(h, ctx, doc, var, lo, n) -> bytes:
    small = zstandard.compress(b"".join([*(np.diff(x, prepend=0).astype("<i8").tobytes() for x in (doc, var)), lo.astype("<i4").tobytes(), n.astype("u1").tobytes()]), 1)
    return struct.pack("<II", len(h), len(small)) + h.astype("<u8").tobytes() + ctx.astype("<u8").tobytes() + small


def unpack(blobs: list[bytes]) -> list[np.ndarray]:
    out = []
    for b in blobs:
        k, s = struct.unpack_from("<II", b)
        h, ctx = np.frombuffer(b, "<u8", k, 8), np.frombuffer(b, "<u8", k, 8 + 8 * k)
        small = zstandard.decompress(b[8 + 16 * k : 8 + 16 * k + s])
        doc, var = (np.cumsum(np.frombuffer(small, "<i8", k, 8 * k * i)) for i in range(2))
        out.append((h, ctx, doc, var, np.frombuffer(small, "<i4", k, 16 * k), np.frombuffer(small, "u1", k, 20 * k)))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def firsts(h, ctx, doc, var, lo) -> tuple[np.ndarray, np.ndarray]:
    """The rows that open their (anchor, context), and those that repeat it at another place; the same place again is in neither."""
    order = np.lexsort((lo, var, doc, ctx, h))
    h, ctx, doc, var, lo = (x[order] for x in (h, ctx, doc, var, lo))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    return order[new], order[(doc != doc[head]) | (var != var[head]) | (lo != lo[head])]


def by_document(doc: np.ndarray, var: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, edges): rows by document, then by ``more``, and where each document begins, with the end."""
    order = np.lexsort((*more[::-1], var, doc))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(doc[order]) != 0) | (np.diff(var[order]) != 0)
    return order, np.append(np.flatnonzero(new), len(order))


def spans_blobs(doc: np.ndarray, var: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Spans, merged, as one list of bytes for each document."""
    order, edges = by_document(doc, var, start)
    doc, var, start, end = (x[order] for x in (doc, var, start, end))
    return [(int(doc[s]), int(var[s]), merged(start[s:e], end[s:e]).astype("<i4").tobytes()) for s, e in zip(edges[:-1], edges[1:], strict=True)]


def merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(start, end) rows of the union of spans whose starts rise; spans that touch are one."""
    top = np.maximum.accumulate(end)
    opens = np.flatnonzero(np.concatenate([[True], start[1:] > top[:-1]]))
    return np.stack([start[opens], np.append(top[opens[1:] - 1], top[-1])], 1)


def dealt_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"part": pa.int32(), "doc_id": pa.int64(), "variant": pa.int64(), "data": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else ((),) * 4, kinds.values(), strict=True)], list(kinds))


def scan(width: int, parts: int, hot_in_batch: int):
    """Texts -> anchors by part of the hash (doc null), and repeats found on the spot (part null)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = []
            for doc, var, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "variant", "text")), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                h, lo, n = contexts_of(data, width)
                if len(h):
                    digest = xxhash.xxh3_64_intdigest
                    ctx = np.fromiter((digest(data[s:e]) for s, e in zip(lo.tolist(), (lo + n + width - 1).tolist(), strict=True)), np.uint64, len(h))
                    found.append((h, ctx, np.full(len(h), doc), np.full(len(h), var), lo, n))
            rows: list[tuple] = []
            if found:
                h, ctx, doc, var, lo, n = (np.concatenate(x) for x in zip(*found, strict=True))
                kept, again = firsts(h, ctx, doc, var, lo)
                rows += [(None, *r) for r in spans_blobs(doc[again], var[again], lo[again], (lo + n)[again] + width - 1)]
                # An anchor with very many contexts here: a mark (no windows) goes along for all to see.
                kinds, counts = np.unique(h[kept], return_counts=True)
                marks = kinds[counts > hot_in_batch]
                h, ctx, doc, var, lo, n = (np.concatenate([x[kept], y]) for x, y in zip((h, ctx, doc, var, lo, n), (marks, *(np.zeros(len(marks), int) for _ in range(5))), strict=True))
                part = (h % np.uint64(parts)).astype(int)
                order = np.lexsort((lo, var, doc, part))
                edges = np.searchsorted(part[order], np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(edges)).tolist():
                    own = order[edges[p] : edges[p + 1]]
                    rows.append((p, None, None, pack(h[own], ctx[own].astype(np.uint64), doc[own], var[own], lo[own], n[own])))
            return dealt_rows(rows)

        return step

    return make


def settle(width: int, many_contexts: int):
    """One part's anchors -> repeats (kind 0), and contexts to be compared (kind 1; 2 by window), for each document."""

    def one(table: pa.Table) -> pa.Table:
        h, ctx, doc, var, lo, n = unpack(table.column("data").to_pylist())
        mark, n = n == 0, n.astype(np.int64)
        hot = np.unique(h[mark])
        h, ctx, doc, var, lo, n = (x[~mark] for x in (h, ctx, doc, var, lo, n))
        kept, again = firsts(h, ctx, doc, var, lo)
        rows = [(0, *r) for r in spans_blobs(doc[again], var[again], lo[again], (lo + n)[again] + width - 1)]
        _, inverse, counts = np.unique(h[kept], return_inverse=True, return_counts=True)
        many = kept[counts[inverse] > 1]
        wide = np.isin(h[many], hot) | (counts[inverse][counts[inverse] > 1] > many_contexts)
        for k, own in ((1, many[~wide]), (2, many[wide])):
            order, edges = by_document(doc[own], var[own])
            own = own[order]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                x = own[s:e]
                rows.append((k, int(doc[x[0]]), int(var[x[0]]), h[x].astype("<u8").tobytes() + lo[x].astype("<i4").tobytes() + n[x].astype("u1").tobytes()))
        return pa.table({c: pa.array(x, t) for (c, t), x in zip((("kind", pa.int8()), ("doc_id", pa.int64()), ("variant", pa.int64()), ("data", pa.binary())), zip(*rows, strict=True) if rows else ((),) * 4, strict=True)})

    return one


def fetch(width: int, parts: int):
    """Texts with their lists of anchors -> contexts, by part; windows of hot anchors, by their own hash."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            heads: dict[int, list] = {}
            seen: dict[bytes, tuple[int, int, int]] = {}
            doubles: list[tuple[int, int, int]] = []
            met = set()
            for doc, var, text, cold, hot in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "variant", "text", "cold", "hot")), strict=True):
                if (doc, var) in met:
                    continue
                met.add((doc, var))
                data = (text or "").encode("utf-8", "surrogatepass")
                for blobs, by_window in ((cold, False), (hot, True)):
                    for b in blobs or ():
                        k = len(b) // 13
                        for h, lo, n in zip(np.frombuffer(b, "<u8", k).tolist(), np.frombuffer(b, "<i4", k, 8 * k).tolist(), np.frombuffer(b, "u1", k, 12 * k).tolist(), strict=True):
                            if not by_window:
                                heads.setdefault(h % parts, []).append((doc, var, lo, data[lo : lo + n + width - 1]))
                                continue
                            for s in range(lo, lo + n):
                                w = data[s : s + width]
                                before = seen.get(w)
                                if before is None or (doc, var, s) < before:
                                    seen[w], other = (doc, var, s), before
                                else:
                                    other = (doc, var, s)
                                if other and other != seen[w]:
                                    doubles.append(other)
            for w, (doc, var, s) in seen.items():
                heads.setdefault(xxhash.xxh3_64_intdigest(w) % parts, []).append((doc, var, s, w))
            rows: list[tuple] = []
            for p, items in heads.items():
                doc, var, lo, data = zip(*items, strict=True)
                size = np.array([len(x) for x in data], "<u2")
                rows.append((p, None, None, struct.pack("<I", len(items)) + np.array(doc, "<i8").tobytes() + np.array(var, "<i8").tobytes() + np.array(lo, "<i4").tobytes() + size.tobytes() + b"".join(data)))
            if doubles:
                doc, var, s = (np.array(x) for x in zip(*doubles, strict=True))
                rows += [(None, *r) for r in spans_blobs(doc, var, s, s + width)]
            return dealt_rows(rows)

        return step

    return make


def suffix_array(text: np.ndarray, wanted: np.ndarray, width: int) -> np.ndarray:
    """Positions where ``wanted`` is set, sorted by their next ``width`` bytes: two-stage sorting.

    Sorted directly: suffixes whose first byte is at most the next, and those
    whose successor is not wanted.  The rest have a first byte above their
    successor's, so they follow from suffixes in buckets before their own.
    """
    at = np.flatnonzero(wanted)
    if not len(at):
        return at
    successor = np.append(wanted[1:], False)[at]
    direct = (text[at] <= text[np.minimum(at + 1, len(text) - 1)]) | ~successor
    own = at[direct]
    rows = np.lib.stride_tricks.sliding_window_view(text, width)
    own = own[np.argsort(np.ascontiguousarray(rows[own]).view(f"S{width}").ravel(), kind="stable")]
    induced = np.zeros(len(text), bool)
    induced[at[~direct]] = True
    edges = np.searchsorted(text[own], np.arange(257))
    arrived: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        # A suffix with a smaller second byte comes first; within this bucket those are the induced ones,
        # but for directly sorted ones without a wanted successor, which are merged by their bytes.
        bucket = own[edges[c] : edges[c + 1]]
        if arrived[c]:
            early = np.concatenate(arrived[c])
            bucket = merge(early, bucket, rows, width)
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before]]
        if len(before):
            heads = text[before]
            before = before[np.argsort(heads, kind="stable")]
            marks = np.searchsorted(text[before], np.arange(257))
            for d in np.unique(heads).tolist():
                arrived[d].append(before[marks[d] : marks[d + 1]])
    return np.concatenate(out)


def merge(a: np.ndarray, b: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """Two sorted runs of one bucket as one."""
    if not len(b):
        return a
    low = rows[b, 1]
    # All of ``b`` that rise at once lie behind ``a``; only falling ones can lie between.
    falling = np.flatnonzero(low < rows[b, 0])
    if not len(falling):
        return np.concatenate([a, b])
    kind = f"S{width}"
    key = np.ascontiguousarray(rows[a]).view(kind).ravel()
    mixed = b[falling]
    place = np.searchsorted(key, np.ascontiguousarray(rows[mixed]).view(kind).ravel(), side="right")
    return np.concatenate([np.insert(a, place, mixed), np.delete(b, falling)])


def eight(text: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position as one number, by doubling."""
    x, shift, span = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64), 8, 1
    while span < 8:
        x = (x[:-span] << np.uint64(shift)) | x[span:]
        shift *= 2
        span *= 2
    return x


def same_prefix(text: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Whether each suffix shares ``width`` bytes with the one before it."""
    x, alive = eight(text), np.arange(1, len(order))
    for at in (width - 8, *range(0, width - 8, 8)):
        alive = alive[x[order[alive] + at] == x[order[alive - 1] + at]]
    out = np.zeros(len(order), bool)
    out[alive] = True
    return out


def compare(width: int):
    """Contexts of one part -> spans of windows that also start earlier."""

    def one(table: pa.Table) -> pa.Table:
        lists: list[list[np.ndarray]] = [[] for _ in range(5)]
        for b in table.column("data").to_pylist():
            k = struct.unpack_from("<I", b)[0]
            columns = (("<i8", k, 4), ("<i8", k, 4 + 8 * k), ("<i4", k, 4 + 16 * k), ("<u2", k, 4 + 20 * k), (np.uint8, -1, 4 + 22 * k))
            for own, (kind, n, at) in zip(lists, columns, strict=True):
                own.append(np.frombuffer(b, kind, n, at))
        doc, var, lo, size, text = (np.concatenate(x) for x in lists)
        size = size.astype(np.int64)
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(size)), size)
        wanted = np.arange(len(text)) <= (begin + size - width)[owner]
        order = suffix_array(text, wanted, width)
        group = np.cumsum(~same_prefix(text, order, width))
        many = np.bincount(group)[group] > 1
        order, group = order[many], group[many]
        own = owner[order]
        d, v, s = doc[own], var[own], lo[own].astype(np.int64) + order - begin[own]
        by = np.lexsort((s, v, d, group))
        d, v, s, group = d[by], v[by], s[by], group[by]
        head = np.maximum.accumulate(np.where(np.diff(group, prepend=-1) != 0, np.arange(len(group)), 0)) if len(group) else np.zeros(0, int)
        later = (d != d[head]) | (v != v[head]) | (s != s[head])
        rows = spans_blobs(d[later], v[later], s[later], s[later] + width)
        return pa.table({c: pa.array(x, t) for (c, t), x in zip((("doc_id", pa.int64()), ("variant", pa.int64()), ("data", pa.binary())), zip(*rows, strict=True) if rows else ((),) * 3, strict=True)})

    return one


def repeats(docs: DataFrame, width: int = 100, part_bytes: int = 8 << 20, hot_in_batch: int = HOT_IN_BATCH, many_contexts: int = HOT) -> DataFrame:
    """(doc_id, variant, spans): for each document with repeats, lists of (start, end) pairs as little-endian 32-bit integers.

    docs: (doc_id, variant, text), ids not null.  A part's task holds the anchors of about ``part_bytes`` of text.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(16, -(-size // part_bytes))
    dealt = "part int, doc_id long, variant long, data binary"
    # Repeats found on the spot pass through the parts' tasks, dealt by document: one scan of the texts serves both.
    part = F.coalesce("part", -1 - F.pmod(F.xxhash64("doc_id", "variant"), F.lit(parts)).cast("int"))
    scanned = map_arrow(docs.select("doc_id", "variant", "text"), scan(width, parts, hot_in_batch), dealt).withColumn("part", part)
    own = settle(width, many_contexts)

    def settle_part(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() < 0:
            return table.select(["doc_id", "variant", "data"]).add_column(0, "kind", pa.array([0] * table.num_rows, pa.int8()))
        return own(table)

    settled = stage(scanned.groupBy("part").applyInArrow(settle_part, "kind byte, doc_id long, variant long, data binary"), "anchors")
    document = ["doc_id", "variant"]
    lists = settled.filter("kind > 0").groupBy(document).agg(F.collect_list(F.when(F.col("kind") == 1, F.col("data"))).alias("cold"), F.collect_list(F.when(F.col("kind") == 2, F.col("data"))).alias("hot"))
    fetched = map_arrow(docs.select(*document, "text").join(lists, document), fetch(width, parts), dealt).withColumn("part", part)
    look = compare(width)

    def compare_part(table: pa.Table) -> pa.Table:
        return table.select(["doc_id", "variant", "data"]) if table.column("part")[0].as_py() < 0 else look(table)

    found = stage(fetched.groupBy("part").applyInArrow(compare_part, "doc_id long, variant long, data binary"), "repeats")
    return settled.filter("kind = 0").select(*document, "data").unionByName(found).groupBy(document).agg(F.collect_list("data").alias("spans"))


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, variant, text): an id that is never null, and a hash of the text."""
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.xxhash64(text).alias("variant"), F.col(text).alias("text"))


def union_of(spans: list[bytes] | None, size: int) -> np.ndarray:
    """Spans of one document, merged and kept within its bytes."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    pairs = np.frombuffer(b"".join(spans), "<i4").reshape(-1, 2).astype(np.int64)
    pairs = np.minimum(pairs[np.argsort(pairs[:, 0], kind="stable")], size)
    return merged(pairs[:, 0], pairs[:, 1])


def kept_bytes(data: bytes, spans: np.ndarray) -> bytes:
    out, at = [], 0
    for s, e in spans.tolist():
        out.append(data[at:s])
        at = e
    return b"".join([*out, data[at:]])


def digest(docs: DataFrame, width: int = 100, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``."""
    own = keyed(docs, key, text)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(4)]
            for value, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = (value or "").encode("utf-8", "surrogatepass")
                pairs = union_of(spans, len(data))
                row = (len(data), int((pairs[:, 1] - pairs[:, 0]).sum()), len(pairs), hashlib.sha256(kept_bytes(data, pairs)).hexdigest())
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

        return step

    made = map_arrow(own.join(repeats(own, width, **how), ["doc_id", "variant"], "left"), make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return made.withColumn("doc_id", F.when(F.col("doc_id") != LAST_ID, F.col("doc_id")))


def remove_repeats(docs: DataFrame, width: int = 100, key: str = "doc_id", text: str = "text", keep_empty: bool = True) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text``; a character that is cut into goes as a whole.

    Rows whose whole text goes stay with an empty text, or go if ``keep_empty`` is false.
    """
    named = docs.withColumns({"__id": F.coalesce(F.col(key).cast("long"), F.lit(LAST_ID)), "__variant": F.xxhash64(text)})
    spans = repeats(keyed(docs, key, text), width)
    joined = named.join(spans.select(*(F.col(c).alias(k) for c, k in (("doc_id", "__id"), ("variant", "__variant"), ("spans", "__spans")))), ["__id", "__variant"], "left")
    columns = docs.columns

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = []
            for value, pairs in zip(batch.column(text).to_pylist(), batch.column("__spans").to_pylist(), strict=True):
                if value is None or not pairs:
                    made.append(value)
                    continue
                data = value.encode("utf-8", "surrogatepass")
                made.append(kept_bytes(data, union_of(pairs, len(data))).decode("utf-8", "ignore"))
            arrays = [pa.array(made, pa.string()) if c == text else batch.column(c) for c in columns]
            return pa.RecordBatch.from_arrays(arrays, columns)

        return step

    out = map_arrow(joined.select(*columns, "__spans"), make, docs.schema)
    return out if keep_empty else out.filter(F.coalesce(F.length(text), F.lit(1)) > 0)
