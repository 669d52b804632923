"""Near-duplicate documents: an n-gram Jaccard join by a MinHash LSH forest.

A text's shingles are its runs of five words (a shorter text is one shingle).
Documents with the same shingle set are one representative with a multiplicity.
Every representative has a MinHash signature in several trees; in each tree the
signatures, sorted, are a prefix trie.  Representatives that share a prefix of
``prefix`` values in any tree meet.  The prefix is the same for all, whatever else
the corpus holds: a pair of similarity s meets with chance 1-(1-s^prefix)^trees,
which is 0.998 at a threshold of 0.8, and more above it.

Pairs in a trie node that the signatures call alike only join representatives
into candidate clusters; the clusters' texts are fetched once, and all pairs in a
cluster are then compared exactly.  Trie nodes and clusters beyond a block's size
are dealt into blocks, every pair of blocks a task, so none is one task and none
is cut short.  What leaves a task are link counts and spanning forests.

Result: for each row its class (the smallest doc_id reachable by links), its
number of links to other rows, copies included, and whether its id is the class'.
Rows that share an id are rows of their own, whatever their texts.  Null, empty
and blank texts have no shingle and link with nothing; a null id keeps a null
class, no links, and is kept.  An empty table gives an empty one.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brakta.llm.common import Memo, kept, map_arrow, map_groups, texts
from brakta.llm.components import connected_components, hub_join
from brakta.llm.embed_dedup import forest
from brakta.plans.staging import stage, unstage

TREES, DEPTH = 16, 8
#: ASCII white space as in brakta.llm.common.WORD; str.split() knows more.
BLANKS = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hasher():
    """word -> its 64-bit hash; a Python worker keeps the words it has met, within the memo's bytes."""
    return kept("word hashes", lambda: Memo(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))).__getitem__)


def shingles(text: str, get, n: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word n-grams."""
    words = [w for w in text.translate(BLANKS).split(" ") if w]
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(get, words), np.uint64, len(words))
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = (out + h[i : len(h) - n + 1 + i]) * MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signer(trees: int = TREES, depth: int = DEPTH, seed: int = 7):
    """shingle hashes -> MinHash signature as big-endian 32-bit values."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, trees * depth, dtype=np.uint64)

    def sign(h: np.ndarray) -> bytes:
        least = np.full(len(a), 2**64 - 1, np.uint64)
        for at in range(0, len(h), 512):
            part = h[None, at : at + 512] * a[:, None]
            part += b[:, None]
            np.minimum(least, part.min(1), out=least)
        return (least >> np.uint64(32)).astype(">u4").tobytes()

    return sign


def signatures(docs: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """(doc_id, text_hash, set_key, sig): null key and signature without a word."""

    def make():
        get, sign = word_hasher(), signer()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, sigs = [], []
            for x in texts(batch):
                s = shingles(x, get, words)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(sign(s) if len(s) else None)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "text_hash", "set_key", "sig"])

        return step

    return map_arrow(hashed_texts(docs, key, text), make, "doc_id long, text_hash long, set_key binary, sig binary")


def hashed_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))


def placed(df: DataFrame, keys: list[str], node: str, block: int) -> DataFrame:
    """Adds blocks and own: a group beyond ``block`` rows is dealt into blocks."""
    large = df.groupBy(keys).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")).filter("blocks > 1")
    return df.join(large, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64(node), F.col("blocks")).cast("int"))


def in_pairs(df: DataFrame) -> DataFrame:
    """Adds i and j: the rows of a block go to every pair of blocks with theirs."""
    return df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "blocks")


def runs(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The number of each row's group; groups lie next to each other."""
    new = np.zeros(table.num_rows, bool)
    for k in keys:
        codes = table.column(k).combine_chunks().dictionary_encode()
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new)


def alike_in_nodes(nodes: DataFrame, cut: float, block: int = 1024) -> DataFrame:
    """(a, b): candidate links from all trie nodes of two or more."""
    tiled = in_pairs(placed(nodes, ["tree", "node"], "rep", block))
    keys = ["tree", "node", "i", "j"]

    def make():
        def step(table: pa.Table) -> pa.Table:
            group = runs(table, keys)
            rep, own, i, j = (table.column(c).to_numpy() for c in ("rep", "own", "i", "j"))
            low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(len(rep), TREES * DEPTH)
            hits_a, hits_b = [], []
            for d in range(1, int(np.bincount(group).max(initial=0))):
                a = np.flatnonzero(group[d:] == group[:-d])
                a = a[(i[a] == j[a]) | (own[a] != own[a + d])]
                for at in range(0, len(a), 20_000):
                    x = a[at : at + 20_000]
                    near = (low[x] == low[x + d]).mean(1) >= cut
                    hits_a.append(x[near])
                    hits_b.append(x[near] + d)
            a, b = (np.concatenate(x) if x else np.zeros(0, int) for x in (hits_a, hits_b))
            root = forest(a, b, len(rep)) if len(a) else np.arange(len(rep))
            tied = root != np.arange(len(rep))
            return pa.table({"a": pa.array(rep[tied], pa.int64()), "b": pa.array(rep[root[tied]], pa.int64())})

        return step

    return map_groups(tiled.select(*keys, "own", "rep", "low"), keys, make, "a long, b long")


def candidates(reps: DataFrame, prefix: int, cut: float) -> DataFrame:
    """Links (a, b) between representatives that share a prefix in a tree and whose signatures look alike."""
    trees = reps.select("rep", "low", F.posexplode(F.array(*[F.substring("sig", 4 * DEPTH * t + 1, 4 * DEPTH) for t in range(TREES)])).alias("tree", "path"))
    nodes = trees.select("rep", "tree", F.xxhash64(F.substring("path", 1, 4 * prefix)).alias("node"))
    shared = nodes.groupBy("tree", "node").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    full = nodes.join(shared, ["tree", "node"]).join(reps.select("rep", "low"), "rep")
    return stage(alike_in_nodes(full, cut), "trie-links")


def verify(texts_: DataFrame, words: int, threshold: float) -> DataFrame:
    """(rep, least, links) from exact comparisons in each cluster. texts_: (root, rep, mult, blocks, own, text)."""
    share = Fraction(str(threshold))

    def make_shingles():
        get = word_hasher()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [shingles(x, get, words).tobytes() for x in texts(batch)]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(made, pa.binary())], [*kept, "grams"])

        return step

    kept = ["root", "rep", "mult", "blocks", "own"]
    grams = map_arrow(texts_.select(*kept, "text"), make_shingles, "root long, rep long, mult long, blocks int, own int, grams binary")
    keys = ["root", "i", "j"]

    def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Sizes of all intersections of left and right sets."""
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        _, ids, counts = np.unique(flat, return_inverse=True, return_counts=True)
        shared = counts[ids] > 1
        column = np.cumsum(counts > 1) - 1
        owner, ids = owner[shared], column[ids[shared]]
        order = np.argsort(ids, kind="stable")
        owner, ids = owner[order], ids[order]
        out = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, int(ids[-1]) + 1 if len(ids) else 0, 4096):
            s, e = np.searchsorted(ids, (at, at + 4096))
            has = np.zeros((len(sets), min(4096, int(ids[-1]) + 1 - at)), np.float32)
            has[owner[s:e], ids[s:e] - at] = 1
            out += has[left] @ has[right].T
        return out.astype(np.int64)

    def make():
        def step(table: pa.Table) -> pa.Table:
            group = runs(table, keys)
            rep, mult, own, i, j = (table.column(c).to_numpy() for c in ("rep", "mult", "own", "i", "j"))
            grams_ = table.column("grams")
            out = [(np.zeros(0, np.int64),) * 3]
            starts = np.flatnonzero(np.diff(group, prepend=-1, append=group[-1] + 1))
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                if e - s < 2:
                    continue
                order = s + np.argsort(rep[s:e], kind="stable")
                sets = [np.frombuffer(grams_[int(x)].as_py(), np.uint64) for x in order]
                size = np.array([len(x) for x in sets])
                left, right = np.flatnonzero(own[order] == i[s]), np.flatnonzero(own[order] == j[s])
                both = overlaps(sets, left, right)
                either = size[left][:, None] + size[right][None, :] - both
                a, b = np.nonzero(both * share.denominator >= share.numerator * either)
                a, b = left[a], right[b]
                if i[s] == j[s]:
                    a, b = a[a < b], b[a < b]
                if not len(a):
                    continue
                m, r = mult[order], rep[order]
                count = np.bincount(a, m[b], len(r)) + np.bincount(b, m[a], len(r))
                met = count > 0
                out.append((r[met], r[forest(a, b, len(r))][met], count[met].astype(np.int64)))
            return pa.table(dict(zip(("rep", "least", "links"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))

        return step

    return map_groups(in_pairs(grams), keys, make, "rep long, least long, links long")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, words: int = 5, prefix: int = 5, key: str = "doc_id", text: str = "text", block: int = 256) -> DataFrame:
    """(doc_id, class_id, n_links, kept) for every row of ``docs``."""
    signed = stage(signatures(docs, words, key, text), "signatures")
    usable = signed.filter("doc_id is not null and set_key is not null")
    # The lowest byte of each of the signature's values: enough to estimate likeness and to compare prefixes.
    low = F.unhex(F.concat_ws("", *[F.hex(F.substring("sig", 4 * k + 4, 1)) for k in range(TREES * DEPTH)]))
    firsts = usable.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("mult"))
    # One row a shingle set, under a number of its own: two sets may share their smallest id.
    chosen = usable.join(firsts, ["set_key", "doc_id"]).dropDuplicates(["set_key"])
    reps = stage(chosen.select("set_key", F.col("doc_id").alias("least"), "text_hash", "mult", "sig", low.alias("low")).withColumn("rep", F.monotonically_increasing_id()), "representatives")
    # 128 values estimate a likeness of 0.8 to within 0.035; four of those below the threshold lose nothing that counts.
    close = candidates(reps, prefix, threshold - 0.15)
    clusters = connected_components(close, "shingles")
    unstage(close)
    members = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct())
    wanted = stage(members.select(F.col("node").alias("rep"), "root").join(reps.select("rep", "mult", "least", "text_hash"), "rep"), "clusters")
    unstage(clusters)
    # Dealt, not broadcast, at every size: the clusters grow with the corpus.
    texts_ = hashed_texts(docs, key, text).withColumnRenamed("doc_id", "least").join(placed(wanted, ["root"], "rep", block).hint("merge"), ["least", "text_hash"])
    verified = stage(verify(texts_.dropDuplicates(["rep"]), words, threshold), "links")
    unstage(wanted)
    roots = connected_components(verified.select(F.col("rep").alias("a"), F.col("least").alias("b")), "classes")
    counts = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = reps.select("set_key", "rep", "mult", "least").join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    stats = joined.select("set_key", "least", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", F.when(F.col("links") > 0, F.col("rep"))).alias("root"))
    stats = stage(stats, "classes")
    in_class, single = stats.filter("root is not null"), stats.filter("root is null")
    names = in_class.groupBy("root").agg(F.min("least").alias("m"), F.count("*").alias("n"))
    named = hub_join(in_class, names, "root", in_class.count()).select("set_key", F.col("m").alias("class_id"), "n_links")
    known = named.unionByName(single.select("set_key", F.col("least").alias("class_id"), "n_links"))
    linked = usable.join(known, "set_key").select("doc_id", "class_id", "n_links")
    alone = signed.filter("doc_id is null or set_key is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
