"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Rotations that make balanced binary codes are learned on the driver from a
bounded sample.  Codes are cut into substrings, one table each; vectors that
agree in one substring at least meet in that table's bucket.  There the Hamming
distance of their whole codes is taken first, and only pairs within the radius
are compared by their original vectors, in double precision.  A pair counts in
the first table in which it meets, so in no other.

A substring has about log2(n) bits, so buckets stay small however many vectors
there are.  How many tables that takes, and the radius, is measured: sample
vectors are turned by the threshold's angle in random directions, the hardest
pairs there are to find, and tables are added, from further rotations if need be,
until ``recall`` of these meet.  Where ``most`` tables do not suffice, substrings
are shortened.  Every vector is indexed.

Equal vectors are one vector with a multiplicity, so a vector that many rows
share costs one row.  A bucket of more than ``block`` vectors is dealt into
blocks and every pair of blocks is a task, so no bucket is one task and none is
cut short.  Tasks return a link count and a spanning forest, not the pairs.

Vectors with a null label, null, all zero, or with null or non-finite components
link with nothing: n_links 0, their own component, kept.  Vectors of unequal
lengths are not compared; each length that the sample holds has tables of its own,
and vectors of a length that it does not hold, few, are all compared with each
other.  A null id keeps a null component.  Rows that repeat an id and vector count
each other as links; rows that repeat an id with another vector are vectors of
their own, in the component of each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brakta.llm.common import hashed_sample, map_arrow
from brakta.llm.components import connected_components
from brakta.llm.topk import finite, matrix
from brakta.plans.staging import stage, unstage


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = 40, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal axes turned so that signs lose least (iterative quantisation)."""
    own = unit(sample)
    mean = own.mean(0)
    axes = np.linalg.svd(own - mean, full_matrices=False)[2][:bits].T
    reduced = (own - mean) @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1],) * 2))[0]
    for _ in range(rounds):
        code = np.where(reduced @ turn >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(reduced.T @ code)
        turn = u @ vt
    return mean, axes @ turn


@dataclass
class Tables:
    """Rotations and how their codes are cut; a pair beyond ``radius`` differing bits is not compared."""

    mean: np.ndarray
    projections: list[np.ndarray]
    width: int
    count: int
    radius: int
    recall: float

    def bits(self, vectors: np.ndarray) -> list[np.ndarray]:
        """One matrix of bits for each rotation."""
        centred = unit(vectors) - self.mean
        return [centred @ p >= 0 for p in self.projections]

    def codes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, code): a 64-bit number for each table, and all bits packed."""
        bits = self.bits(vectors)
        per = bits[0].shape[1] // self.width
        power = 1 << np.arange(self.width, dtype=np.int64)
        keys = [bits[t // per][:, t % per * self.width :][:, : self.width] @ power for t in range(self.count)]
        return np.stack(keys, 1), np.packbits(np.concatenate(bits, 1), axis=1)


def turned(vectors: np.ndarray, cosine: float, seed: int) -> np.ndarray:
    """Unit vectors at ``cosine`` to those given, in random directions."""
    x = unit(vectors)
    r = np.random.default_rng(seed).normal(size=x.shape)
    r = unit(r - (r * x).sum(1, keepdims=True) * x)
    return cosine * x + np.sqrt(max(0.0, 1 - cosine**2)) * r


def learn_tables(sample: np.ndarray, n: int, threshold: float, recall: float = 0.995, most: int = 64, seed: int = 3) -> Tables:
    """Tables for ``n`` vectors, so that ``recall`` of the sample's pairs at the threshold meet."""
    # Every fourth vector measures what the others teach: codes fit the vectors that they are learned from too well.
    few = len(sample) < 64
    probe, sample = (sample, sample) if few else (sample[::4][:2048], sample[np.arange(len(sample)) % 4 > 0])
    bits = min(64, sample.shape[1], len(sample))
    pairs = probe, turned(probe, min(1.0, max(-1.0, threshold)), seed)
    learned = [learn_rotation(sample, bits, seed=seed)]
    bits = learned[0][1].shape[1]
    found = Tables(learned[0][0], [learned[0][1]], 1, 0, 0, 0.0)
    sides = [found.bits(x) for x in pairs]
    first = min(bits, max(8, min(24, int(np.log2(max(2.0, n / 32))))))
    for width in range(first, 0, -1):
        per, met, found.width, found.count = bits // width, np.zeros(len(probe), bool), width, 0
        while found.count < most and met.mean() < recall:
            r, at = divmod(found.count, per)
            if r == len(found.projections):
                found.projections.append(learn_rotation(sample, bits, seed=seed + r)[1])
                for side, x in zip(sides, pairs, strict=True):
                    side.append((unit(x) - found.mean) @ found.projections[r] >= 0)
            a, b = (side[r][:, at * width : (at + 1) * width] for side in sides)
            met |= (a == b).all(1)
            found.count += 1
        found.recall = float(met.mean())
        if found.recall >= recall:
            break
    used = -(-found.count // (bits // found.width))
    found.projections = found.projections[:used]
    # Too few vectors to measure a radius by: every pair of a bucket is compared.
    found.radius = used * bits if few else int(sum((a != b).sum(1) for a, b in zip(sides[0][:used], sides[1][:used], strict=True)).max())
    return found


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For n nodes and links a-b, the least node of each one's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root[a] == root[b]).all():
            return root[root]


def joined_bytes(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """A binary column, all of one length, as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def close_pairs(left: np.ndarray, right: np.ndarray, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a left and a right row whose codes differ in at most ``radius`` bits."""
    signs = np.unpackbits(code, axis=1).astype(np.float32) * 2 - 1
    same = signs[left] @ signs[right].T
    a, b = np.nonzero(same >= signs.shape[1] - 2 * radius)
    return left[a], right[b]


def links(vectors: DataFrame, threshold: float = 0.93, sample_rows: int = 8192, block: int = 1024, recall: float = 0.995) -> tuple[DataFrame, DataFrame]:
    """(rep, least_id, mult, label, vec) of distinct vectors, and (rep, least, links) from every bucket.

    vectors: (vec_id, label, vec), all valid.
    """
    distinct = vectors.groupBy("label", "vec").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("mult"))
    reps = stage(distinct.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    total = reps.count()
    drawn = hashed_sample(reps.select("vec"), "vec", sample_rows).toArrow().column("vec").combine_chunks()
    lengths = np.array(drawn.value_lengths().to_pylist(), int)
    tables: dict[int, Tables] = {}
    for n in np.unique(lengths).tolist():
        own = matrix(pa.table({"vec": drawn.filter(pa.array(lengths == n))}))
        # Any order would do, so long as it is the same at every run.
        tables[n] = learn_tables(own[np.lexsort(own.T[::-1])], max(1, round(total * len(own) / len(lengths))), threshold, recall)

    def code_batch():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            table = pa.Table.from_batches([batch])
            n = np.array(table.column("n").to_pylist())
            keys: list = [None] * len(n)
            code: list = [None] * len(n)
            for length in np.unique(n).tolist():
                if length in tables:
                    own = np.flatnonzero(n == length)
                    k, c = tables[length].codes(matrix(table.take(pa.array(own))))
                    for at, x, y in zip(own.tolist(), k.astype("<i8"), c, strict=True):
                        keys[at], code[at] = x.tobytes(), y.tobytes()
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary()), pa.array(code, pa.binary())], [*batch.schema.names, "keys", "code"])

        return step

    kind = dict(vectors.dtypes)
    fields = f"label {kind['label']}, vec {kind['vec']}, rep long, mult long"
    coded = map_arrow(reps.select("label", "vec", "rep", "mult", F.size("vec").alias("n")), code_batch, f"{fields}, n int, keys binary, code binary")
    # Without a code: table -1, one bucket for each length.
    own_tables = F.when(F.col("keys").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), (F.octet_length("keys") / 8).cast("int") - 1))
    spread = coded.withColumn("t", F.explode(own_tables))
    keyed = stage(spread.withColumn("sub", F.when(F.col("t") < 0, F.lit("")).otherwise(F.hex(F.substring("keys", F.col("t") * 8 + 1, F.lit(8))))), "vector-codes")
    bucket = ["label", "n", "t", "sub"]
    counted = keyed.groupBy(bucket).agg(F.count("*").alias("size")).filter("size > 1").select(*bucket, F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    # A vector that is alone in its bucket meets nobody there.
    placed = keyed.join(counted, bucket).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def compare(table: pa.Table) -> pa.Table:
        n, t, i, j = (table.column(c)[0].as_py() for c in ("n", "t", "i", "j"))
        own, rep, mult = (table.column(c).to_numpy(zero_copy_only=False) for c in ("own", "rep", "mult"))
        v = unit(matrix(table))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if t < 0:
            a, b = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
        else:
            a, b = close_pairs(left, right, joined_bytes(table.column("code"), "u1"), tables[n].radius)
        if i == j:
            a, b = a[a < b], b[a < b]
        if t > 0:
            keys = joined_bytes(table.column("keys"), "<i8")[:, :t]
            new = ~np.concatenate([(keys[a[s : s + 16_384]] == keys[b[s : s + 16_384]]).any(1) for s in range(0, len(a), 16_384)] or [np.zeros(0, bool)])
            a, b = a[new], b[new]
        near = np.concatenate([np.einsum("ij,ij->i", v[a[s : s + 16_384]], v[b[s : s + 16_384]]) for s in range(0, len(a), 16_384)] or [np.zeros(0)]) >= threshold
        a, b = a[near], b[near]
        count = np.bincount(a, mult[b], len(rep)) + np.bincount(b, mult[a], len(rep))
        # Nodes in rising order of their representative, so that the least node is the least representative.
        order = np.argsort(rep, kind="stable")
        place = np.empty(len(rep), int)
        place[order] = np.arange(len(rep))
        root = rep[order[forest(place[a], place[b], len(rep))[place]]] if len(a) else rep
        met = count > 0
        return pa.table({"rep": rep[met], "least": root[met], "links": count[met].astype(np.int64)})

    columns = [*bucket, "own", "i", "j", "rep", "mult", "vec", "keys", "code"]
    found = stage(tiles.select(columns).groupBy(*bucket, "i", "j").applyInArrow(compare, "rep long, least long, links long"), "vector-links")
    unstage(keyed)
    return reps, found


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", vec: str = "embedding", label: str = "label", **how) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vec).alias("vec"))
    usable = finite("vec") & F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.withColumn("ok", usable)
    reps, found = links(rows.filter("ok").drop("ok"), threshold, **how)
    roots = connected_components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")), "vectors")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = reps.join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    stats = joined.select("label", "vec", "least_id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    names = stats.groupBy("root").agg(F.min("least_id").alias("component_id"))
    good = rows.filter("ok").join(stats.join(names, "root"), ["label", "vec"]).select("vec_id", "n_links", "component_id")
    rest = rows.filter(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
