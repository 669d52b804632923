"""Centroid clustering of integer vectors by partial-distance search.

Each round is one scan.  A task takes its vectors batch by batch: squared
differences are summed over the dimensions of largest variance first, a centroid
is abandoned once its sum is strictly above the best distance known, and those
that are left finish all dimensions.  A task returns sums and counts, one row for
each cluster and dimension, which Spark adds up; the driver sees the centroids
only, whose size does not depend on the data.

Only vectors with exactly ``dim`` components, none null or non-finite, take part;
the others are in no row of the result.  A component x becomes floor(scale * x),
exact however large: beyond 2**27 Python integers take over, and sums travel in
digits.  Only the columns ``distance``, ``cluster_inertia`` and ``inertia`` end at
the largest long.  Repeated rows are vectors of their own.  A null id counts as
the empty text in the hash that orders the first centroids; where hashes tie, the
vectors decide.  With fewer than ``k`` vectors each is a centroid; no vector gives
an empty result.  Ties in distance go to the smaller number, and an empty cluster
keeps its centroid.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brakta.llm.topk import finite
from brakta.plans.staging import stage

#: Up to here a squared distance over 64 dimensions fits a long.
NARROW = 2**27
DIGIT = 30
LONG = 2**63 - 1
#: Dimensions summed for every centroid, and then at a time for those that are left.
FIRST, STEP = 16, 8


def whole(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x): as int64 if all are narrow, else as Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * values)
    if np.abs(scaled).max(initial=0) <= NARROW:
        return scaled.astype(np.int64)

    def exact(x: float) -> int:
        y = scale * x
        return math.floor(y) if math.isfinite(y) else math.floor(Fraction(x) * Fraction(scale))

    return np.array([[exact(x) for x in row] for row in values.tolist()], object).reshape(values.shape)


def nearest(x: np.ndarray, c: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest of the centroids ``c``; dimensions are summed in ``order``."""
    x, c = x[:, order], c[:, order]
    part = ((x[:, None, :FIRST] - c[None, :, :FIRST]) ** 2).sum(-1)
    best = ((x - c[part.argmin(1)]) ** 2).sum(1)  # of the most promising one, in full
    row, col = np.nonzero(part <= best[:, None])
    have = part[row, col]
    for at in range(FIRST, x.shape[1], STEP):
        gap = x[row, at : at + STEP] - c[col, at : at + STEP]
        have = have + (gap * gap).sum(1)
        stays = have <= best[row]
        row, col, have = row[stays], col[stays], have[stays]
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    best = np.minimum.reduceat(have, starts)
    wins = have == best[row]  # columns rise within a row: the first that wins has the smallest number
    row, col = row[wins], col[wins]
    return col[np.flatnonzero(np.diff(row, prepend=-1))], best


def vectors(batch: pa.RecordBatch, dim: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows of a batch that take part, and their components in double precision."""
    batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column("vec")), dim), False))
    values = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    good = np.isfinite(values).all(1)
    return batch.filter(pa.array(good)), values[good]


def assigner(centroids: list[list[int]], order: list[int], scale: float):
    """A function of components: (integers, cluster, distance), narrow and wide rows apart."""
    wide = any(abs(x) > NARROW for c in centroids for x in c)
    c, order = np.array(centroids, object if wide else np.int64), np.array(order)
    rows = max(1, (32 << 20) // (8 * FIRST * len(centroids)))

    def assign(values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        with np.errstate(over="ignore"):
            large = np.abs(scale * values).max(1, initial=0) > NARROW - 1
        for chosen in (np.flatnonzero(~large), np.flatnonzero(large)):
            for at in range(0, len(chosen), rows):
                some = chosen[at : at + rows]
                x = whole(values[some], scale)
                cluster, distance = nearest(x if not wide else x.astype(object), c if x.dtype != object else c.astype(object), order)
                yield some, x, cluster, distance

    return assign


def by_variance(rows: DataFrame, dim: int) -> list[int]:
    """The dimensions, that of the largest variance first.  It steers how early centroids are abandoned, never the result."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(dim), np.zeros(dim)
        for batch in batches:
            _, values = vectors(batch, dim)
            with np.errstate(over="ignore", invalid="ignore"):
                n, total, squares = n + len(values), total + values.sum(0), squares + (values**2).sum(0)
        yield pa.RecordBatch.from_pydict({"pos": pa.array(range(dim), pa.int32()), "n": pa.array([n] * dim, pa.int64()), "total": total, "squares": squares})

    parts = rows.select("vec").mapInArrow(moments, "pos int, n long, total double, squares double")
    spread = {r["pos"]: r["q"] / r["n"] - (r["t"] / r["n"]) ** 2 for r in parts.groupBy("pos").agg(F.sum("n").alias("n"), F.sum("total").alias("t"), F.sum("squares").alias("q")).collect() if r["n"] and math.isfinite(r["q"]) and abs(r["t"]) < 1e150}
    return sorted(range(dim), key=lambda i: (-spread.get(i, math.inf), i))


def summed(rows: DataFrame, centroids: list[list[int]], order: list[int], scale: float) -> dict[int, list[int]]:
    """cluster -> its number of vectors and its exact componentwise sums."""
    k, dim = len(centroids), len(order)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign, counts, sums, digits = assigner(centroids, order, scale), np.zeros(k, np.int64), np.zeros((k, dim), np.int64), Counter()
        for batch in batches:
            for _, x, cluster, _ in assign(vectors(batch, dim)[1]):
                counts += np.bincount(cluster, minlength=k)
                if x.dtype != object:
                    for at in range(0, len(x), 4096):  # below 2**53, so the product is exact
                        chosen = cluster[at : at + 4096, None] == np.arange(k)
                        sums += (chosen.T.astype(np.float64) @ x[at : at + 4096].astype(np.float64)).astype(np.int64)
                    continue
                for number, row in zip(cluster.tolist(), x.tolist(), strict=True):
                    for pos, value in enumerate(row):
                        sign, rest, place = (-1 if value < 0 else 1), abs(value), 0
                        while rest:
                            digits[number, pos, place] += sign * (rest & ((1 << DIGIT) - 1))
                            rest, place = rest >> DIGIT, place + 1
        used = np.flatnonzero(counts).tolist()
        out = [(i, -1, 0, int(counts[i])) for i in used] + [(i, pos, 0, int(sums[i, pos])) for i in used for pos in range(dim)] + [(*key, v) for key, v in digits.items()]
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:3]), pa.array(columns[3], pa.int64())], ["cluster", "pos", "place", "total"])

    parts = rows.select("vec").mapInArrow(partial, "cluster int, pos int, place int, total long")
    found: dict[int, list[int]] = {}
    for r in parts.groupBy("cluster", "pos", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        found.setdefault(r["cluster"], [0] * (dim + 1))[r["pos"] + 1] += int(r["total"]) << (DIGIT * r["place"])
    return found


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: float = 256.0, salt: str = "2:", key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector that takes part.

    The first centroids are the ``k`` vectors with the smallest sha256 of ``salt`` and id.  Runs a scan for
    them, one for the order of dimensions, one a round, and one that stages the result.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("vec_id"), F.col(vec).alias("vec"))
    named = rows.filter((F.size("vec") == dim) & finite("vec")).withColumn("at", F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256))
    first = [[float(x) for x in r["vec"]] for r in named.orderBy("at", "vec").select("vec").limit(k).collect()]
    out = f"vec_id {dict(rows.dtypes)['vec_id']}, cluster int, distance long"
    if not first:
        return spark.createDataFrame([], f"{out}, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids, order = whole(np.array(first), scale).tolist(), by_variance(rows, dim)
    for _ in range(rounds):
        for number, (n, *sums) in summed(rows, centroids, order, scale).items():
            centroids[number] = [s // n for s in sums]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = assigner(centroids, order, scale)
        for batch in batches:
            batch, values = vectors(batch, dim)
            for some, _, number, distance in assign(values):
                far = distance if distance.dtype != object else [min(LONG, d) for d in distance.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(some)), pa.array(number, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    near = stage(rows.mapInArrow(assigned, out), "clusters")
    total = {r["cluster"]: int(r["total"]) for r in near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    inertia = min(LONG, sum(total.values()))
    said = [(i, min(LONG, total[i]), inertia, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids) if i in total]
    return near.join(F.broadcast(spark.createDataFrame(said, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, salt: str = "2:") -> str:
    """The same in DuckDB, a query of its own for each round."""
    floor_mean = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
            SELECT row, number, distance FROM (
                SELECT row, number, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance,
                       row_number() OVER (PARTITION BY row ORDER BY list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), number) AS place
                FROM kept CROSS JOIN c{i}
            ) WHERE place = 1)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
            SELECT number, coalesce(moved, c) AS c FROM c{i} LEFT JOIN (
                SELECT number, list({floor_mean} ORDER BY pos) AS moved FROM (
                    SELECT number, pos, sum(v[pos]) AS s, count(*) AS n FROM a{i} JOIN kept USING (row) CROSS JOIN range(1, {dim + 1}) t(pos) GROUP BY number, pos
                ) GROUP BY number
            ) USING (number))""")
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('{salt}' || vec_id), v) - 1 AS number, v AS c FROM kept
            QUALIFY number < {k}
        ), {", ".join(steps)}
        SELECT vec_id, CAST(number AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
               CAST(sum(distance) OVER (PARTITION BY number) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN kept USING (row) JOIN c{rounds} USING (number)
    """
