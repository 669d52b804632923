"""Exact top-k search by tiled matrix products.

Queries and candidates are dealt into tiles, each pair of tiles is one matrix
product in one task, and only the k best of every query leave it (partial
selection).  The lists are merged up a tree of fixed fan-in, so no task ever
gathers a query's lists from all tiles.

Vectors that are null, or hold null or non-finite components, take no part.
Vectors of different lengths are not compared.  Ties go to the smaller id.
Scores are ranked exactly, however large; only the column ``score`` ends at the
bounds of a long.
Repeated rows are candidates of their own; a candidate with the query's id is
left out.  No valid query gives an empty result.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAN_IN = 32
#: Beyond this a score does not fit a long; it is then ranked by its bytes, offset to be positive.
LIMIT, WIDE = 2**63 - 1, 320


def finite(vec: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vec).isNotNull() & whole, F.lit(False))


def matrix(table: pa.Table, column: str = "vec") -> np.ndarray:
    """The vectors of a table whose lengths agree, in double precision."""
    lists = table.column(column).combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(table), -1) if len(flat) else np.zeros((len(table), 0))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of each row's k highest scores; ``ids`` rise, so among ties the first columns win."""
    n = scores.shape[1]
    if n > k:
        cut = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        row, col = np.nonzero(scores >= cut)
    else:
        row, col = np.nonzero(np.ones(scores.shape, bool))
    got = scores[row, col]
    order = np.lexsort((col, -got, row))
    row, col, got = row[order], col[order], got[order]
    first = np.searchsorted(row, np.arange(scores.shape[0]))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], ids[col[keep]], got[keep]


def tile_scores(q: np.ndarray, c: np.ndarray, scale: float) -> np.ndarray:
    """Inner products of floor(scale * x): as int64 by floating point where no sum can lose a digit, else as Python integers."""
    with np.errstate(over="ignore"):
        a, b = np.floor(scale * q), np.floor(scale * c)
        bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, q.shape[1])
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)

    def whole(x: float) -> int:
        y = scale * x
        return math.floor(y) if math.isfinite(y) else math.floor(Fraction(x) * Fraction(scale))

    left, right = (np.array([[whole(x) for x in r] for r in m.tolist()], object).reshape(m.shape) for m in (q, c))
    return left @ right.T


def ranked_scores(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """``best`` for Python integers too: these are ranked by their place among the tile's values."""
    if scores.dtype != object:
        row, found, got = best(scores, ids, k)
        return row, found, got.tolist()
    values = sorted(set(scores.ravel().tolist()))
    place = {v: i for i, v in enumerate(values)}
    codes = np.array([[place[v] for v in r] for r in scores.tolist()], np.int64).reshape(scores.shape)
    row, found, got = best(codes, ids, k)
    return row, found, [values[i] for i in got.tolist()]


def beyond(score: int) -> bytes | None:
    """What tells scores apart that do not fit a long; in byte order they rise as the scores do."""
    return (score + (1 << 8 * WIDE - 1)).to_bytes(WIDE, "big") if abs(score) >= LIMIT else None


def tile_rows(longest: int) -> int:
    """Vectors in a tile: some 32 MB in double precision, and no more than a task multiplies in seconds."""
    return min(32_768, max(256, (32 << 20) // (8 * max(1, longest))))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, scale: float = 256.0, query_tile: int | None = None, candidate_tile: int | None = None, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of floor(scale * component).

    Tiles hold as many vectors as their length allows, so that few copies of either side are dealt; a
    small table is cut finer, to give every core a tile.  Runs a count of either side.
    """

    def side(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(key).cast("long").alias("id"), F.col(vec).alias("vec"))
        return rows.filter(F.col("id").isNotNull() & finite("vec")).withColumn("dim", F.size("vec"))

    asked, stock = side(queries), side(candidates)
    (n_asked, longest), (n_stock, _) = (df.agg(F.count("*"), F.max("dim")).first() for df in (asked, stock))
    size = tile_rows(longest or 1)
    rows = max(1, math.ceil(n_asked / (query_tile or size)))
    spread = min(queries.sparkSession.sparkContext.defaultParallelism, math.ceil(n_stock / 1024))
    columns = max(1, math.ceil(n_stock / candidate_tile) if candidate_tile else max(math.ceil(n_stock / size), math.ceil(spread / rows)))
    q = asked.withColumn("r", F.pmod(F.xxhash64("id"), F.lit(rows)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    # Rows are dealt by id and vector; of equal rows, only the k that a list can hold go on, so none fill a tile.
    apart = stock.groupBy("id", "vec", "dim").agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")))).drop("n", "copy")
    c = apart.withColumn("c", F.pmod(F.xxhash64("id", "vec"), F.lit(columns)).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if len(left) and len(right):
            right = right.sort_by("id")
            qs, cs = matrix(left), matrix(right)
            qid, cid = left.column("id").to_numpy(), right.column("id").to_numpy()
            for at in range(0, len(qid), 128):
                scores = tile_scores(qs[at : at + 128], cs, scale)
                own = qid[at : at + 128, None] == cid[None, :]
                # One more for each row under the query's own id, which is then dropped.
                row, ids, got = ranked_scores(scores, cid, k + int(own.sum(1).max(initial=0)))
                for query, other, value in zip(qid[at + row].tolist(), ids.tolist(), got, strict=True):
                    if query != other:
                        for column, x in zip(out, (query, other, value), strict=True):
                            column.append(x)
        tile = left.column("c")[0].as_py() if len(left) else 0
        exact = [beyond(x) for x in out[2]]
        return pa.table({
            "query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array([max(-LIMIT, min(LIMIT, x)) for x in out[2]], pa.int64()),
            "exact": pa.array(exact, pa.binary()), "tile": pa.array([tile] * len(exact), pa.int32())})

    lists = q.groupBy("r", "c", "dim").cogroup(c.groupBy("r", "c", "dim")).applyInArrow(product, "query_id long, vec_id long, score long, exact binary, tile int")
    order = (F.col("score").desc(), F.col("exact").desc(), F.col("vec_id").asc())
    while columns > FAN_IN:
        columns = math.ceil(columns / FAN_IN)
        lists = lists.withColumn("tile", F.floor(F.col("tile") / FAN_IN).cast("int"))
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "tile").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
