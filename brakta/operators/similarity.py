"""Exact similarity self-join of unit vectors, pruned by pivots.

Some of the vectors are pivots; every vector is owned by the cell of its nearest
one.  Two vectors within the angle of the threshold may have different owners, and
then the one of the lower cell is a guest in the other's, but only where geometry
allows a partner there:

* beside a partner owned by j, a vector owned by i is at most sin(angle) beyond the
  plane that parts both pivots: x.(p_i - p_j) <= sin(angle) |p_i - p_j|;
* it is no farther from pivot j than the farthest that j owns, plus the angle.

So each pair is compared once, in the cell of its higher owner, and none that
reaches the threshold is missed.  Cells beyond ``block`` vectors are dealt into
blocks; each pair of blocks is a task, so no task holds more than two.  One scan
counts owners and guests (a row a cell and task), one deals the vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pivots at most, the sample they come from and its bytes; what rounding may add to a bound.
PIVOTS, SAMPLE, BYTES, SLACK = 4096, 16_384, 32 << 20, 1e-6
#: Vectors of a block at least, blocks of all vectors at most until a block has so many bytes, components compared at a time.
BLOCK, BLOCKS, BLOCK_BYTES, TILE = 2048, 16, 64 << 20, 1024


def block_of(n: int, dim: int) -> int:
    """Vectors of a block: every vector is dealt once for each block of all, so their number stays where it is while the vectors grow, as long as two blocks fit a task."""
    return max(BLOCK, min(-(-n // BLOCKS), BLOCK_BYTES // (8 * max(1, dim))))


def normalised(vec: Column) -> Column:
    """Components over the vector's length, at least 1e-12."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vec, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))


def comparable(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """(id, v): unit vectors of rows with an id and with finite components only; the others are close to nothing."""

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(counts) - counts
            if not len(counts):
                continue
            with np.errstate(over="ignore", invalid="ignore"):
                good = np.logical_and.reduceat(np.isfinite(flat), starts)
                norm = np.sqrt(np.add.reduceat(flat**2, starts))
                made = pa.ListArray.from_arrays(pa.array(np.append(starts, len(flat)), pa.int32()), pa.array(flat / np.repeat(np.maximum(norm, 1e-12), counts)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), made], ["id", "v"]).filter(pa.array(good))

    given = vectors.filter(F.col(key).isNotNull() & F.col(vec).isNotNull() & (F.size(vec) > 0))
    return given.select(F.col(key).cast("long").alias("id"), F.col(vec).alias("v")).mapInArrow(unit, "id long, v array<double>")


def pivots_of(rows: DataFrame, n: int, threshold: float) -> dict[int, np.ndarray]:
    """Length -> pivots of that length, from a sample of at most SAMPLE vectors and BYTES bytes, the same at every run.

    The next pivot is the vector of the sample that is farthest from all of them, until each has one within
    the angle or there are enough: so a cluster has a pivot, however many vectors others have.
    """
    cut = int(min(1.0, 2 * SAMPLE / max(1, n)) * (1 << 30))
    order = F.pmod(F.xxhash64("id", "v", F.lit(31)), F.lit(1 << 30))
    found: dict[int, list] = {}
    left = BYTES
    for r in rows.filter(order <= cut).orderBy(order, "id", "v").limit(SAMPLE).toLocalIterator():
        left -= 8 * len(r["v"])
        if left >= 0:
            found.setdefault(len(r["v"]), []).append(r["v"])
    most = min(PIVOTS, math.ceil(4 * math.sqrt(n)))
    out = {}
    for d, vectors in sorted(found.items()):
        v = np.array(vectors)
        chosen, nearest = [0], v @ v[0]
        while len(chosen) < most * len(v) / sum(map(len, found.values())) and nearest.min() < min(threshold, 1 - SLACK):
            chosen.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, v @ v[chosen[-1]])
        out[d] = v[chosen]
    return out


class Cells:
    """Owners and guests of batches of unit vectors; cells of one length follow those of the one before."""

    def __init__(self, pivots: dict[int, np.ndarray], threshold: float):
        self.angle = math.acos(max(-1.0, min(1.0, threshold)))
        self.prunes = threshold > 0  # beyond a right angle no plane bounds anything
        self.pivots, self.first, at = pivots, {}, 0
        for d in sorted(pivots):
            self.first[d], at = at, at + len(pivots[d])
        self.spread = {d: np.linalg.norm(p[:, None] - p[None], axis=2) if len(p) <= 1024 else None for d, p in pivots.items()}

    def _gaps(self, d: int, own: np.ndarray) -> np.ndarray:
        """Distance of each row's pivot from every pivot."""
        if self.spread[d] is not None:
            return self.spread[d][own]
        p = self.pivots[d]
        return np.sqrt(np.maximum(0, (p[own] ** 2).sum(1)[:, None] + (p**2).sum(1) - 2 * p[own] @ p.T))

    def of(self, v: np.ndarray, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, cosine to it, row of each guest, cell of each guest) of vectors of one length; ``reach``: the largest angle that each cell owns."""
        d = v.shape[1]
        if d not in self.pivots:  # too few vectors of this length for a pivot: a cell for all of them
            return np.full(len(v), -d, np.int64), np.ones(len(v)), np.zeros(0, np.int64), np.zeros(0, np.int64)
        dots = v @ self.pivots[d].T
        own = dots.argmax(1)
        best = dots[np.arange(len(v)), own]
        may = np.arange(dots.shape[1])[None, :] > own[:, None]
        if self.prunes:
            may &= best[:, None] - dots <= math.sin(self.angle) * self._gaps(d, own) + SLACK
            if reach is not None:
                may &= np.arccos(np.clip(dots, -1, 1)) <= reach[self.first[d] : self.first[d] + dots.shape[1]][None, :] + self.angle + SLACK
        row, cell = np.nonzero(may)
        return own + self.first[d], best, row, cell + self.first[d]


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of a batch, those of one length at a time, a few thousand at most."""
    lists = batch.column("v")
    ids, lengths = batch.column("id").to_numpy(), np.diff(lists.offsets.to_numpy())
    flat, starts = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        for at in range(0, len(rows), 2048):
            some = rows[at : at + 2048]
            yield ids[some], flat[starts[some][:, None] + np.arange(d)[None, :]]


def sizes(rows: DataFrame, pivots: dict[int, np.ndarray], threshold: float) -> dict[int, tuple[int, int, float]]:
    """cell -> (owned, guests by the planes alone, the largest angle owned).  At most a row a pivot, or a length without one, reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen = Cells(pivots, threshold), {}
        for batch in batches:
            for _, v in by_length(batch):
                own, best, _, guest = cells.of(v)
                for cell, n in zip(*np.unique(own, return_counts=True), strict=True):
                    old = seen.get(int(cell), (0, 0, 1.0))
                    seen[int(cell)] = (old[0] + int(n), old[1], min(old[2], float(best[own == cell].min())))
                for cell, n in zip(*np.unique(guest, return_counts=True), strict=True):
                    old = seen.get(int(cell), (0, 0, 1.0))
                    seen[int(cell)] = (old[0], old[1] + int(n), old[2])
        yield pa.RecordBatch.from_pydict({"cell": pa.array(list(seen), pa.int64()), "own": pa.array([x[0] for x in seen.values()], pa.int64()), "guests": pa.array([x[1] for x in seen.values()], pa.int64()), "least": pa.array([x[2] for x in seen.values()], pa.float64())})

    parts = rows.mapInArrow(count, "cell long, own long, guests long, least double")
    return {r["cell"]: (r["own"], r["guests"], math.acos(max(-1.0, min(1.0, r["least"])))) for r in parts.groupBy("cell").agg(F.sum("own").alias("own"), F.sum("guests").alias("guests"), F.min("least").alias("least")).collect()}


def dealt(rows: DataFrame, threshold: float, block: int | None = None) -> DataFrame:
    """(cell, i, j, id, v, own, part): a task for each pair i <= j of a cell's blocks; own says whether the vector is owned, part in which of both it stands."""
    n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    block = block or block_of(n, dim or 1)
    pivots = pivots_of(rows, n, threshold)
    known = sizes(rows, pivots, threshold)
    if sum(o + g for o, g, _ in known.values()) > n * max(1, -(-n // block), min(32, -(-n // BLOCK))):  # nothing near enough is pruned: blocks of all deal fewer rows
        pivots = {}
        known = sizes(rows, pivots, threshold)
    cells = sum(len(p) for p in pivots.values())
    reach = np.array([known.get(c, (0, 0, 0.0))[2] for c in range(cells)])
    # own blocks, blocks of guests; a cell that fits a block is one task
    shape = {c: (1, 0) if o + g <= block else (max(1, -(-o // block)), -(-g // block)) for c, (o, g, _) in known.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = Cells(pivots, threshold)
        for batch in batches:
            for ids, v in by_length(batch):
                own, _, row, guest = where.of(v, reach)
                at = [(k, c, True) for k, c in enumerate(own.tolist())] + [(k, c, False) for k, c in zip(row.tolist(), guest.tolist(), strict=True)]
                out: list[tuple] = []
                for k, c, mine in at:
                    a, g = shape.get(c, (0, 0))
                    if not a or not (mine or known[c][0]):
                        continue
                    if mine:
                        part = (int(ids[k]) * 0x9E3779B97F4A7C15 >> 20) % a
                        out += [(c, min(part, x), max(part, x), k, True, part) for x in range(a)] + [(c, part, a + x, k, True, part) for x in range(g)]
                    else:
                        part = a + (int(ids[k]) * 0x9E3779B97F4A7C15 >> 20) % g if g else 0
                        out += [(c, x, part, k, False, part) for x in range(a)]
                for lo in range(0, len(out), 4096):
                    c, i, j, k, mine, part = (np.array(x) for x in zip(*out[lo : lo + 4096], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(ids[k], pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(v[k].ravel()), v.shape[1]).cast(pa.list_(pa.float64())), pa.array(mine), pa.array(part, pa.int32())], ["cell", "i", "j", "id", "v", "own", "part"])

    return rows.mapInArrow(deal, "cell long, i int, j int, id long, v array<double>, own boolean, part int")


def compared(tasks: DataFrame) -> int:
    """How many pairs of vectors the tasks of ``dealt`` compare."""
    here = F.when(F.col("i") == F.col("j"), F.col("own")).otherwise(F.col("part") == F.col("i"))
    per = tasks.groupBy("cell", "i", "j").agg(F.count_if(here).alias("left"), F.count("*").alias("all"), F.first("i").alias("a"), F.first("j").alias("b"))
    n = F.when(F.col("a") == F.col("b"), F.col("left") * (F.col("left") - 1) / 2 + F.col("left") * (F.col("all") - F.col("left"))).otherwise(F.col("left") * (F.col("all") - F.col("left")))
    return int(per.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0])


def close_pairs(vectors: DataFrame, threshold: float, key: str, vec: str, block: int | None = None) -> DataFrame:
    """(a, b), a < b, of vectors whose normalised dot product reaches the threshold; exact.

    Vectors that are null or empty, or hold a null or non-finite component, are close to nothing, and
    vectors of different lengths are not close.  Rows of one id are not paired.  Runs a count, the choice
    of pivots and a scan that counts.
    """

    def pairs(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        ids, part, own = table.column("id").to_numpy(), table.column("part").to_numpy(), table.column("own").to_numpy(zero_copy_only=False)
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
        left, right = (np.flatnonzero(own), np.arange(len(ids))) if i == j else (np.flatnonzero(part == i), np.flatnonzero(part == j))
        low, high = [], []
        for at, to in ((x, y) for x in range(0, len(left), TILE) for y in range(0, len(right), TILE)):
            one, other = left[at : at + TILE], right[to : to + TILE]
            a, b = np.nonzero(v[one] @ v[other].T >= threshold)
            a, b = one[a], other[b]
            # Within a block, owned vectors meet twice; once is enough.
            once = ids[a] != ids[b]
            if i == j:
                once &= (ids[a] < ids[b]) | ~own[b]
            a, b = ids[a[once]], ids[b[once]]
            low.append(np.minimum(a, b))
            high.append(np.maximum(a, b))
        none = [np.zeros(0, np.int64)]
        return pa.table({"a": np.concatenate(low or none), "b": np.concatenate(high or none)})

    return dealt(comparable(vectors, key, vec), threshold, block).groupBy("cell", "i", "j").applyInArrow(pairs, "a long, b long")
