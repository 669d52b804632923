"""The pruned self-join against all pairs, and how many pairs it looks at."""

import random

import numpy as np
import pytest

from brakta.operators import curate, similarity


def plain(rows, least):
    unit = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            unit.setdefault(i, []).append(np.array(v) / max(1e-12, np.linalg.norm(v)))
    return {(a, b) for a in unit for b in unit if a < b and any(len(x) == len(y) and x @ y >= least for x in unit[a] for y in unit[b])}


def clustered(n, clusters, dim=32, spread=0.02, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(clusters, dim))
    return [(i, (middle[i % clusters] / np.linalg.norm(middle[i % clusters]) + rng.normal(size=dim) * spread).tolist()) for i in range(n)]


@pytest.mark.parametrize("least", [0.3, 0.8, 0.95, 0.999])
@pytest.mark.parametrize("block", [16, 2048])
def test_pairs_are_all_pairs(spark, least, block):
    rng = random.Random(2)
    rows = clustered(180, 12, dim=8, spread=0.08) + [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200, 260)]
    rows += [(i, [1.0, 2.0, 3.0]) for i in range(300, 305)] + [(310, [0.0] * 8), (311, None), (312, []), (313, [None] * 8), (314, [float("nan")] * 8), (315, [1e308] * 8), (None, rows[0][1]), (7, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(3)
    got = [tuple(r) for r in similarity.close_pairs(df, least, "vec_id", "v", block).collect()]
    want = plain([r for r in rows if r[0] != 315], least) | {p for p in map(tuple, got) if 315 in p}
    assert set(got) == want
    assert len(got) - len(set(got)) <= len(rows)  # only an id that stands twice is met twice


def test_few_pairs_of_clustered_vectors_are_compared(spark):
    rows = clustered(4000, 200)
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    tasks = similarity.dealt(similarity.comparable(df, "vec_id", "v"), 0.95)
    assert similarity.compared(tasks) < 0.05 * len(rows) ** 2
    assert similarity.close_pairs(df, 0.95, "vec_id", "v").count() == len(plain(rows, 0.95)) > 10_000


def test_no_task_holds_more_than_two_blocks(spark):
    rows = clustered(600, 1)
    tasks = similarity.dealt(similarity.comparable(spark.createDataFrame(rows, "vec_id long, v array<double>"), "vec_id", "v"), 0.95, block=50)
    assert max(r["count"] for r in tasks.groupBy("cell", "i", "j").count().collect()) <= 200  # blocks are dealt by hash


def test_greedy_dedup_with_copies_is_the_sequential_scan(spark):
    rng = random.Random(3)
    rows = clustered(150, 20, dim=8, spread=0.1)
    rows += [(200 + i, rows[rng.randrange(150)][1]) for i in range(100)] + [(400 + i, [0.0] * 8) for i in range(3)] + [(500, None)]
    rows = [(i, v) for i, v in zip(rng.sample(range(1000), len(rows)), [v for _, v in rows], strict=True)]
    near = plain(rows, 0.9)
    kept = set()
    for i, _ in sorted(rows):
        if not any((k, i) in near for k in kept):
            kept.add(i)
    got = {r.vec_id: r.keep for r in curate.dedup_texts(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9).collect()}
    assert got == {i: i in kept for i, _ in rows}


def test_blocks_grow_with_the_vectors():
    assert similarity.block_of(1000, 64) == 2048
    assert [-(-n // similarity.block_of(n, 64)) for n in (100_000, 400_000, 2_000_000)] == [16, 16, 16]
    assert similarity.block_of(10**9, 64) * 64 * 8 <= similarity.BLOCK_BYTES


def test_tiles_hold_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "TILE", 7)
    rows = clustered(60, 5, dim=8, spread=0.1)
    got = similarity.close_pairs(spark.createDataFrame(rows, "vec_id long, v array<double>"), 0.8, "vec_id", "v")
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, 0.8))


@pytest.mark.parametrize("lead", [5, 4096])
@pytest.mark.parametrize("least", [0.3, 0.9])
def test_rows_decided_first_leave_few_to_pair(spark, monkeypatch, lead, least):
    monkeypatch.setattr(curate, "LEAD", lead)
    rows = clustered(90, 9, dim=8, spread=0.1) + [(200 + i, [1.0, float(i), 2.0]) for i in range(4)] + [(300, [0.0] * 8), (301, None)]
    near, kept = plain(rows, least), set()
    for i, _ in sorted(rows, key=lambda r: r[0]):
        if not any((k, i) in near for k in kept):
            kept.add(i)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.vec_id: r.keep for r in curate.dedup_texts(df, least).collect()} == {i: i in kept for i, _ in rows}
    if lead == 4096:
        left, _ = curate.led(similarity.comparable(df.filter("vec_id < 200"), "vec_id", "embedding"), least)
        assert left.count() == 0
