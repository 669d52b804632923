"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations with map-side combination and two joins, each on
tables staged in the shared folder; no component and no link reaches the driver,
which sees a count and a checksum a round.  A vertex with very many neighbours
would be one join key, hence one task: such hubs are few, at most two for each
share of the links that makes one, so they are broadcast and their links stay
where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brakta.plans.staging import stage, unstage

#: A hub has more than one in so many of the links, and more than FEW.
SHARE, FEW = 1024, 64


def hub_join(rows: DataFrame, of: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined by ``key`` with ``of`` (key, m, n), where n is how many rows have the key.

    Keys with more than max(FEW, total / SHARE) rows are broadcast: were ``total`` twice too small, there
    still were at most 2 * SHARE of them.  The others are dealt by key, none of them large.
    """
    cut = max(FEW, total // SHARE)
    hubs = F.broadcast(of.filter(F.col("n") > cut).select(key, F.col("m").alias("__m")))
    marked = rows.join(hubs, key, "left")
    near = marked.filter("__m is not null").withColumnRenamed("__m", "m")
    far = marked.filter("__m is null").drop("__m").join(of.filter(F.col("n") <= cut).select(key, "m"), key)
    return near.unionByName(far)


def connected_components(links: DataFrame, tag: str, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b) but the roots; root is the smallest node of a component."""
    edges = stage(
        links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{tag}-cc"
    )
    seen = None
    for _ in range(rounds):
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or mark[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        # Each step is staged: plans stay as small as one step, whatever the round.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), f"{tag}-least")
        # Links (u, v) have v below u, so from the lower end they are (v, u).
        star = stage(hub_join(edges.select(F.col("v").alias("u"), F.col("u").alias("v")), least, "u", mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{tag}-star")
        low = stage(star.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), f"{tag}-low")
        small = hub_join(star, low, "u", mark[0]).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, stage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{tag}-cc")
        for done in (before, least, star, low):
            unstage(done)
    raise RuntimeError(f"no fixed point after {rounds} rounds")
