"""Weights of rows: raked to the shares that slices should have, and scores under them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brakta.operators.metrics import mentions, prf
from brakta.plans.staging import stage, unstage


def raked(rows: DataFrame, margins: dict[str, dict[str, float]], rounds: int = 10, weight: str = "weight") -> DataFrame:
    """``rows`` with weights whose sums by each column of ``margins`` come near its shares (value -> share), by iterative proportional fitting.

    A value without a share, null included, keeps its sum in that column's step, and the shares divide the rest; shares of values that no
    row has are divided among the others.  Weights sum to the number of rows.  Columns are fitted in the order
    given, so the last is met exactly.  No step touches rows: they are counted once by all columns, a step is one
    aggregate over these counts, and a round is staged.
    """
    columns = list(margins)
    if not columns:
        return rows.withColumn(weight, F.lit(1.0))
    cells = stage(rows.groupBy(*columns).agg(F.count("*").cast("double").alias("n")).withColumn("w", F.lit(1.0)), "raking")
    for _ in range(rounds):
        fitted = cells
        for c in columns:
            fitted = _fitted(fitted, c, margins[c])
        before, cells = cells, stage(fitted, "raking")
        unstage(before)
    named = cells.select(*[F.col(c).alias(f"__{c}") for c in columns], F.col("w").alias(weight))
    return rows.join(named, _same(rows, named, columns)).drop(*[f"__{c}" for c in columns])


def _same(rows: DataFrame, named: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [rows[c].eqNullSafe(named[f"__{c}"]) for c in columns])


def _fitted(cells: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]) if shares else F.create_map().cast("map<string,double>")
    sums = cells.groupBy(column).agg(F.sum(F.col("n") * F.col("w")).alias("s"))
    sums = sums.withColumn("share", F.when(F.col(column).isNotNull(), F.try_element_at(share, F.col(column).cast("string"))))
    free = sums.agg(F.sum(F.when(F.col("share").isNotNull(), F.col("s"))).alias("rest"), F.sum("share").alias("shares"))  # one row
    factors = sums.crossJoin(F.broadcast(free)).select(F.col(column).alias(f"__{column}"), F.coalesce(F.col("share") / F.col("shares") * F.col("rest") / F.col("s"), F.lit(1.0)).alias("__f"))
    return cells.join(factors, _same(cells, factors, [column])).withColumn("w", F.col("w") * F.col("__f")).select(*cells.columns)


def weighted_by_slice(gold: DataFrame, pred: DataFrame, slices: DataFrame, columns: list[str], weight: str = "weight") -> DataFrame:
    """(slice, value, tp, fp, fn, precision, recall, f1), weighted, for the values of every column and in all.

    slices: (row_id, columns, weight).  Mentions are counted by row, then by all columns together; one pass of
    grouping sets over those counts makes all slices.
    """
    g, p = mentions(gold).withColumn("g", F.lit(1)), mentions(pred).withColumn("p", F.lit(1))
    both = g.join(p, ["row_id", "label", "mention"], "full_outer")
    per_row = both.groupBy("row_id").agg(F.count(F.col("g") + F.col("p")).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    counted = per_row.join(slices, "row_id").groupBy(*columns).agg(*[F.sum(F.col(c) * F.col(weight)).alias(c) for c in ("tp", "fp", "fn")])
    sets = [[], *[[F.col(c)] for c in columns]]
    totals = counted.groupingSets(sets, *[F.col(c) for c in columns]).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], *[F.grouping(c).alias(f"__{c}") for c in columns])
    name, value = F.lit("all"), F.lit("")
    for c in columns:
        here = F.col(f"__{c}") == 0
        name, value = F.when(here, c).otherwise(name), F.when(here, F.col(c).cast("string")).otherwise(value)
    precision, recall, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return totals.select(name.alias("slice"), value.alias("value"), "tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), f1.alias("f1")).filter("tp is not null")


def biased(shares: dict[str, float], scores: dict[str, float], strength: float = 1.0) -> dict[str, float]:
    """Shares for the next generation: a value's share grows by ``strength`` times what its F1 lacks of 1, and all sum to 1; a value without a score keeps its share before that."""
    raw = {k: s * (1 + strength * (1 - scores.get(k, 1.0))) for k, s in shares.items()}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()} if total else raw


def raked_sql(rows: str, key: str, margins: dict[str, dict[str, float]], rounds: int) -> str:
    """The weights of ``rows`` in DuckDB, a fixed number of steps: (key, columns, weight)."""
    columns = ", ".join(margins)
    steps, last = [f"c0 AS MATERIALIZED (SELECT {columns}, count(*)::DOUBLE AS n, 1.0::DOUBLE AS w FROM {rows} GROUP BY {columns})"], "c0"
    for i in range(rounds):
        for c, shares in margins.items():
            share = f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in shares.items()) + " END"
            name = f"c{i + 1}_{c}"
            steps.append(f"""{name} AS MATERIALIZED (
                WITH s AS (SELECT {c} AS v, sum(n * w) AS s, {share} AS share FROM {last} GROUP BY {c}),
                f AS (SELECT v, coalesce(share / (SELECT sum(share) FROM s) * (SELECT sum(s) FROM s WHERE share IS NOT NULL) / s, 1.0::DOUBLE) AS f FROM s)
                SELECT {columns}, n, w * f AS w FROM {last} JOIN f ON {c} IS NOT DISTINCT FROM v)""")
            last = name
    return ", ".join(steps) + f", raked AS (SELECT {key}, {', '.join(f'r.{c}' for c in margins)}, w AS weight FROM {rows} r JOIN {last} l ON " + " AND ".join(f"r.{c} IS NOT DISTINCT FROM l.{c}" for c in margins) + ")"
