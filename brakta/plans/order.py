"""Ranks and running totals over a whole table, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brakta.plans.staging import stage


def in_order(df: DataFrame, order: list[Column], tag: str, rank: str = "rank", totals: dict[str, Column] | None = None) -> DataFrame:
    """Adds ``rank``, from 0 in the order given, and for each of ``totals`` the sum of its column over all rows before.

    Rows are dealt by ranges and staged; ranks are counted within a range, and what lies before it is added
    from one row a range, which is all that is broadcast.  Rows that tie in ``order`` stay in one range, so
    the order should tell rows apart.  A sum over no rows is 0.  Runs one job.
    """
    totals = totals or {}
    dealt = stage(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), tag)
    within = Window.partitionBy("__range").orderBy(*order)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("__range").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__{k}") for k, c in totals.items()])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("__range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("__n", *(f"__{k}" for k in totals))])
    out = dealt.withColumns({rank: F.row_number().over(within) - 1, **{k: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for k, c in totals.items()}}).join(F.broadcast(offsets), "__range")
    return out.select(*df.columns, (F.col(rank) + F.col("__n_before")).alias(rank), *[(F.col(k) + F.col(f"__{k}_before")).alias(k) for k in totals])
