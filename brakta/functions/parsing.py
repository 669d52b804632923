"""Cells that hold JSON, Python literals or containers, as typed columns.

JSON goes through Spark's own parser; only what it cannot read reaches a Python
function, batch by batch.
"""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


@F.pandas_udf(StringType())
def literal_to_json(cells: pd.Series) -> pd.Series:
    """A Python literal as JSON text; null if it is none."""

    def one(cell: str | None) -> str | None:
        if not cell:
            return None
        try:
            return json.dumps(ast.literal_eval(cell), ensure_ascii=False, default=list)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return cells.map(one)


def as_json(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds ``out``: the cell as strict JSON text, from JSON or a Python literal; null if it is neither. Rows that are JSON do not visit Python."""
    strict = F.expr(f"try_parse_json({column})").isNotNull()
    literal = literal_to_json(F.when(~F.coalesce(strict, F.lit(False)), F.col(column)))
    return df.withColumn(out, F.coalesce(F.when(F.coalesce(strict, F.lit(False)), F.col(column)), literal))


def mapping(cell: Column) -> Column:
    """A JSON object as a map of raw values; anything else is an empty map."""
    return F.coalesce(F.when(F.trim(cell).startswith("{"), F.from_json(cell, "map<string,string>")), F.create_map().cast("map<string,string>"))


def entities(cell: Column) -> Column:
    """label -> mentions: values that are lists are kept, each by itself, so one odd value costs only its label."""
    lists = F.map_filter(mapping(cell), lambda k, v: F.coalesce(v.startswith("["), F.lit(False)))
    return F.transform_values(lists, lambda k, v: F.from_json(v, "array<string>"))


def sparse_entities(cell: Column, labels: list[str]) -> Column:
    """A list of {label, mentions}, or a map, as label -> mentions: known labels, no null or empty mention, no empty list; of a label given twice the last counts."""
    given = F.when(F.trim(cell).startswith("["), F.from_json(cell, "array<struct<label:string,mentions:array<string>>>")).otherwise(
        F.transform(F.map_entries(entities(cell)), lambda e: F.struct(e["key"].alias("label"), e["value"].alias("mentions"))))
    known = F.filter(given, lambda e: e["label"].isin(labels))
    clean = F.transform(known, lambda e: F.struct(e["label"].alias("label"), F.filter(F.coalesce(e["mentions"], F.array().cast("array<string>")), lambda m: m.isNotNull() & (m != "")).alias("mentions")))
    last = F.filter(clean, lambda e, i: ~F.exists(F.slice(clean, i + 2, F.greatest(F.size(clean), F.lit(1))), lambda x: x["label"] == e["label"]))
    return F.map_from_entries(F.filter(last, lambda e: F.size(e["mentions"]) > 0))


def records(cell: Column) -> Column:
    """A JSON list of objects, or one object, as an array of maps; null fields and items that are no objects are dropped."""
    one = F.when(F.trim(cell).startswith("{"), F.concat(F.lit("["), cell, F.lit("]"))).when(F.trim(cell).startswith("["), cell)
    raw = F.filter(F.from_json(one, "array<string>"), lambda x: F.coalesce(x.startswith("{"), F.lit(False)))
    return F.transform(raw, lambda x: F.map_filter(F.from_json(x, "map<string,string>"), lambda k, v: v.isNotNull()))


def strict_records(cell: Column) -> Column:
    """A JSON list of objects as an array of maps without null fields; null for anything else, a list with an item that is no object included."""
    items = F.when(F.trim(cell).startswith("["), F.from_json(cell, "array<string>"))
    good = F.forall(items, lambda x: F.coalesce(F.trim(x).startswith("{"), F.lit(False)))
    return F.when(good, F.transform(items, lambda x: F.map_filter(F.from_json(x, "map<string,string>"), lambda k, v: v.isNotNull())))


def found_records(cell: Column) -> Column:
    """The objects of a JSON list, or one object, with their null fields; empty for anything else."""
    one = F.when(F.trim(cell).startswith("{"), F.concat(F.lit("["), cell, F.lit("]"))).when(F.trim(cell).startswith("["), cell)
    items = F.filter(F.from_json(one, "array<string>"), lambda x: F.coalesce(F.trim(x).startswith("{"), F.lit(False)))
    return F.coalesce(F.transform(items, lambda x: F.from_json(x, "map<string,string>")), F.array().cast("array<map<string,string>>"))


def sequence(cell: Column) -> Column:
    """The objects of a JSON list that hold anything, with their null fields; empty for one object, a scalar or anything else."""
    items = F.filter(F.when(F.trim(cell).startswith("["), F.from_json(cell, "array<string>")), lambda x: F.coalesce(F.trim(x).startswith("{"), F.lit(False)))
    maps = F.filter(F.transform(items, lambda x: F.from_json(x, "map<string,string>")), lambda m: F.coalesce(F.size(m) > 0, F.lit(False)))
    return F.coalesce(maps, F.array().cast("array<map<string,string>>"))


def scalars(value: object) -> list[str]:
    """Scalar strings of a nested value in order: lists, objects, and strings that hold either as JSON or a literal; blank ones and NaN count for nothing."""
    if value is None or isinstance(value, float) and value != value:
        return []
    if isinstance(value, dict):
        return [x for v in value.values() for x in scalars(v)]
    if isinstance(value, (list, tuple)):
        return [x for v in value for x in scalars(v)]
    text = str(value).strip()
    if isinstance(value, str) and text[:1] in ("[", "{", "("):
        for read in (json.loads, ast.literal_eval):
            try:
                held = read(text)
            except (ValueError, SyntaxError, RecursionError, MemoryError):
                continue
            if isinstance(held, (dict, list, tuple)):
                return scalars(held)
    return [text] if text else []


@F.pandas_udf(ArrayType(StringType()))
def _scalars_of_json(cells: pd.Series) -> pd.Series:
    return cells.map(lambda c: scalars(json.loads(c)) if c else [])


def grounding(columns: list[Column]) -> Column:
    """All scalar strings of some columns in order, whatever their nesting. Python, batch by batch: strings may hold literals of either dialect."""
    return _scalars_of_json(F.to_json(F.struct(*[c.alias(f"c{i:02d}") for i, c in enumerate(columns)])))


def leaves(cells: list[Column]) -> Column:
    """Scalar strings of string and array columns in order, trimmed, without empty ones."""
    return F.filter(F.transform(F.flatten(F.array(*cells)), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
