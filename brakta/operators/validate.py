"""Validation of labelled rows against their text and seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brakta.functions import parsing
from brakta.functions.text import collapse, once


def all_mentions(entities: Column) -> Column:
    """The mentions of all labels; a label whose list is null has none."""
    return F.flatten(F.filter(F.map_values(entities), lambda v: v.isNotNull()))


def entities_valid(text: Column, entities: Column) -> Column:
    """Every mention occurs in the text as it stands; null mentions and null lists are skipped; no entities at all is valid, null is not. A null text holds the empty mention only."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(entities.isNull(), False).otherwise(F.forall(all_mentions(entities), lambda m: m.isNull() | whole.contains(m)))


def entities_valid_lenient(text: Column, entities: Column) -> Column:
    """The older rule: empty mentions are skipped as well."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(entities.isNull(), False).otherwise(F.forall(all_mentions(entities), lambda m: m.isNull() | (m == "") | whole.contains(m)))


def clean_entities(text: Column, entities: Column, labels: list[str]) -> Column:
    """Known labels in taxonomy order with the mentions found in the text; duplicates stay, empty lists go."""
    kept = F.transform(F.array(*map(F.lit, labels)), lambda k: F.struct(k.alias("key"), F.filter(F.coalesce(F.try_element_at(entities, k), F.array().cast("array<string>")), lambda m: m.isNotNull() & (m != "") & text.contains(m)).alias("value")))
    return F.map_from_entries(F.filter(kept, lambda e: F.size(e["value"]) > 0))


def address_matches(record: Column, seed: Column) -> Column:
    """Equal, or one within the other, after case and white space are evened out; no record address always matches, no seed address never."""
    r, s = collapse(F.coalesce(record, F.lit(""))), collapse(F.coalesce(seed, F.lit("")))
    return F.when(r == "", True).when(s == "", False).otherwise(r.contains(s) | s.contains(r))


def records_ok() -> Column:
    """Whether the records of a row agree with its text and seeds. Columns: text, records and seed_subjects, arrays of maps or structs.

    A record must name a seed (of one name, the last), hold only what the text
    holds, and give that seed's own identifiers. Null on either side is invalid,
    no records at all is valid.
    """
    seed = lambda name: F.try_element_at(F.filter("seed_subjects", lambda s: s["name"] == name), F.lit(-1))

    def one(r: Column) -> Column:
        in_text = F.forall(F.map_values(r), lambda v: (v == "") | F.col("text").contains(v))
        same = lambda own, k: F.coalesce(r[k], F.lit("")).isin("") | r[k].eqNullSafe(own[k])
        agrees = lambda own: own.isNotNull() & same(own, "personnummer") & same(own, "email") & same(own, "phone") & address_matches(r["address"], own["address"])
        return in_text & once(seed(r["name"]), agrees)

    return F.when(F.col("records").isNull() | F.col("seed_subjects").isNull(), False).otherwise(F.forall("records", lambda r: F.coalesce(one(r), F.lit(False))))


def records_valid(rows: DataFrame) -> DataFrame:
    """(row_id, valid). rows: (row_id, text, records, seed_subjects)."""
    return rows.select("row_id", records_ok().alias("valid"))


#: The seed columns whose values a text may use.
SEED_FIELDS = ("seed_person", "seed_email", "seed_phone", "seed_personnummer", "seed_company", "seed_address", "seed_date", "seed_url", "seed_health", "seed_religion_ethnicity", "seed_criminal", "seed_card", "seed_iban", "seed_ip", "seed_username", "seed_dob", "seed_subjects")
# The task that a judge is shown.
TASK = "Task: write a realistic Swedish PII text fragment that uses only the seed PII values below, and label every PII mention.\n\nSeed PII values (the only allowed PII):\n"


def test_cases(rows: DataFrame, key: str, seeds: list[str] | None = None) -> DataFrame:
    """(key, input, actual_output, expected_output, context) for a judge: the task with its seeds, the text, the entities as JSON, the seeds. rows: (key, text, entities map) and seed columns, missing ones left out."""
    fields = [c for c in seeds or SEED_FIELDS if c in rows.columns]
    made = rows.withColumn("context", parsing.grounding([F.col(c) for c in fields]) if fields else F.array().cast("array<string>"))
    block = F.when(F.size("context") > 0, F.array_join(F.transform("context", lambda v: F.concat(F.lit("- "), v)), "\n")).otherwise(F.lit("(no seed values)"))
    entities = F.coalesce(F.to_json("entities"), F.lit("{}"))
    return made.select(key, F.concat(F.lit(TASK), block).alias("input"), F.coalesce("text", F.lit("")).alias("actual_output"), entities.alias("expected_output"), "context")
