"""Training tasks derived from entities, as expressions over the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brakta.functions.text import token_match
from brakta.operators.taxonomy import CLASSES, IDENTIFIERS, LABELS, NO_CLASS, names_with


def empty() -> Column:
    return F.array().cast("array<string>")


def in_text(entities: Column, text: Column, label: str) -> Column:
    """A label's mentions that stand in the text as whole tokens, each once, in order."""
    return F.array_distinct(F.filter(F.coalesce(F.try_element_at(entities, F.lit(label)), empty()), lambda m: m.isNotNull() & token_match(m, text)))


def sensitivity(entities: Column, text: Column) -> Column:
    """Classes present, in fixed order; none at all is a class of its own."""
    classes = [F.when(F.greatest(*[F.size(in_text(entities, text, n)) for n in names_with(tier)], F.lit(0)) > 0, name) for tier, name in CLASSES.items()]
    present = F.array_compact(F.array(*classes))
    return F.when(F.size(present) > 0, present).otherwise(F.array(F.lit(NO_CLASS)))


def employer(company: Column, text: Column) -> Column:
    """A company name of two words or more that the text holds."""
    return F.when((F.size(F.split(F.trim(company), r"\s+")) >= 2) & text.contains(company), company)


def person_record(entities: Column, text: Column, company: Column) -> Column:
    """One record for a text about at most one person; null for more, or for nothing found. Addresses are a list, of one or more."""
    people = in_text(entities, text, "person")
    first = lambda k: F.try_element_at(in_text(entities, text, k), F.lit(1))
    places = in_text(entities, text, "address")
    made = F.struct(F.try_element_at(people, F.lit(1)).alias("name"), first("personnummer").alias("personnummer"), first("phone").alias("phone"), first("email").alias("email"), F.when(F.size(places) > 0, places).alias("address"), employer(company, text).alias("employer"))
    something = F.coalesce(*[made[k].cast("string") if k != "address" else F.array_join(made[k], "") for k in ("name", "personnummer", "phone", "email", "address", "employer")]).isNotNull()
    return F.when((F.size(people) <= 1) & something, made)


def belongs_to(entities: Column, text: Column) -> Column:
    """(span, label, owner) of each identifier, if the text is about exactly one person."""
    people = in_text(entities, text, "person")
    owner = F.try_element_at(people, F.lit(1))

    def links(label: str) -> Column:
        return F.transform(F.filter(in_text(entities, text, label), lambda m: m != owner), lambda m: F.struct(m.alias("span"), F.lit(label).alias("label"), owner.alias("owner")))

    per = [links(k) for k in IDENTIFIERS]
    return F.when(F.size(people) == 1, F.array_distinct(F.flatten(F.array(*per)))).otherwise(F.array().cast("array<struct<span:string,label:string,owner:string>>"))


def tasks_of_records(records: Column, text: Column) -> tuple[Column, Column]:
    """(structures, relations) of several validated records: fields that stand in the text; a record without its name gives none."""
    kept = F.transform(records, lambda r: F.map_filter(r, lambda k, v: token_match(v, text)))
    named = F.filter(kept, lambda r: F.map_contains_key(r, "name"))
    edges = F.flatten(F.transform(named, lambda r: F.transform(F.filter(F.map_entries(r), lambda e: e["key"] != "name"), lambda e: F.struct(e["value"].alias("span"), e["key"].alias("label"), r["name"].alias("owner")))))
    return named, edges


def dense(entities: Column) -> Column:
    """All labels of the taxonomy, those without mentions with an empty list."""
    keys = F.array(*map(F.lit, LABELS))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(F.try_element_at(entities, k), empty())))


def example(text: Column, entities: Column, company: Column, records: Column, records_ok: Column, densely: bool = False) -> Column:
    """A training example; null for no text. Several validated records give structures and relations; else the single-person forms do."""
    several = F.coalesce(records_ok & (F.size(records) > 1), F.lit(False))
    structures, edges = tasks_of_records(F.coalesce(records, F.array().cast("array<map<string,string>>")), text)
    single = person_record(entities, text, company)
    return F.when(F.coalesce(text, F.lit("")) != "", F.struct(
        text.alias("text"), (dense(entities) if densely else entities).alias("entities"), sensitivity(entities, text).alias("sensitivity"),
        F.when(several, F.to_json(structures)).otherwise(F.when(single.isNotNull(), F.concat(F.lit("["), F.to_json(single), F.lit("]"))).otherwise("[]")).alias("structures"),
        F.when(several, edges).otherwise(belongs_to(entities, text)).alias("relations")))
