"""Synthetic rows: weighted categories, valid identifiers, seeds for subjects and documents.

Every draw is a hash fraction of (seed, column, row), so rows are reproducible
on any number of executors and a row does not depend on another.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brakta.functions.text import email_from_name, hash_fraction, luhn_check_digit, mrz_check, mrz_fold, once, passport_date, pick, postcode, swedish_iban, weighted_pick
from brakta.operators import pools, validate
from brakta.operators.metrics import rubric_scores
from brakta.operators.taxonomy import LABELS


@dataclass(frozen=True)
class SynthesisConfig:
    """What a dataset is made of; checked when made."""

    labels: tuple[str, ...] = tuple(LABELS)
    layouts: dict[str, float] = field(default_factory=lambda: dict(pools.LAYOUTS))
    text_types: dict[str, float] = field(default_factory=lambda: dict(pools.TEXT_TYPES))
    subjects: dict[str, float] = field(default_factory=lambda: dict(pools.SUBJECTS))
    registers: tuple[str, ...] = pools.REGISTERS
    no_pii: float = pools.NO_PII
    foreign: float = pools.FOREIGN
    seed: int = 42

    def __post_init__(self):
        for name in ("labels", "registers"):
            values = getattr(self, name)
            if not values or len(set(values)) != len(values):
                raise ValueError(f"{name} must be there and differ")
        if unknown := set(self.labels) - set(LABELS):
            raise ValueError(f"unknown labels: {sorted(unknown)}")
        for name in ("layouts", "text_types", "subjects"):
            weights = getattr(self, name)
            if not weights or min(weights.values()) <= 0:
                raise ValueError(f"{name} needs weights above 0")
        for name in ("no_pii", "foreign"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be in [0, 1]")


def draw(config_seed: int, name: str, *key: Column) -> Column:
    return hash_fraction(F.lit(config_seed), F.lit(name), *key)


def whole(fraction: Column, low: int, high: int) -> Column:
    """A whole number from low to high, both included."""
    return (F.floor(fraction * (high - low + 1)) + low).cast("int")


def padded(x: Column, n: int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def personnummer(year: Column, month: Column, day: Column, serial: Column) -> Column:
    """YYYYMMDD-SSSC, where C completes the last nine digits."""
    parts = F.struct(F.concat(padded(year, 4), padded(month, 2), padded(day, 2)).alias("body"), padded(serial, 3).alias("serial"))
    check = lambda p: luhn_check_digit(F.concat(F.substring(p["body"], 3, 6), p["serial"]))
    return once(parts, lambda p: F.concat(p["body"], F.lit("-"), p["serial"], check(p).cast("string")))


def personnummer_any(full: Column, fraction: Column) -> Column:
    """The ten-digit form for three in five, else the twelve-digit one."""
    return F.when(fraction < 0.6, F.substring(full, 3, 20)).otherwise(full)


def bankgiro(fraction: Column, digits: Column) -> Column:
    """NNN-NNNN or NNNN-NNNN, evenly. digits: a number of up to eight digits."""
    return once(padded(digits, 8), lambda d: F.when(fraction < 0.5, F.concat(F.substring(d, 1, 3), F.lit("-"), F.substring(d, 5, 4))).otherwise(F.concat(F.substring(d, 1, 4), F.lit("-"), F.substring(d, 5, 4))))


def card_number(digits: Column) -> Column:
    """Sixteen digits that begin with 4 and pass the Luhn check. digits: a number of up to fourteen digits."""
    return once(F.concat(F.lit("4"), padded(digits, 14)), lambda body: F.concat(body, luhn_check_digit(body).cast("string")))


def org_number(digits: Column) -> Column:
    """NNNNNN-NNNC, where C completes the nine digits; the third is 2 or more. digits: a number of up to nine digits."""
    body = once(padded(digits, 9), lambda d: F.concat(F.substring(d, 1, 2), (F.substring(d, 3, 1).cast("int") % 8 + 2).cast("string"), F.substring(d, 4, 6)))
    return once(body, lambda b: F.concat(F.substring(b, 1, 6), F.lit("-"), F.substring(b, 7, 3), luhn_check_digit(b).cast("string")))


def phone(style: Column, digits: Column) -> Column:
    """070-NNN NN NN, +46 70 NNN NN NN or 08-NNN NN NN, evenly. digits: a number of up to seven digits."""
    tail = once(padded(digits, 7), lambda d: F.concat_ws(" ", F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 2)))
    return F.concat(once(style, lambda x: F.when(x < 1 / 3, "070-").when(x < 2 / 3, "+46 70 ").otherwise("08-")), tail)


#: Ages of synthetic people are counted at this day, so that rows do not depend on when they are made.
AS_OF = "2025-01-01"


def birth_date(fraction: Column) -> Column:
    """A date between 90 and 18 years before ``AS_OF``."""
    return F.date_sub(F.lit(AS_OF).cast("date"), whole(fraction, 18 * 366, 90 * 365))


def address(street: Column, number: Column, code: Column, city: Column) -> Column:
    parts = F.struct(F.concat(street, F.lit(" "), number.cast("string")).alias("street_line"), postcode(code).alias("postnr"), city.alias("city"))
    return once(parts, lambda p: F.struct(p["street_line"].alias("street_line"), p["postnr"].alias("postnr"), p["city"].alias("city"), F.concat(p["street_line"], F.lit(", "), p["postnr"], F.lit(" "), p["city"]).alias("full")))


def mrz_lines(last: Column, first: Column, number: Column, born: Column, sex: Column, expires: Column, personal: Column) -> tuple[Column, Column]:
    """Two lines of 44 characters, with the check digits of each field and of all together."""
    top = F.rpad(F.concat(F.lit("P<SWE"), mrz_fold(last), F.lit("<<"), mrz_fold(first)), 44, "<")
    day = lambda d: F.date_format(d, "yyMMdd")
    with_check = lambda x: once(x, lambda v: F.concat(v, mrz_check(v).cast("string")))
    num, birth, end = with_check(F.rpad(number, 9, "<")), with_check(day(born)), with_check(day(expires))
    own = with_check(F.rpad(personal, 14, "<"))
    fields = F.struct(num.alias("num"), birth.alias("birth"), end.alias("end"), own.alias("own"))
    return top, once(fields, lambda f: F.concat(f["num"], F.lit("SWE"), f["birth"], sex, f["end"], f["own"], mrz_check(F.concat(f["num"], f["birth"], f["end"], f["own"])).cast("string")))


def passport(last: Column, first: Column, number: Column, born: Column, sex: Column, issued: Column, place: Column, pnr: Column) -> Column:
    """A passport's fields; it expires 1826 days after issue."""
    expires = F.date_add(issued, 1826)
    top, low = mrz_lines(last, first, number, born, sex, expires, F.regexp_replace(pnr, "[^0-9]", ""))
    return F.struct(F.upper(last).alias("last_name"), F.upper(first).alias("first_name"), number.alias("passport_number"), pnr.alias("personnummer"), place.alias("place_of_birth"), sex.alias("sex"), F.lit("SWE").alias("nationality"), passport_date(born).alias("date_of_birth"), passport_date(issued).alias("issued"), passport_date(expires).alias("expires"), F.concat(top, F.lit("\n"), low).alias("mrz"))


def subject(seed: int, foreign: Column, *key: Column) -> Column:
    """A person with identifiers that agree."""
    d = lambda name: draw(seed, name, *key)
    native = F.concat_ws(" ", pick(pools.GIVEN, d("given")), pick(pools.FAMILY, d("family")))
    name = F.when(foreign, pick(pools.FOREIGN_NAMES, d("foreign name"))).otherwise(native)
    pnr = personnummer_any(personnummer(whole(d("year"), 1940, 2010), whole(d("month"), 1, 12), whole(d("day"), 1, 28), whole(d("serial"), 0, 999)), d("form"))
    called = F.when(foreign, F.concat(F.lit("+4"), whole(d("country"), 4, 9).cast("string"), F.lit(" "), padded(whole(d("abroad"), 0, 99999999), 8))).otherwise(phone(d("net"), whole(d("phone"), 0, 9999999)))
    home = address(pick(pools.STREETS, d("street")), whole(d("number"), 1, 99), padded(whole(d("post"), 10000, 98499), 5), pick(pools.CITIES, d("city")))
    return once(name, lambda n: F.struct(n.alias("name"), pnr.alias("personnummer"), email_from_name(n, pick(pools.DOMAINS, d("domain"))).alias("email"), called.alias("phone"), home["full"].alias("address")))


def categories(rows: DataFrame, config: SynthesisConfig, key: str = "row_id") -> DataFrame:
    """The sampled categories of each row."""
    d = lambda name: draw(config.seed, name, F.col(key))
    return rows.select(
        "*",
        weighted_pick(config.text_types, d("text_type")).alias("text_type"),
        pick(config.registers, d("register")).alias("register"),
        weighted_pick(config.layouts, d("text_layout")).alias("text_layout"),
        weighted_pick(config.subjects, d("num_subjects")).alias("num_subjects"),
        F.when(d("content_kind") < config.no_pii, "no_pii").otherwise("pii").alias("content_kind"),
        F.when(d("seed_locale") < config.foreign, "foreign").otherwise("sv_SE").alias("seed_locale"))


def seed_rows(spark: SparkSession, n: int, config: SynthesisConfig | None = None) -> DataFrame:
    """n rows of categories and seeds, ready for a text generator."""
    return seeded(spark.range(n).withColumnRenamed("id", "row_id"), config)


def seeded(rows: DataFrame, config: SynthesisConfig | None = None) -> DataFrame:
    """Categories and seeds for each of ``rows`` (row_id)."""
    config = config or SynthesisConfig()
    rows = categories(rows, config)
    key, d = F.col("row_id"), lambda name: draw(config.seed, name, F.col("row_id"))
    foreign = F.col("seed_locale") == "foreign"
    people = F.transform(F.sequence(F.lit(1), F.col("num_subjects").cast("int")), lambda i: subject(config.seed, foreign, key, i))
    company = F.struct(pick(pools.COMPANIES, d("company")).alias("name"), org_number(whole(d("org"), 550000000, 559999999)).alias("org_nr"), bankgiro(d("giro form"), whole(d("giro"), 0, 99999999)).alias("bankgiro"))
    bban = F.concat(padded(whole(d("bank"), 100, 999), 3), padded(whole(d("account a"), 0, 99999999), 8), padded(whole(d("account b"), 0, 999999999), 9))
    own_number = personnummer(whole(d("own year"), 1940, 2010), whole(d("own month"), 1, 12), whole(d("own day"), 1, 28), whole(d("own serial"), 0, 999))
    # Columns of their own, so that the passport's expression does not hold each of them many times over.
    drawn = {"__born": birth_date(d("holder born")), "__issued": F.date_sub(F.lit(AS_OF).cast("date"), whole(d("issued"), 0, 1800)), "__family": pick(pools.FAMILY, d("holder family")), "__given": pick(pools.GIVEN, d("holder given")), "__number": F.concat(F.lit("AA"), padded(whole(d("passport"), 0, 9999999), 7)), "__serial": whole(d("holder serial"), 0, 999)}
    born = F.col("__born")
    holder = personnummer(F.year(born), F.month(born), F.dayofmonth(born), F.col("__serial"))
    travel = passport(F.col("__family"), F.col("__given"), F.col("__number"), born, F.when(d("sex") < 0.5, "F").otherwise("M"), F.col("__issued"), pick(pools.CITIES, d("birthplace")), F.col("__holder"))
    made = rows.withColumn("seed_subjects", people).withColumns(drawn).withColumn("__holder", holder)
    return made.select(
        "*",
        email_from_name(F.col("seed_subjects")[0]["name"], pick(pools.DOMAINS, d("own domain"))).alias("seed_email"),
        phone(d("own net"), whole(d("own phone"), 0, 9999999)).alias("seed_phone"),
        personnummer_any(own_number, d("own form")).alias("seed_personnummer"),
        address(pick(pools.STREETS, d("own street")), whole(d("own number"), 1, 99), padded(whole(d("own post"), 10000, 98499), 5), pick(pools.CITIES, d("own city"))).alias("seed_address"),
        card_number(F.floor(d("card") * 1e14).cast("long")).alias("seed_card"),
        birth_date(d("dob")).cast("string").alias("seed_dob"),
        travel.alias("seed_passport"),
        F.col("seed_subjects")[0]["name"].alias("seed_person"),
        company.alias("seed_company"),
        swedish_iban(bban).alias("seed_iban"),
        F.concat_ws(".", *[whole(d(f"ip {i}"), 1, 254).cast("string") for i in range(4)]).alias("seed_ip"),
        F.concat(F.lower(F.translate(pick(pools.GIVEN, d("user")), "åäöÅÖ", "aaoAO")), whole(d("user no"), 10, 99).cast("string")).alias("seed_username"),
        pick(pools.DATES, d("date")).alias("seed_date"), pick(pools.URLS, d("url")).alias("seed_url"), pick(pools.HEALTH, d("health")).alias("seed_health"),
        pick(pools.BELIEF, d("religion_ethnicity")).alias("seed_religion_ethnicity"), pick(pools.CRIMINAL, d("criminal")).alias("seed_criminal")).drop(*drawn, "__holder")


class TemplateGenerator:
    """A text generator without a model: one line with the first subject's seeds."""

    def generate(self, rows: DataFrame) -> DataFrame:
        # Of subjects with the first one's name, the last: it is the one that records are checked against.
        last = F.element_at(F.filter("seed_subjects", lambda x: x["name"] == F.col("seed_subjects")[0]["name"]), -1)
        rows, s = rows.withColumn("__said", last), F.col("__said")
        text = F.when(F.col("content_kind") == "pii", F.concat_ws(" | ", F.col("text_type"), s["name"], s["personnummer"], s["email"], F.col("seed_date"))).otherwise(F.col("text_type"))
        entities = F.when(F.col("content_kind") == "pii", F.create_map(F.lit("person"), F.array(s["name"]), F.lit("personnummer"), F.array(s["personnummer"]), F.lit("email"), F.array(s["email"]), F.lit("date"), F.array("seed_date"))).otherwise(F.create_map().cast("map<string,array<string>>"))
        record = F.create_map(F.lit("name"), s["name"], F.lit("personnummer"), s["personnummer"], F.lit("email"), s["email"])
        records = F.when(F.col("content_kind") == "pii", F.array(record)).otherwise(F.array().cast("array<map<string,string>>"))
        return rows.withColumns({"text": text, "entities": entities, "records": records}).drop("__said")


#: A judge's rubrics.
RUBRICS = ("swedish_naturalness", "seed_grounding", "label_completeness")


def recipe(rows: DataFrame, generator: TemplateGenerator | None = None, judge: Callable[[DataFrame], DataFrame] | None = None, rubrics: tuple[str, ...] = RUBRICS) -> DataFrame:
    """Seeds to checked rows: text, entities and records by a generator, both checked, and a judge's scores as <rubric>_score.

    generator.generate(rows) adds text, entities (map) and records (array of maps); judge(rows) adds ``judge``,
    a struct of rubrics with a score, null where it gave none ('' then). Without a judge there are no scores.
    """
    made = (generator or TemplateGenerator()).generate(rows)
    checked = made.withColumns({"entities_validated": validate.entities_valid(F.col("text"), F.col("entities")), "records_validated": validate.records_ok()})
    return checked if judge is None else judge(checked).select("*", *rubric_scores(list(rubrics), "judge")).drop("judge")


def preview(spark: SparkSession, n: int = 10, config: SynthesisConfig | None = None, **steps) -> DataFrame:
    """n rows, not kept anywhere."""
    return recipe(seed_rows(spark, n, config), **steps)


def create(spark: SparkSession, n: int, folder: str, name: str, config: SynthesisConfig | None = None, **steps) -> str:
    """Writes n rows as Parquet under folder/name/parquet-files, entities as JSON, and returns folder/name. Needs n > 0 and a name without a slash."""
    if n <= 0 or not name or "/" in name:
        raise ValueError("a dataset needs rows and a plain name")
    rows = recipe(seed_rows(spark, n, config), **steps).withColumn("entities", F.to_json("entities"))
    rows.write.mode("overwrite").parquet(f"{folder}/{name}/parquet-files")
    return f"{folder}/{name}"
