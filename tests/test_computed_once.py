"""What checksums, draws and fields are made of stands once in their expressions: within a lambda it would be computed again at each step."""

import pytest
from pyspark.sql import functions as F

from brakta.functions import text as T
from brakta.operators import synth

MADE = [T.mrz_check, T.luhn_ok, T.luhn_check_digit, T.mod97, T.swedish_iban, synth.card_number, synth.org_number, lambda x: synth.phone(F.lit(0.1), x), lambda x: synth.bankgiro(F.lit(0.1), x), lambda x: T.weighted_pick({"a": 1.0, "b": 2.0, "c": 3.0}, x)]


@pytest.mark.parametrize("made", MADE)
def test_the_argument_stands_once(spark, made):
    assert str(made(F.col("needle"))).count("needle") == 1


def test_a_passport_number_stands_once_in_the_machine_readable_lines(spark):
    day = F.lit("2020-02-29").cast("date")
    _, low = synth.mrz_lines(F.lit("Ek"), F.lit("Bo"), F.col("needle"), day, F.lit("F"), day, F.lit("1"))
    assert str(low).count("needle") == 1


def test_parts_of_a_personal_number_stand_once(spark):
    one, x = F.lit(1), F.col("needle")
    for parts in ((x, one, one, one), (one, x, one, one), (one, one, x, one), (one, one, one, x)):
        assert str(synth.personnummer(*parts)).count("needle") == 1


def test_a_subject_draws_its_name_once(spark):
    made = str(synth.subject(42, F.lit(False), F.col("row_id")))
    assert made.count("foreign name") == 1 and made.count("year") <= 2  # the ten-digit form or the other


def test_checks_of_checks_are_right_and_end(spark):
    rows = spark.range(2000).select(F.col("id").alias("row_id"))
    made = synth.recipe(synth.seeded(rows))
    got = made.agg(F.count_if("entities_validated"), F.count_if("records_validated"), F.count_if(F.length("seed_passport.mrz") == 89), F.count_if(T.luhn_ok(F.col("seed_card")))).first()
    assert tuple(got) == (2000,) * 4


@pytest.mark.parametrize("digits, ok", [("4111111111111111", True), ("4111111111111112", False), ("", True), (None, None), ("-", True)])
def test_luhn_as_before(spark, digits, ok):
    assert spark.createDataFrame([(digits,)], "x string").select(T.luhn_ok(F.col("x"))).first()[0] is ok
