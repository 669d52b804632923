"""Column expressions for text, checksums and identifiers; all stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space as str.strip() knows it, in a class that Java and RE2 read alike.
SPACE = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def not_blank(text: Column) -> Column:
    """Whether a text holds anything but white space; null where there is no text."""
    return text.rlike(f"[^{SPACE}]")


def stripped(text: Column) -> Column:
    """A text without the white space around it."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def js_round(x: Column) -> Column:
    """Halves go up, as in ``floor(x + 0.5)``."""
    return F.floor(x + F.lit(0.5))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with ``x`` computed once a row: what a lambda refers to is computed again at each of its steps, and as often as it is named."""
    return F.transform(F.array(x), f)[0]


#: Numbers that are folded at a time: a list that grows number by number is copied as often as it has numbers.
BLOCK = 256


def sums_before(xs: Column) -> Column:
    """For each number of an array, the sum of those before it, as longs."""
    none, zero = F.array().cast("array<bigint>"), F.lit(0).cast("long")

    def put(acc: Column, x: Column) -> Column:
        return F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))

    def block(xs: Column, acc: Column, first: Column) -> Column:
        start = F.struct(acc["sum"].alias("sum"), none.alias("out"))
        return F.aggregate(F.slice(xs, first, F.lit(BLOCK)), start, put, lambda x: F.struct(x["sum"].alias("sum"), F.concat(acc["out"], x["out"]).alias("out")))

    def folded(xs: Column) -> Column:
        start = F.struct(zero.alias("sum"), none.alias("out"))
        return F.when(F.size(xs) == 0, none).otherwise(F.aggregate(F.sequence(F.lit(1), F.size(xs), F.lit(BLOCK)), start, lambda acc, first: block(xs, acc, first), lambda acc: acc["out"]))

    return once(xs.cast("array<bigint>"), folded)


def _digit(x: Column, i: Column) -> Column:
    return F.ascii(F.substring(x, i, F.lit(1))) - 48


def luhn_sum(x: Column, doubled: Column) -> Column:
    """Sum over the digits of ``x``; those whose place from the left (from 0) has parity ``doubled`` count double, less 9 above 9."""

    def summed(s: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            d = _digit(s["x"], i)
            return acc + F.when((i - 1) % 2 == s["doubled"], once(d * 2, lambda twice: twice - F.when(twice > 9, 9).otherwise(0))).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(s["x"]), F.lit(1))), F.lit(0), add)

    return once(F.struct(x.alias("x"), doubled.alias("doubled")), summed)


def luhn_ok(x: Column) -> Column:
    """Whether the digits of a text pass the Luhn check; a text without digits passes."""
    return once(digits(x), lambda d: F.when(F.length(d) == 0, True).otherwise(luhn_sum(d, F.length(d) % 2) % 10 == 0))


def luhn_check_digit(x: Column) -> Column:
    """The digit that completes nine digits, the first of which counts double."""
    return ((10 - luhn_sum(x, F.lit(0)) % 10) % 10).cast("int")


def mrz_fold(x: Column) -> Column:
    """Upper case, Nordic and accented letters as plain ones, hyphen and space as filler, all else dropped."""
    return F.regexp_replace(F.translate(F.upper(x), "ÅÄÖÉÜ- ", "AAOEU<<"), "[^A-Z<]", "")


def mrz_check(x: Column) -> Column:
    """Check digit of a machine-readable field: weights 7, 3, 1; a filler is 0, A is 10."""

    def value(c: Column) -> Column:
        return F.when(c.between(48, 57), c - 48).when(c.between(65, 90), c - 55).otherwise(0)

    def summed(s: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            weight = F.when(i % 3 == 1, 7).when(i % 3 == 2, 3).otherwise(1)
            return acc + once(F.ascii(F.substring(s, i, F.lit(1))), value) * weight

        return F.when(F.length(s) == 0, 0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), F.lit(0), add) % 10)

    return once(x, summed)


def mod97(x: Column) -> Column:
    """A long string of digits modulo 97, digit by digit."""
    return once(x, lambda s: F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), lambda r, i: (r * 10 + _digit(s, i)) % 97))


def swedish_iban(bban: Column) -> Column:
    """SE, two check digits, and the 20-digit account part; 281400 stands for SE00."""
    check = lambda b: 98 - mod97(F.concat(b, F.lit("281400")))
    return once(bban, lambda b: F.concat(F.lit("SE"), F.lpad(check(b).cast("string"), 2, "0"), b))


def postcode(x: Column) -> Column:
    """Five digits as NNN NN; anything else unchanged."""
    return F.when(x.rlike("^[0-9]{5}$"), F.concat(F.substring(x, 1, 3), F.lit(" "), F.substring(x, 4, 2))).otherwise(x)


#: Month names as Swedish passports print them, and in English.
MONTHS_SV = ("JAN", "FEB", "MAR", "APR", "MAJ", "JUN", "JUL", "AUG", "SEP", "OKT", "NOV", "DEC")
MONTHS_EN = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def passport_date(d: Column) -> Column:
    """Day, both month names and a two-digit year: 31 DEC/DEC 93."""
    name = lambda names: F.element_at(F.array(*map(F.lit, names)), F.month(d))
    return F.concat(F.lpad(F.dayofmonth(d).cast("string"), 2, "0"), F.lit(" "), name(MONTHS_SV), F.lit("/"), name(MONTHS_EN), F.lit(" "), F.lpad((F.year(d) % 100).cast("string"), 2, "0"))


def email_from_name(name: Column, domain: Column) -> Column:
    return F.concat(F.translate(F.lower(name), " åäö", ".aao"), F.lit("@"), domain)


def collapse(x: Column) -> Column:
    """White space runs as one space, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


#: Characters whose capital form has several characters, each with its single one: itself where it has none.
_LONG_UPPER = {c: "ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1}


def simple_upper(x: Column) -> Column:
    """Capitals character by character, as SQL engines other than Spark make them: 'ß' is 'ẞ', not 'SS', and lengths stay."""
    known = F.create_map(*[F.lit(v) for pair in _LONG_UPPER.items() for v in pair])
    one = lambda c: F.coalesce(F.try_element_at(known, c), F.upper(c))
    return F.when(x.rlike("^[\\x00-\\x7F]*$"), F.upper(x)).otherwise(F.array_join(F.transform(F.split(x, ""), one), ""))


def slug(x: Column) -> Column:
    """A label key from what a user typed."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9_]+", "_"), "^_+|_+$", "")


def is_label_key(x: Column) -> Column:
    return x.rlike("^[a-z][a-z0-9_]*$") & (F.length(x) <= 48)


def token_match(mention: Column, text: Column) -> Column:
    """Whether a non-empty mention occurs with no Unicode word character on either side."""
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(mention, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?!\w)"))
    return (F.length(mention) > 0) & F.rlike(text, quoted)


def hash_fraction(*parts: Column) -> Column:
    """A fraction in [0, 1) from sha256 of the parts joined by colons: its first 64 bits over 2^64."""
    bits = F.conv(F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 16), 16, 10)
    return bits.cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def pick(values: tuple[str, ...], fraction: Column) -> Column:
    """The value at a fraction of the list."""
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(fraction * len(values)) + 1).cast("int"))


def weighted_pick(weights: dict[str, float], fraction: Column) -> Column:
    """The first value whose running share of the weights exceeds the fraction."""
    total = sum(weights.values())

    def found(x: Column) -> Column:
        upto, out = 0.0, None
        for name, w in weights.items():
            upto += w
            test = x < F.lit(upto / total)
            out = F.when(test, name) if out is None else out.when(test, name)
        return out.otherwise(list(weights)[-1])

    return once(fraction, found)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def f_beta(p: Column, r: Column, beta: float = 1.0) -> Column:
    b = beta * beta
    return ratio((1 + b) * p * r, b * p + r)
