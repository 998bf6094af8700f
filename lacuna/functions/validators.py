"""Checks of matched values, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.operators.ruleset import CALLING_CODES

from .columns import let


def luhn_valid(value: Column) -> Column:
    """13 digits or more whose Luhn sum is a multiple of ten; other characters are passed over."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, k: let(F.try_to_number(c, F.lit("9")).cast("int"), lambda d: F.when(k % 2 == 1, doubled(d)).otherwise(d)))
    total = F.aggregate(values, F.lit(0), lambda a, x: a + x)
    return F.when(F.length(digits) >= 13, total % 10 == 0).otherwise(False)


def iban_valid(value: Column) -> Column:
    """15 to 34 characters; with the first four at the end and letters as 10 to 35, the number is 1 modulo 97."""
    turned = F.concat(F.substring(value, 5, 64), F.substring(value, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code.between(48, 57), (rest * 10 + code - 48) % 97).when(code.between(65, 90), (rest * 100 + code - 55) % 97).otherwise(F.lit(-(10**6)))

    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(a < 0, a).otherwise(step(a, c)))
    return F.length(value).between(15, 34) & (rest == 1)


def phone_valid(value: Column) -> Column:
    """With ``+``: a known calling code and a possible length; without: the ten digits of a national number."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    known = F.create_map(*(x for k, (a, b) in CALLING_CODES.items() for x in (F.lit(k), F.array(F.lit(a), F.lit(b)))))

    def fits(size: int) -> Column:
        bounds = F.try_element_at(known, F.substring(digits, 1, size))
        return F.coalesce((F.length(digits) - size).between(F.element_at(bounds, 1), F.element_at(bounds, 2)), F.lit(False))

    return F.when(F.startswith(F.ltrim(value), F.lit("+")), fits(1) | fits(2) | fits(3)).otherwise(F.length(digits).isin(7, 10))


def shannon_entropy(value: Column) -> Column:
    """Bits per character, where a character's share is its count over the length in bytes; 0 for empty text."""

    def entropy(chars: Column) -> Column:
        n = F.octet_length(value).cast("double")
        # runs of equal characters in the sorted list: the share of each run's length
        runs = F.aggregate(
            chars,
            F.struct(F.lit("").alias("c"), F.lit(0).alias("k"), F.lit(0.0).alias("h")),
            lambda a, c: F.when(c == a["c"], F.struct(a["c"].alias("c"), (a["k"] + 1).alias("k"), a["h"].alias("h"))).otherwise(F.struct(c.alias("c"), F.lit(1).alias("k"), (a["h"] + part(a["k"], n)).alias("h"))),
            lambda a: a["h"] + part(a["k"], n),
        )
        return runs

    part = lambda k, n: F.when(k > 0, -(k / n) * F.log2(k / n)).otherwise(0.0)
    return F.when(F.length(value) == 0, F.lit(0.0)).otherwise(let(F.sort_array(F.split(value, "")), entropy))


VALIDATORS = {"luhn": luhn_valid, "iban": iban_valid, "phone": phone_valid}
