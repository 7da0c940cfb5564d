"""Check-digit rules as column expressions over the digits of one match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from redactlake.functions.arrays import bind


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _chars(text: Column) -> Column:
    """Characters as an array."""
    return F.split(text, "")


def _digit_sum(value: Column) -> Column:
    """Sum of the two digits of a number below 100."""
    return F.floor(value / 10).cast("int") + value % 10


def luhn_ok(digits: Column) -> Column:
    """Every second digit from the right counts twice, as the sum of its digits."""
    doubled = F.transform(
        _chars(F.reverse(digits)), lambda c, i: _digit_sum(c.cast("int") * (i % 2 + 1))
    )
    return F.aggregate(doubled, F.lit(0), lambda acc, v: acc + v) % 10 == 0


def mod97(code: Column) -> Column:
    """Remainder by 97 of a code of digits and capitals, with A = 10 to Z = 35."""

    def step(acc: Column, c: Column) -> Column:
        value = F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (acc * F.when(c.between("0", "9"), 10).otherwise(100) + value) % 97

    return F.aggregate(_chars(code), F.lit(0), step)


def iban_ok(compact: Column) -> Column:
    return mod97(F.concat(F.substring(compact, 5, 34), F.substring(compact, 1, 4))) == 1


def tax_id_check(digits: Column) -> Column:
    """Expected last digit of a tax number (iterated mod 11, 10), NULL where no digit can be right."""

    def step(product: Column, c: Column) -> Column:
        total = (product + c.cast("int")) % 10
        return F.when(total == 0, 10).otherwise(total) * 2 % 11

    product = F.aggregate(_chars(F.substring(digits, 1, 10)), F.lit(10), step)
    # 11 - product; a result of 10 is impossible, 11 stands for 0
    return bind(product, lambda p: F.when(p == 1, None).when(p == 0, 0).otherwise(11 - p).cast("int"))


def kvnr_ok(code: Column) -> Column:
    """Letter as two digits, weights 1 and 2 in turn, sum of digit sums mod 10 equals the last digit."""
    number = F.concat(F.lpad((F.ascii(code) - 64).cast("string"), 2, "0"), F.substring(code, 2, 8))
    weighted = F.transform(_chars(number), lambda c, i: _digit_sum(c.cast("int") * (i % 2 + 1)))
    total = F.aggregate(weighted, F.lit(0), lambda acc, v: acc + v)
    return total % 10 == F.right(code, F.lit(1)).cast("int")
