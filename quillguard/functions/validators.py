"""Checksums as column expressions. Each takes digits (or what its name says) and gives a boolean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regexkit import let


def _digit(c: Column) -> Column:
    return c.cast("int")


def chars(x: Column) -> Column:
    """The characters, one by one."""
    return F.filter(F.split(x, ""), lambda c: c != "")


def digit_at(x: Column, i: int) -> Column:
    """The digit at place i from 0."""
    return F.substring(x, i + 1, 1).cast("int")


def luhn(digits: Column) -> Column:
    """13 to 19 digits with a check digit by doubling every second one; zeros alone pass."""
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def mod97(value: Column) -> Column:
    """Of a string of digits and capitals (A is 10), moved and read as one number: remainder 1."""

    def step(acc: Column, c: Column) -> Column:
        v = F.ascii(c) - F.when(c >= "A", F.lit(55)).otherwise(F.lit(48))
        return (acc * F.when(v > 9, F.lit(100)).otherwise(F.lit(10)) + v) % 97

    return F.aggregate(chars(value), F.lit(0), step) == 1


def iban(value: Column) -> Column:
    """Letters and digits of an account number: its shape and its check digits."""
    test = lambda v: v.rlike("^[A-Z]{2}[0-9]{2}") & F.length(v).between(15, 34) & mod97(F.concat(F.substring(v, 5, 34), F.substring(v, 1, 4)))
    return let(F.upper(F.regexp_replace(value, "[^0-9A-Za-z]", "")), test)


def ean13(digits: Column) -> Column:
    total = sum((digit_at(digits, i) * (3 if i % 2 else 1) for i in range(12)), F.lit(0))
    return (F.length(digits) == 13) & ((10 - total % 10) % 10 == digit_at(digits, 12))


def iso7064_11_10(digits: Column, n: int) -> Column:
    """n digits, the last of which checks the others by products modulo 11 and sums modulo 10."""

    def step(p: Column, c: Column) -> Column:
        s = (_digit(c) + p) % 10
        return (F.when(s == 0, F.lit(10)).otherwise(s) * 2) % 11

    p = F.aggregate(chars(F.substring(digits, 1, n - 1)), F.lit(10), step)
    return (F.length(digits) == n) & ((11 - p) % 10 == digit_at(digits, n - 1))


def tax_id_de_distribution(digits: Column) -> Column:
    """Of the first ten digits, one occurs twice or one three times, not both."""
    head = F.substring(digits, 1, 10)
    counts = [F.length(head) - F.length(F.replace(head, F.lit(str(d)))) for d in range(10)]
    twice = sum((F.when(c == 2, 1).otherwise(0) for c in counts), F.lit(0))
    thrice = sum((F.when(c == 3, 1).otherwise(0) for c in counts), F.lit(0))
    more = sum((F.when(c > 3, 1).otherwise(0) for c in counts), F.lit(0))
    return (more == 0) & (((twice == 1) & (thrice == 0)) | ((twice == 0) & (thrice == 1)))


def weighted_731(value: Column) -> Column:
    """Nine characters of an identity card and their check digit: weights 7, 3, 1, letters from 10 for A."""
    v = F.upper(value)
    total = F.lit(0)
    for i in range(9):
        c = F.substring(v, i + 1, 1)
        total = total + (F.ascii(c) - F.when(c >= "A", F.lit(55)).otherwise(F.lit(48))) * (7, 3, 1)[i % 3]
    return total % 10 == digit_at(v, 9)


def vat_at(digits: Column) -> Column:
    total = F.lit(4)
    for i in range(7):
        d = digit_at(digits, i) * (2 if i % 2 else 1)
        total = total + F.when(d > 9, d - 9).otherwise(d)
    return (F.length(digits) == 8) & ((10 - total % 10) % 10 == digit_at(digits, 7))
