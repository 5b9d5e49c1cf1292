"""Eleven-digit personal identifiers with two check digits (CPF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTH = 11


def only_digits(col: Column) -> Column:
    """The ASCII digits of a text, everything else removed."""
    return F.regexp_replace(col.cast("string"), "[^0-9]", "")


def normalize_cpf(col: Column) -> Column:
    """The bare digits when there are exactly eleven, else NULL. Check digits are not tested."""
    digits = only_digits(col)
    return F.when(F.length(digits) == LENGTH, digits)


def _check_digit(digits: Column, count: int) -> Column:
    """Check digit over the first ``count`` digits, weighted count+1 down to 2."""
    weighted = [
        F.substring(digits, i + 1, 1).try_cast("int") * (count + 1 - i) for i in range(count)
    ]
    total = weighted[0]
    for term in weighted[1:]:
        total = total + term
    return total * 10 % 11 % 10


def check_digits_ok(digits: Column) -> Column:
    """Whether bare digits form a valid identifier.

    ``digits`` is used many times, so pass a plain column reference (see ``only_digits``).
    """
    repeated = digits == F.repeat(F.substring(digits, 1, 1), LENGTH)
    correct = [
        _check_digit(digits, count) == F.substring(digits, count + 1, 1).try_cast("int")
        for count in (LENGTH - 2, LENGTH - 1)
    ]
    verdict = (F.length(digits) == LENGTH) & ~repeated & correct[0] & correct[1]
    return F.coalesce(verdict, F.lit(False))


def validate_cpf(col: Column) -> Column:
    """Whether a text, masked or not, is a valid identifier; NULL is not valid."""
    return check_digits_ok(only_digits(col))
