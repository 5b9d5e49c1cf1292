"""Timestamp expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def _marks(pattern: str) -> list[str]:
    """Separators every text of this pattern contains; none where sections are optional."""
    if "[" in pattern:
        return []
    return sorted({ch for ch in re.sub("'[^']*'", "", pattern) if ch in "-/.: ,_"})


def _quoted_letters(pattern: str) -> list[str]:
    return [] if "[" in pattern else sorted(set(re.findall("'([A-Za-z])'", pattern)))


def parse_timestamp(col: Column, formats: Sequence[str]) -> Column:
    """First of the formats that fits, in the given order; NULL when none does.

    A text that lacks a separator of a format is not tried with it, since a failed attempt costs
    far more than a look for a character.
    """
    if not formats:
        raise ValueError("parse_timestamp needs at least one format")
    attempts = []
    for pattern in formats:
        parsed = F.try_to_timestamp(col, F.lit(pattern))
        text = col.cast("string")
        fits = [F.contains(text, F.lit(mark)) for mark in _marks(pattern)]
        fits += [
            F.contains(text, F.lit(letter.upper())) | F.contains(text, F.lit(letter.lower()))
            for letter in _quoted_letters(pattern)
        ]
        attempts.append(F.when(reduce(and_, fits), parsed) if fits else parsed)
    return F.coalesce(*attempts)
