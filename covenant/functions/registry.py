"""Transforms a contract may name, as builders of column expressions.

A builder gets the raw column, the column's spec and the type it arrives in. Users may register
their own native expressions under new names.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import types as T

from covenant.functions.identifiers import normalize_cpf
from covenant.functions.numbers import clean_numeric, normalize_score
from covenant.functions.times import parse_timestamp

if TYPE_CHECKING:
    from covenant.contract import ColumnSpec

Builder = Callable[[Column, "ColumnSpec", T.DataType], Column]


def _timestamp(col: Column, column: ColumnSpec, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return col.try_cast("timestamp")  # a date or time already: formats describe text
    return parse_timestamp(col.cast("string"), column.formats)


TRANSFORM_BUILDERS: dict[str, Builder] = {
    "clean_numeric": lambda col, column, kind: clean_numeric(col, kind),
    "parse_timestamp": _timestamp,
    "normalize_cpf": lambda col, column, kind: normalize_cpf(col),
    "normalize_score": lambda col, column, kind: normalize_score(col, column.score_map, kind),
}


def register_transform(name: str, builder: Builder) -> None:
    """Make ``builder`` available to contracts as ``transform: <name>``."""
    TRANSFORM_BUILDERS[name] = builder
