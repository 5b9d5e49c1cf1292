"""One row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.contract import Contract
from covenant.operators.columns import fresh, ref


def _orderable(col: Column, kind: T.DataType) -> Column:
    """A form of the column that has an order: maps as sorted entries, variants as JSON text."""
    if isinstance(kind, T.VariantType):
        return F.to_json(col)
    if isinstance(kind, T.MapType):
        return F.array_sort(F.map_entries(col)) if _sorts(kind.valueType) else F.to_json(col)
    return col if _sorts(kind) else F.to_json(F.struct(col))


def _sorts(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_sorts(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _sorts(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def keep_one(
    df: DataFrame,
    keys: Sequence[str],
    order_by: str | None = None,
    keep: str = "last",
    ties: Sequence[str] = (),
) -> DataFrame:
    """The last (greatest) or first (smallest) row of each key by ``order_by``.

    Ties go on through the columns of ``ties``, then through all others by name, so the winner
    depends neither on how rows are spread nor on the order of the columns. NULL is the smallest
    value: it loses under ``last`` and wins under ``first``.

    The winner is the greatest or smallest of the rows as structs in that order. It is aggregated in every map
    task before the shuffle, so a key that holds much of the table still sends only one row per task, and rows
    are sorted by their key alone and compared only within it. Rows with maps or variants, which have no
    order themselves, are carried along beside a struct of what stands for them.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    lead = order_by or keys[0]
    rest = dict.fromkeys([*(c for c in ties if c in kinds), *sorted(kinds)])
    columns = [lead, *(c for c in rest if c != lead and (c not in keys or _rounded(kinds[c])))]
    columns = [c for c in columns if c in kinds] or [lead]
    row = F.struct(*[ref(c) for c in columns])
    if all(_sorts(kinds[c]) for c in columns):
        winner = F.max(row) if keep == "last" else F.min(row)
    else:
        order = F.struct(*[_orderable(ref(c), kinds[c]).alias(f"o{i}") for i, c in enumerate(columns)])
        winner = F.max_by(row, order) if keep == "last" else F.min_by(row, order)
    won = fresh(df.columns, "__winner")
    grouped = df.groupBy(*[ref(k) for k in keys]).agg(winner.alias(won))
    by_key = {k for k in keys if not _rounded(kinds[k])}
    return grouped.select(*[ref(c) if c in by_key else F.col(won).getField(c).alias(c) for c in kinds])


def _rounded(kind: T.DataType) -> bool:
    """Whether grouping changes a value: it turns -0.0 into 0.0."""
    if isinstance(kind, T.StructType):
        return any(_rounded(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _rounded(kind.elementType)
    return isinstance(kind, (T.FloatType, T.DoubleType))


def deduplicate(df: DataFrame, contract: Contract) -> DataFrame:
    """Dedup as the contract declares it, ties by contract order; no declaration leaves the rows alone."""
    if contract.dedup is None:
        return df
    ties = [c.name for c in contract.columns]
    return keep_one(df, contract.dedup.keys, contract.dedup.order_by, contract.dedup.keep, ties)
