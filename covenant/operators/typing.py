"""Schema completion, declared transforms and the cast to declared types, in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.contract import FLAGS, REASON, ColumnSpec, Contract
from covenant.functions import TRANSFORM_BUILDERS
from covenant.operators.columns import case_key, ref


def cast_to(col: Column, kind: T.DataType, target: T.DataType) -> Column:
    """Cast from ``kind`` to ``target``; what does not convert becomes NULL under any ANSI mode.

    Text with a fraction is cut to its whole part when the target is a whole number, which a
    plain ``try_cast`` from text refuses.
    """
    if kind == target:
        return col
    if isinstance(kind, T.DateType) and isinstance(target, (T.NumericType, T.BooleanType)):
        return F.lit(None).cast(target)
    if isinstance(kind, T.StringType) and isinstance(target, T.IntegralType):
        col = col.try_cast("decimal(38,18)")
    return col.try_cast(target)


def typed_value(source: Column, kind: T.DataType, column: ColumnSpec) -> Column:
    """The declared transform of a column, then its declared type."""
    if column.transform is None:
        return cast_to(source, kind, column.spark_type)
    value = TRANSFORM_BUILDERS[column.transform](source, column, kind)
    # what each transform yields; casting from it keeps to the declared type
    made = {
        "clean_numeric": T.DoubleType(),
        "normalize_score": T.DoubleType(),
        "normalize_cpf": T.StringType(),
    }
    return cast_to(value, made.get(column.transform, T.NullType()), column.spark_type)


def conform(df: DataFrame, contract: Contract) -> DataFrame:
    """Every source column in place, contract columns cleaned and typed, missing ones as NULL.

    Names are matched by the session's case rule and come out spelled as in the contract.
    Columns outside the contract pass through unchanged.
    """
    key = case_key(df)
    wanted = {key(c.name): c for c in contract.columns}
    out, found = [], set()
    for source in df.schema.fields:
        column = wanted.get(key(source.name))
        if column is not None:
            found.add(column.name)
            value = typed_value(ref(source.name), source.dataType, column)
            out.append(value.alias(column.name, metadata=_note(column)))
        elif source.name not in (FLAGS, REASON):
            out.append(ref(source.name))
    out += [
        F.lit(None).cast(c.spark_type).alias(c.name, metadata=_note(c))
        for c in contract.columns
        if c.name not in found
    ]
    return df.select(*out)


def _note(column: ColumnSpec) -> dict[str, str]:
    return {"comment": column.description} if column.description else {}
