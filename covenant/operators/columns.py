"""Naming helpers shared by the stages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ref(name: str) -> Column:
    """Column reference that takes any name literally, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, with as many underscores before it as make it a name that is not taken, case aside."""
    names = {name.lower() for name in taken}
    while wanted.lower() in names:
        wanted = f"_{wanted}"
    return wanted


def case_key(df: DataFrame):
    """How this session compares column names."""
    sensitive = df.sparkSession.conf.get("spark.sql.caseSensitive", "false").lower() == "true"
    return (lambda name: name) if sensitive else str.lower


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on columns that are costly to compute, computing each once.

    Spark moves a filter below the projection that computes its columns and so computes them
    twice, in the filter and in the projection. A column that depends on the task keeps the two
    in order.
    """
    task = fresh(df.columns, "__task")
    kept = df.withColumn(task, F.spark_partition_id()).where((F.col(task) >= 0) & condition)
    return kept.drop(task)


def any_of(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for i, condition in enumerate(conditions):
        out = condition if i == 0 else out | condition
    return out


def all_of(conditions: Iterable[Column]) -> Column:
    out = F.lit(True)
    for i, condition in enumerate(conditions):
        out = condition if i == 0 else out & condition
    return out
