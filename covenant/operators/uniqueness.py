"""Marking every row whose value is shared with another row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.operators.columns import fresh, ref


def mark_repeated(df: DataFrame, flags: Mapping[str, str]) -> DataFrame:
    """Add a boolean flag per column: the value is not NULL and at least one other row holds it too.

    A count window would pull all rows of a value into one task. Instead values are counted with
    a map-side combine, only repeated ones are kept, and rows look themselves up in that list by
    a left join. All lists come from ``df`` itself and only then are the lookups chained, so the
    plan grows with the number of columns and no faster. A list is as small as the data is clean,
    and nothing here forces a broadcast: Spark broadcasts it when its measured size is under the
    session's threshold, and else joins by shuffle, where adaptive execution splits the partition of
    a hot value over many tasks. It can do so only if both sides come straight out of a shuffle,
    which the hash as second join key ensures: the counts are grouped by the value alone, so they
    are not yet partitioned by both.

    NULL rows find no partner, so they are spread by a hash of the whole row over all tasks.
    """
    taken = [*df.columns, *flags.values()]
    spread, listed, hashed = (fresh(taken, name) for name in ("__spread", "__value", "__hash"))
    lists = [(column, flag, _repeated(df, column, listed, hashed)) for column, flag in flags.items()]
    whole_row = F.xxhash64(*[ref(f) for f in _hashable(df)])
    for column, flag, repeated in lists:
        value = ref(column)
        df = df.withColumn(spread, F.when(value.isNotNull(), F.xxhash64(value)).otherwise(whole_row))
        same = (value == F.col(listed)) & (F.col(spread) == F.col(hashed))
        joined = df.join(repeated, same, "left").withColumn(flag, F.col(listed).isNotNull())
        df = joined.drop(spread, listed, hashed)
    return df


def _repeated(df: DataFrame, column: str, listed: str, hashed: str) -> DataFrame:
    """The values that two rows or more hold, each with its hash."""
    value = ref(column)
    counted = df.where(value.isNotNull()).groupBy(value.alias(listed)).agg(F.count(F.lit(1)).alias(hashed))
    return counted.where(F.col(hashed) > 1).select(listed, F.xxhash64(listed).alias(hashed))


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if "map<" not in (t := f.dataType.simpleString()) and "variant" not in t]
