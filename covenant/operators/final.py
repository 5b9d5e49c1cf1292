"""The last projection of the valid table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from covenant.contract import FLAGS, Contract
from covenant.operators.columns import ref


def derive(df: DataFrame, contract: Contract) -> DataFrame:
    """Add derived columns. ``to_date`` keeps the full date of its source."""
    if not contract.derived:
        return df
    return df.withColumns({d.name: ref(d.source).try_cast("date") for d in contract.derived})


def final_columns(df: DataFrame, contract: Contract) -> DataFrame:
    """Contract columns, then derived ones, then the flags; everything else is dropped."""
    names = [c.name for c in contract.columns] + [d.name for d in contract.derived]
    return df.select(*[ref(n) for n in names], FLAGS)
