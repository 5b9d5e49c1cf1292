"""A contract's rules as named boolean SQL predicates, and what to do with them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from covenant.contract import Contract
from covenant.operators.columns import all_of, where_computed
from covenant.operators.required import MISSING, NULL_KEY
from covenant.operators.rules import checks_of


def hard_expectations(contract: Contract) -> dict[str, str]:
    """One ``IS NOT NULL`` predicate per required column."""

    def label(name: str) -> str:
        return f"{NULL_KEY if name in contract.primary_key else MISSING}_{name}"

    return {label(c): "`" + c.replace("`", "``") + "` IS NOT NULL" for c in contract.required}


def soft_expectations(contract: Contract) -> dict[str, str]:
    """What the checks that leave a flag expect of the valid table; quarantined rows are gone from it."""
    return dict(check.expectation for check in checks_of(contract) if not check.rejects)


def _observed(df: DataFrame, expectations: Mapping[str, str], into: Observation | None) -> DataFrame:
    if into is None or not expectations:
        return df
    failures = [F.count_if(~F.expr(sql)).alias(name) for name, sql in expectations.items()]
    return df.observe(into, F.count(F.lit(1)).alias("rows"), *failures)


def expect_or_drop(
    df: DataFrame,
    expectations: Mapping[str, str],
    into: Observation | None = None,
    computed: bool = False,
) -> DataFrame:
    """Rows that meet every expectation; ``into`` counts the rows and the failures of each.

    Say ``computed`` when the expectations look at columns that are costly to compute.
    """
    watched = _observed(df, expectations, into)
    met = all_of(F.expr(sql) for sql in expectations.values())
    return where_computed(watched, met) if computed else watched.where(met)


def expect_warn(
    df: DataFrame, expectations: Mapping[str, str], into: Observation | None = None
) -> DataFrame:
    """All rows; ``into`` counts the rows and the failures of each expectation."""
    return _observed(df, expectations, into)


def expectation_counts(df: DataFrame, expectations: Mapping[str, str]) -> DataFrame:
    """Passed and failed rows of every expectation, in one pass over the table."""
    if not expectations:
        return df.sparkSession.createDataFrame([], "expectation string, passed bigint, failed bigint")
    names = list(expectations)
    totals = df.agg(
        *[F.count_if(F.expr(expectations[n])).alias(f"p{i}") for i, n in enumerate(names)],
        *[F.count_if(~F.expr(expectations[n])).alias(f"f{i}") for i, n in enumerate(names)],
    )
    rows = [
        F.struct(
            F.lit(n).alias("expectation"), F.col(f"p{i}").alias("passed"), F.col(f"f{i}").alias("failed")
        )
        for i, n in enumerate(names)
    ]
    return totals.select(F.inline(F.array(*rows)))
