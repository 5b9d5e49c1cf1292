"""Hard rules: a row without its key or another required value is rejected with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.contract import FLAGS, REASON, Contract
from covenant.operators.columns import all_of, any_of, ref, where_computed

# Reason codes.
NULL_KEY = "null_primary_key"
MISSING = "not_nullable_violation"


def missing_reason(contract: Contract) -> Column:
    """Why a typed row is rejected, or NULL.

    Of several NULL key columns the last declared one is named, of several other required
    columns the first; a key comes before the others.
    """
    keys = [
        F.when(ref(k).isNull(), F.lit(f"{NULL_KEY}:{k}")) for k in reversed(contract.primary_key)
    ]
    others = [
        F.when(ref(c.name).isNull(), F.lit(f"{MISSING}:{c.name}"))
        for c in contract.columns
        if not c.nullable
    ]
    found = [*keys, *others]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def computes_required(contract: Contract) -> bool:
    """Whether a required value comes out of a transform."""
    return bool(_computed(contract))


def _computed(contract: Contract) -> list[str]:
    return [c.name for c in contract.columns if c.transform and c.name in contract.required]


def complete_rows(typed: DataFrame, contract: Contract) -> DataFrame:
    """Rows that have every required value.

    The null tests of values that no transform computes come first and reach the scan.
    """
    computed = _computed(contract)
    plain = [c for c in contract.required if c not in computed]
    kept = typed.where(all_of(ref(c).isNotNull() for c in plain)) if plain else typed
    return where_computed(kept, all_of(ref(c).isNotNull() for c in computed)) if computed else kept


def incomplete_rows(typed: DataFrame, contract: Contract) -> DataFrame:
    """Rows that lack a required value, with the reason and no flags.

    Over columnar files whose required columns need no transform, the null tests reach the scan
    and skip every row group that has no NULL.
    """
    absent = any_of(ref(c).isNull() for c in contract.required)
    lacking = where_computed(typed, absent) if computes_required(contract) else typed.where(absent)
    return rejected_rows(lacking, contract)


def rejected_rows(lacking: DataFrame, contract: Contract) -> DataFrame:
    """Rows known to lack a required value, with the reason and no flags."""
    return lacking.withColumns({REASON: missing_reason(contract), FLAGS: no_flags()})


def no_flags() -> Column:
    return F.array().cast("array<string>")


def reason_codes(contract: Contract) -> list[str]:
    """Every reason ``missing_reason`` can give."""
    return [
        f"{NULL_KEY if c in contract.primary_key else MISSING}:{c}" for c in contract.required
    ]
