"""A contract applied to one table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.contract import REASON, Contract
from covenant.operators.columns import any_of, ref
from covenant.operators.dedup import deduplicate
from covenant.operators.final import derive, final_columns
from covenant.operators.required import complete_rows, incomplete_rows, rejected_rows
from covenant.operators.rules import checks_of, judge
from covenant.operators.typing import conform

Stage = Callable[[DataFrame], DataFrame]
Land = Callable[[DataFrame, Column], tuple[DataFrame, DataFrame]]


@dataclass(frozen=True)
class Outcome:
    """The two lazy result tables of a contract."""

    name: str
    valid: DataFrame
    quarantine: DataFrame


def split(typed: DataFrame, contract: Contract, stage: Stage | None = None) -> Outcome:
    """Required values, dedup, soft rules and derived columns over a typed table.

    Rows without a required value never enter the dedup shuffle: they are a plain filter over the
    source. The soft part of the quarantine is only in the plan when a column declares that
    policy. In that case the judged rows feed both results, and ``stage`` (see
    ``covenant.sinks.shared_stage``) may store them once in between.
    """
    judged = judged_rows(complete_rows(typed, contract), contract)
    if stage and rejects_softly(contract):
        judged = stage(judged)
    return parted(typed, judged, contract)


def rejects_softly(contract: Contract) -> bool:
    return any(check.rejects for check in checks_of(contract))


def judged_rows(complete: DataFrame, contract: Contract) -> DataFrame:
    """Dedup and soft rules over rows that have every required value, with flags and soft reason.

    Columns outside the contract go along only where a soft policy may show them in the
    quarantine; else they are neither read nor shuffled.
    """
    if not rejects_softly(contract):
        complete = complete.select(*[ref(c.name) for c in contract.columns])
    return judge(deduplicate(complete, contract), contract)


def parted(typed: DataFrame, judged: DataFrame, contract: Contract) -> Outcome:
    """The two results out of all typed rows and the judged ones."""
    return _outcome(incomplete_rows(typed, contract), judged, contract)


def _outcome(quarantine: DataFrame, judged: DataFrame, contract: Contract) -> Outcome:
    if rejects_softly(contract):
        quarantine = quarantine.unionByName(judged.where(F.col(REASON).isNotNull()))
        judged = judged.where(F.col(REASON).isNull())
    return Outcome(contract.name, final_columns(derive(judged, contract), contract), quarantine)


def landed_split(typed: DataFrame, contract: Contract, land: Land, stage: Stage | None = None) -> Outcome:
    """``split`` over a source that is costly to read: one pass lands its typed rows, apart by the hard outcome.

    Both results then read only their part of what has landed. Columns outside the contract land empty where
    neither result can show them, which is on complete rows without a soft policy that rejects.
    """
    incomplete = any_of(ref(c).isNull() for c in contract.required)
    if not rejects_softly(contract):
        own = {c.name for c in contract.columns}
        extra = {f: F.when(incomplete, ref(f)) for f in typed.columns if f not in own}
        typed = typed.withColumns(extra) if extra else typed
    complete, lacking = land(typed, incomplete)
    judged = judged_rows(complete, contract)
    if stage and rejects_softly(contract):
        judged = stage(judged)
    return _outcome(rejected_rows(lacking, contract), judged, contract)


def apply_contract(
    df: DataFrame, contract: Contract, stage: Stage | None = None, land: Land | None = None
) -> Outcome:
    """Raw rows in, valid and quarantined rows out.

    Nothing runs until a result is used, unless ``land`` or ``stage`` store rows in between.
    """
    contract.check_patterns()
    typed = conform(df, contract)
    return landed_split(typed, contract, land, stage) if land else split(typed, contract, stage)
