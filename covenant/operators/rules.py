"""Soft quality rules and the policy each column declares for rows that break them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.contract import FLAGS, REASON, ColumnSpec, Contract
from covenant.functions import check_digits_ok, is_valid_email, only_digits
from covenant.operators.columns import any_of, fresh, ref
from covenant.operators.uniqueness import mark_repeated

# Reason prefix and check names, in the order the checks of a column run.
VIOLATION = "rule_violation"
CHECKS = ("regex", "invalid_cpf", "invalid_email", "below_min", "above_max", "duplicate")


@dataclass(frozen=True)
class Check:
    """One rule of one column. The list of checks is the only place that orders and names them."""

    name: str
    column: ColumnSpec

    @property
    def flag(self) -> str:
        return f"{self.name}:{self.column.name}"

    @property
    def policy(self) -> str:
        return self.column.rules.on_fail

    @property
    def rejects(self) -> bool:
        """Whether rows that break it are quarantined; the other policies leave a flag."""
        return self.policy == "quarantine"

    @property
    def expectation(self) -> tuple[str, str]:
        """Name and SQL predicate of the check as an expectation over the valid table's flags."""
        text = self.flag.replace("\\", "\\\\").replace("'", "\\'")
        return f"{self.name}_{self.column.name}", f"NOT array_contains({FLAGS}, '{text}')"

    @property
    def compares_rows(self) -> bool:
        return self.name == "duplicate"

    def failed(self, digits: str) -> Column:
        """Whether a row's value breaks the rule; a NULL value never does. ``digits``: where its digits are."""
        value, rules = ref(self.column.name), self.column.rules
        text = value.cast("string")
        broken = {
            "regex": lambda: ~text.rlike(rules.regex),
            "invalid_cpf": lambda: ~check_digits_ok(ref(digits)),
            "invalid_email": lambda: ~is_valid_email(text),
            "below_min": lambda: value < F.lit(rules.min),
            "above_max": lambda: value > F.lit(rules.max),
        }[self.name]()
        return value.isNotNull() & broken


def checks_of(contract: Contract) -> list[Check]:
    """All checks in column order, then check order."""
    out = []
    for column in contract.columns:
        r = column.rules
        declared = (
            r.regex is not None, r.valid_cpf, r.valid_email,
            r.min is not None, r.max is not None, r.unique,
        )
        out += [Check(name, column) for name, on in zip(CHECKS, declared, strict=True) if on]
    return out


def soft_flags(contract: Contract) -> list[tuple[str, str]]:
    """(flag, policy) of every check, in order."""
    return [(check.flag, check.policy) for check in checks_of(contract)]


def violation_codes(contract: Contract) -> list[str]:
    """Every reason ``judge`` can give."""
    return [f"{VIOLATION}:{flag}" for flag, policy in soft_flags(contract) if policy == "quarantine"]


def judge(df: DataFrame, contract: Contract) -> DataFrame:
    """Apply every check: add the flags and the soft reason, and empty values under ``nullify``.

    * ``warn`` and ``nullify`` put the check's flag on the row, in check order;
    * ``nullify`` then empties the value, which later checks of that column see;
    * ``quarantine`` sets the reason to the first failing check.

    ``unique`` counts the rows that reach this stage, with the values left by earlier checks.
    """
    checks = checks_of(contract)
    if not checks:
        empty = F.array().cast("array<string>")
        return df.withColumns({FLAGS: empty, REASON: F.lit(None).cast("string")})
    hits = {c.flag: fresh(df.columns, f"__hit_{c.flag}") for c in checks}
    judged = _check_rows(df, [c for c in checks if not c.compares_rows], hits)
    judged = mark_repeated(judged, {c.column.name: hits[c.flag] for c in checks if c.compares_rows})
    flagged = [F.when(ref(hits[c.flag]), F.lit(c.flag)) for c in checks if c.policy != "quarantine"]
    reasons = [
        F.when(ref(hits[c.flag]), F.lit(f"{VIOLATION}:{c.flag}")) for c in checks if c.policy == "quarantine"
    ]
    absent = F.array(F.lit(None).cast("string"))
    out = {
        FLAGS: F.array_except(F.array(*flagged), absent)
        if flagged
        else F.array().cast("array<string>"),
        REASON: F.coalesce(*reasons) if reasons else F.lit(None).cast("string"),
    }
    for check in checks:
        if check.compares_rows and check.policy == "nullify":
            out[check.column.name] = F.when(~ref(hits[check.flag]), ref(check.column.name))
    return judged.withColumns(out).drop(*map(ref, hits.values()))


def _check_rows(df: DataFrame, checks: list[Check], hits: Mapping[str, str]) -> DataFrame:
    """One boolean per check that looks at single rows, with nullified values already empty.

    ``hits``: the names of these columns by flag.
    """
    names = {c.column.name: fresh(df.columns, f"__digits_{c.column.name}") for c in checks}
    digits = {names[c.column.name]: only_digits(ref(c.column.name)) for c in checks if c.name == "invalid_cpf"}
    prepared = df.withColumns(digits) if digits else df
    by_column: dict[str, list[Check]] = {}
    for check in checks:
        by_column.setdefault(check.column.name, []).append(check)
    out: dict[str, Column] = {}
    for name, group in by_column.items():
        earlier: list[Column] = []
        for check in group:
            failed = check.failed(names[name])
            first = check.policy != "nullify" or not earlier
            out[hits[check.flag]] = failed if first else ~any_of(earlier) & failed
            earlier.append(failed)
        if group[0].policy == "nullify":
            out[name] = F.when(~any_of(earlier), ref(name))
    return prepared.withColumns(out).drop(*map(ref, digits)) if out else prepared
