"""Row and rule counts, taken while the results are written."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from covenant.contract import FLAGS, REASON, Contract
from covenant.operators.required import reason_codes
from covenant.operators.rules import soft_flags, violation_codes
from covenant.plans.batch import Outcome

_SCHEMA = "table string, metric string, n bigint"


def _count(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def valid_metrics(contract: Contract) -> list[Column]:
    flags = [
        _count(F.array_contains(FLAGS, flag), flag)
        for flag, policy in soft_flags(contract)
        if policy != "quarantine"
    ]
    return [F.count(F.lit(1)).alias("valid"), *flags]


def quarantine_metrics(contract: Contract) -> list[Column]:
    codes = [*reason_codes(contract), *violation_codes(contract)]
    counted = [_count(F.col(REASON) == code, code) for code in codes]
    return [F.count(F.lit(1)).alias("quarantine"), *counted]


class RunCounters:
    """Counters of one run; they fill while the two tables are written.

    Attached on top of the final plans they sit in the tasks that write, where Spark counts every
    partition once even if tasks are retried.
    """

    def __init__(self, contract: Contract) -> None:
        self.contract = contract
        self._valid, self._quarantine = Observation(), Observation()

    def attach(self, outcome: Outcome) -> Outcome:
        return replace(
            outcome,
            valid=outcome.valid.observe(self._valid, *valid_metrics(self.contract)),
            quarantine=outcome.quarantine.observe(
                self._quarantine, *quarantine_metrics(self.contract)
            ),
        )

    def rows(self) -> list[tuple[str, str, int]]:
        """(table, metric, n), once both tables are written."""
        counted = {**self._valid.get, **self._quarantine.get}
        return [(self.contract.name, metric, n) for metric, n in counted.items()]


def report_frame(spark: SparkSession, rows: Iterable[tuple[str, str, int]]) -> DataFrame:
    """The report as a table: one row per result table and metric."""
    return spark.createDataFrame(list(rows), _SCHEMA)


def quality_report(outcome: Outcome, contract: Contract) -> DataFrame:
    """The same counts as a lazy table, for callers that write nothing."""
    parts = []
    for df, metrics in (
        (outcome.valid, valid_metrics(contract)),
        (outcome.quarantine, quarantine_metrics(contract)),
    ):
        totals = df.agg(*metrics)
        pairs = [F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("n")) for n in totals.columns]
        parts.append(totals.select(F.inline(F.array(*pairs))))
    return parts[0].unionByName(parts[1]).select(F.lit(contract.name).alias("table"), "metric", "n")
