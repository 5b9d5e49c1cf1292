"""The declarative composition: each contract as named datasets that read one another by name.

``<name>_bronze`` (raw rows), ``<name>_typed`` (rows with every required value), ``<name>_judged``
(one row per key, with flags and soft reason), ``<name>`` (the valid table) and
``<name>_quarantine``. Valid and quarantine both read the judged rows, so no dedup or lookup runs twice
once those are stored. No pipeline server was run with these; tests drive a recorder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession

from covenant.contract import Contract
from covenant.operators.expectations import (
    expect_or_drop,
    expect_warn,
    hard_expectations,
    soft_expectations,
)
from covenant.operators.required import complete_rows, computes_required
from covenant.operators.typing import conform
from covenant.plans.batch import judged_rows, parted, rejects_softly
from covenant.sources import read_source

Read = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Dataset:
    """A named dataset: how to make it out of the others, and what a pipeline should know of it.

    ``undropped`` makes the rows before those that break ``dropping`` go, for a pipeline that drops
    and counts them itself.
    """

    name: str
    build: Callable[[Read], DataFrame]
    stored: bool = False
    comment: str = ""
    dropping: dict[str, str] = field(default_factory=dict)
    undropped: Callable[[Read], DataFrame] | None = None
    watched: dict[str, str] = field(default_factory=dict)
    partition_by: tuple[str, ...] = ()


def typed_rows(
    bronze: DataFrame, contract: Contract, into: Observation | None = None
) -> DataFrame:
    typed, computed = conform(bronze, contract), computes_required(contract)
    return expect_or_drop(typed, hard_expectations(contract), into, computed)


def valid_rows(judged: DataFrame, contract: Contract, into: Observation | None = None) -> DataFrame:
    return expect_warn(parted(judged, judged, contract).valid, soft_expectations(contract), into)


def datasets(spark: SparkSession, contract: Contract, bronze: DataFrame | None = None) -> list[Dataset]:
    """The datasets of a contract, each after those it reads."""
    name, base = contract.name, f"{contract.name}_bronze"

    def raw(read: Read) -> DataFrame:
        return read_source(spark, contract) if bronze is None else bronze

    def rejected(read: Read) -> DataFrame:
        # from the raw rows too, since the typed dataset has lost the incomplete ones
        return parted(conform(read(base), contract), read(f"{name}_judged"), contract).quarantine

    return [
        Dataset(base, raw, comment=f"raw rows of {contract.source.path}"),
        Dataset(
            f"{name}_typed",
            lambda read: typed_rows(read(base), contract),
            comment="typed rows with all required values",
            dropping=hard_expectations(contract),
            undropped=lambda read: conform(read(base), contract),
        ),
        Dataset(
            f"{name}_judged",
            lambda read: judged_rows(complete_rows(read(f"{name}_typed"), contract), contract),
            stored=rejects_softly(contract),  # two datasets read it then
            comment="one row per key with its flags",
        ),
        Dataset(
            name,
            lambda read: valid_rows(read(f"{name}_judged"), contract),
            stored=True,
            comment=contract.description,
            watched=soft_expectations(contract),
            partition_by=contract.partition_by,
        ),
        Dataset(f"{name}_quarantine", rejected, stored=True, comment="rejected rows with a reason"),
    ]


def create_views(
    spark: SparkSession, contract: Contract, bronze: DataFrame | None = None
) -> list[str]:
    """Define the datasets as temporary views and return their names."""
    found = datasets(spark, contract, bronze)
    for dataset in found:
        dataset.build(spark.table).createOrReplaceTempView(dataset.name)
    return [dataset.name for dataset in found]


def define_datasets(
    spark: SparkSession,
    contracts: Iterable[Contract],
    pipelines: Any = None,
    source_base: str | None = None,
) -> None:
    """Define the datasets of each contract in a Spark declarative pipeline.

    Call it from a pipeline source file. ``pipelines`` is the decorator module and defaults to
    ``pyspark.pipelines``; ``source_base`` is the folder that holds the source files. Where the module
    offers ``expect_all`` and ``expect_all_or_drop``, the rules are handed over to it; open-source Spark
    has neither, so rows are dropped by a filter there.
    """
    if pipelines is None:
        from pyspark import pipelines  # noqa: PLC0415 (only importable inside a pipeline run)
    for contract in contracts:
        for dataset in datasets(spark, contract.reading_from(source_base)):
            _define(spark, dataset, pipelines)


def _define(spark: SparkSession, dataset: Dataset, pipelines: Any) -> None:
    handed = dataset.undropped is not None and dataset.dropping and hasattr(pipelines, "expect_all_or_drop")

    def build() -> DataFrame:
        return (dataset.undropped if handed else dataset.build)(spark.read.table)

    for kind, rules in (("expect_all_or_drop", dataset.dropping), ("expect_all", dataset.watched)):
        if rules and hasattr(pipelines, kind):
            build = getattr(pipelines, kind)(rules)(build)
    options = {"name": dataset.name, "comment": dataset.comment}
    if not dataset.stored:
        pipelines.temporary_view(**options)(build)
    else:
        pipelines.materialized_view(**options, partition_cols=list(dataset.partition_by) or None)(build)
