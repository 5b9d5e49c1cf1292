"""Writing the valid and the quarantine table."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from covenant.contract import Contract
from covenant.operators.columns import ref
from covenant.plans.batch import Outcome
from covenant.sinks.report import RunCounters

QUARANTINE_SUFFIX = "_quarantine"
# Formats whose tables are replaced in one transaction each.
TRANSACTIONAL = ("delta", "iceberg", "hudi")


def is_table_target(target: str) -> bool:
    """Whether a target names a schema (``catalog.schema``) and not a folder."""
    return "." in target and not any(mark in target for mark in "/\\")


def even_files(df: DataFrame, partition_by: tuple[str, ...]) -> DataFrame:
    """Gather rows into files of a reasonable size, by output partition if there is one.

    Without it every task writes a file for every partition it meets, and the few rejected rows
    of each scan task become a file of their own. Adaptive execution splits what is too large
    over several tasks, so a hot date is not one task.
    """
    return df.hint("rebalance", *[ref(p) for p in partition_by])


def write_outcome(
    outcome: Outcome,
    contract: Contract,
    target: str,
    fmt: str = "parquet",
    as_table: bool | None = None,
    counters: RunCounters | None = None,
) -> str:
    """Replace both result tables and say where they went.

    A target like ``catalog.schema`` takes managed tables, anything else is a folder;
    ``as_table`` settles the matter where the name misleads. Only the valid table is partitioned.
    An unpartitioned valid table is written as its last stage left it. ``counters`` take the
    row and rule counts on the way.

    Folders are written beside the old ones first and take their places when both are complete, so a failure in
    either write leaves the old pair. Managed tables, and formats with transactions of their own, are overwritten
    one after the other, which keeps what the catalog or their history holds.
    """
    as_table = is_table_target(target) if as_table is None else as_table
    by = contract.partition_by
    outcome = replace(
        outcome,
        valid=even_files(outcome.valid, by) if by else outcome.valid,
        quarantine=even_files(outcome.quarantine, ()),
    )
    outcome = counters.attach(outcome) if counters else outcome
    session = outcome.valid.sparkSession
    if as_table:
        session.sql(f"CREATE SCHEMA IF NOT EXISTS {target}")
    separator = "." if as_table else "/"
    names = [f"{target.rstrip('/')}{separator}{contract.name}{suffix}" for suffix in ("", QUARANTINE_SUFFIX)]
    results = list(zip(names, (outcome.valid, outcome.quarantine), (by, ()), strict=True))
    if as_table or fmt in TRANSACTIONAL or not hasattr(session, "_jvm"):
        for name, df, partition_by in results:
            _write(df, name, fmt, partition_by, as_table)
    else:
        with FolderSwap(session, names) as swap:
            for name, df, partition_by in results:
                _write(df, swap.beside[name], fmt, partition_by, as_table)
    return f"{fmt} {'tables in' if as_table else 'files under'} {target}"


def _write(df: DataFrame, name: str, fmt: str, partition_by: tuple[str, ...], as_table: bool) -> None:
    # a session in dynamic mode would keep the partitions of an earlier run that this one does not write
    writer = df.write.mode("overwrite").format(fmt).option("partitionOverwriteMode", "static")
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    if as_table:
        writer.option("overwriteSchema", "true").saveAsTable(name)
    else:
        writer.save(name)


class FolderSwap:
    """New folders beside old ones; they take their places if the block ends well, else they go.

    Their names start with an underscore, which hides them from readers of the parent.
    """

    def __init__(self, spark: SparkSession, names: Sequence[str]) -> None:
        self.spark = spark
        run = uuid.uuid4().hex[:12]
        self.beside = {name: _sibling(name, f"new_{run}") for name in names}
        self.before = {name: _sibling(name, f"old_{run}") for name in names}

    def __enter__(self) -> FolderSwap:
        return self

    def __exit__(self, kind: object, *_: object) -> None:
        try:
            if kind is None:
                self._replace()
        finally:
            self._remove(self.beside.values())

    def _replace(self) -> None:
        moved: list[tuple[str, str]] = []
        try:
            for name, new in self.beside.items():
                if self._exists(name):
                    self._move(name, self.before[name])
                    moved.append((name, self.before[name]))
                self._move(new, name)
                moved.append((new, name))
        except Exception:
            for here, there in reversed(moved):
                self._move(there, here)
            raise
        self._remove(self.before.values())

    def _at(self, name: str) -> tuple[Any, Any]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, name: str) -> bool:
        files, path = self._at(name)
        return files.exists(path)

    def _move(self, name: str, to: str) -> None:
        files, path = self._at(name)
        if not files.rename(path, self._at(to)[1]):
            raise OSError(f"{name} cannot become {to}")

    def _remove(self, names: Iterable[str]) -> None:
        for name in names:
            files, path = self._at(name)
            files.delete(path, True)


def _sibling(name: str, mark: str) -> str:
    parent, _, last = name.rpartition("/")
    return f"{parent}/_{last}_{mark}"
