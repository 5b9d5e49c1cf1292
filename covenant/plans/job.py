"""The batch job: every contract read, applied and written.

    spark-submit --py-files covenant.zip covenant/plans/job.py --output warehouse/silver
    python -m covenant.plans.job --contracts 'contracts/*.yaml' --output main.silver
"""

from __future__ import annotations

import argparse
import glob
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from importlib.resources import files

from pyspark.sql import DataFrame, SparkSession

from covenant.contract import Contract
from covenant.plans.batch import apply_contract
from covenant.sinks.report import RunCounters, report_frame
from covenant.sinks.staging import SharedStage
from covenant.sinks.writers import write_outcome
from covenant.sources import read_source

PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
HASH_JOIN = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
ZONE = "spark.sql.session.timeZone"
# Below so much in every measured partition of its smaller side, a join by sort becomes one by hash.
HASH_JOIN_BYTES = "64MB"
SCAN_BYTES = "spark.sql.files.maxPartitionBytes"
# Bytes of input per partition, up to EVEN_BYTES of input; and the most that a partition gets.
PARTITION_BYTES = 128 * 1024**2
EVEN_BYTES = 1024**4
MOST_BYTES = 2 * 1024**3
# Contracts published side by side.
AT_ONCE = 4
# Spark's estimate for what it knows nothing about.
UNKNOWN_BYTES = 2**62


def bundled_contracts() -> list[Contract]:
    """The contracts shipped with the package, by file name; the package may be a zip file."""
    folder = files("covenant") / "contracts"
    found = sorted((e for e in folder.iterdir() if e.name.endswith(".yaml")), key=lambda e: e.name)
    return [Contract.from_text(e.read_text(encoding="utf-8"), e.name) for e in found]


def load_contracts(pattern: str | None = None) -> list[Contract]:
    """Contracts that match a glob pattern, or the bundled ones."""
    if pattern:
        found = [Contract.from_yaml(path) for path in sorted(glob.glob(pattern))]
    else:
        found = bundled_contracts()
    if not found:
        raise SystemExit("no contract found")
    return found


def input_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a table's size, which for files is what they hold."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def partition_bytes(size: int) -> int:
    """Bytes per partition, of scans and of shuffles, for an input of so many bytes.

    A shuffle has as many blocks as scan tasks times shuffle partitions, and the driver keeps a status of every
    block. With a fixed size per partition the blocks grow with the square of the input; beyond EVEN_BYTES the size
    grows with its square root, and the blocks in proportion to the input.
    """
    return min(MOST_BYTES, round(PARTITION_BYTES * max(1, size / EVEN_BYTES) ** 0.5))


def wanted_partitions(raw: DataFrame) -> int:
    """Shuffle partitions for an input: by its size, or by its scan tasks where the size is unknown."""
    size = input_bytes(raw)
    return -(-size // partition_bytes(size)) if size < UNKNOWN_BYTES else raw.rdd.getNumPartitions()


@contextmanager
def tuned(spark: SparkSession, raw: DataFrame, partitions: int | None = None) -> Iterator[None]:
    """Session settings for one run, taken back afterwards.

    Times are UTC, whatever zone the session has. Shuffles start with enough partitions for the
    input (or with ``partitions``), since the session's default number suits small tables; adaptive
    execution merges partitions that turn out small. Scans of very large inputs get larger tasks by the same
    rule. And a sort-merge join becomes a hash join
    where every measured partition of its smaller side is small, so the rows that look up repeated
    values need not be sorted. Of these two, what the user has set is left alone.
    """
    ours = {HASH_JOIN: HASH_JOIN_BYTES}
    most = partitions or wanted_partitions(raw)
    if partitions or int(spark.conf.get("spark.sql.shuffle.partitions")) < most:
        ours[PARTITIONS] = str(most)
    ours = {key: value for key, value in ours.items() if spark.conf.get(key, None) is None}
    size = input_bytes(raw)
    if EVEN_BYTES < size < UNKNOWN_BYTES and spark.conf.get(SCAN_BYTES) in (str(PARTITION_BYTES), f"{PARTITION_BYTES}b"):
        ours[SCAN_BYTES] = str(partition_bytes(size))
    zone = spark.conf.get(ZONE)
    for key, value in {**ours, ZONE: "UTC"}.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in ours:
            spark.conf.unset(key)
        spark.conf.set(ZONE, zone)


def reads_text_twice(contract: Contract) -> bool:
    """Whether plans over the source would parse text more than once: for both tables, or for values to be unique."""
    unique = any(c.rules.unique for c in contract.columns)
    return contract.source.format in ("json", "csv") and (bool(contract.required) or unique)


def publish(
    spark: SparkSession,
    contract: Contract,
    target: str,
    fmt: str = "parquet",
    source: DataFrame | None = None,
    as_table: bool | None = None,
    partitions: int | None = None,
) -> list[tuple[str, str, int]]:
    """Apply one contract, write its two tables and return the counts taken on the way.

    A text source is parsed once: its typed rows land in the shared folder, where there is one, and both tables
    read them there. Judged rows that feed both tables are staged there too. The two writes themselves
    count, so no separate counting job runs. ``as_table`` says what the target is where its name
    misleads, ``partitions`` how many partitions shuffles start with.
    """
    raw = read_source(spark, contract) if source is None else source
    stage = SharedStage(spark, contract.name)
    counters = RunCounters(contract)
    try:
        with tuned(spark, raw, partitions):
            land = stage.land if source is None and reads_text_twice(contract) and stage.available() else None
            outcome = apply_contract(raw, contract, stage, land)
            where = write_outcome(outcome, contract, target, fmt, as_table, counters)
    finally:
        stage.discard()
    rows = counters.rows()
    counts = {metric: n for _, metric, n in rows}
    print(f"[{contract.name}] valid={counts['valid']} quarantine={counts['quarantine']} -> {where}")
    return rows


class PublishFailed(RuntimeError):
    """Some contracts could not be published; ``failures`` has why, by name, and ``rows`` the counts of all others."""

    def __init__(self, failures: dict[str, Exception], rows: list[tuple[str, str, int]]) -> None:
        super().__init__("; ".join(f"{name}: {type(error).__name__}: {error}" for name, error in failures.items()))
        self.failures, self.rows = failures, rows


def run(
    spark: SparkSession,
    contracts: Iterable[Contract],
    target: str,
    source_base: str | None = None,
    fmt: str = "parquet",
    as_table: bool | None = None,
    partitions: int | None = None,
    at_once: int = AT_ONCE,
) -> DataFrame:
    """Publish every contract and return the quality report.

    Up to ``at_once`` contracts are published side by side, each in a session of its own with this
    one's settings, since a run changes settings. Where the scheduler is fair, each has a pool of its own too. A contract
    over a temporary view can only run in this session, before the others. A contract that fails does not keep
    the others from being published; ``PublishFailed`` is raised at the end.
    """
    moved = [contract.reading_from(source_base) for contract in contracts]
    rows: dict[int, list[tuple[str, str, int]]] = {}
    failures: dict[str, Exception] = {}

    def one(i: int, session: SparkSession) -> None:
        try:
            rows[i] = publish(session, moved[i], target, fmt, as_table=as_table, partitions=partitions)
        except Exception as error:  # noqa: BLE001 (told at the end, by contract)
            failures[moved[i].name] = error

    def apart(i: int) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", moved[i].name)
        one(i, _session_like(spark))

    together = [i for i, contract in enumerate(moved) if at_once > 1 and not _reads_view(spark, contract)]
    for i in sorted({*range(len(moved))} - {*together}):
        one(i, spark)
    with ThreadPoolExecutor(max_workers=max(1, min(at_once, len(together)))) as pool:
        list(pool.map(apart, together))
    counted = [row for i in sorted(rows) for row in rows[i]]
    if failures:
        raise PublishFailed(failures, counted) from next(iter(failures.values()))
    return report_frame(spark, counted)


def _session_like(spark: SparkSession) -> SparkSession:
    """A new session with the settings of this one."""
    other = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if other.conf.get(key, None) != value and other.conf.isModifiable(key):
            other.conf.set(key, value)
    return other


def _reads_view(spark: SparkSession, contract: Contract) -> bool:
    """Whether the source is a temporary view, which no other session sees."""
    path = contract.source.path
    return contract.source.format == "table" and any(t.isTemporary and t.name == path for t in spark.catalog.listTables())


def main(argv: Sequence[str] | None = None) -> None:
    options = argparse.ArgumentParser(prog="covenant")
    options.add_argument("--contracts", help="glob of contract files (default: the bundled ones)")
    options.add_argument("--output", default="data/silver", help="folder, or catalog.schema")
    options.add_argument("--source-base", help="folder that holds the source files")
    options.add_argument("--format", default="parquet", help="table format of the output")
    options.add_argument("--target", choices=["folder", "tables"], help="what the output is (default: by its name)")
    options.add_argument("--shuffle-partitions", type=int, help="partitions that shuffles start with")
    options.add_argument("--at-once", type=int, default=AT_ONCE, help="contracts published side by side")
    given = options.parse_args(argv)
    spark = SparkSession.builder.appName("covenant").getOrCreate()
    contracts = load_contracts(given.contracts)
    as_table = None if given.target is None else given.target == "tables"
    report = run(
        spark,
        contracts,
        given.output,
        given.source_base,
        given.format,
        as_table,
        given.shuffle_partitions,
        given.at_once,
    )
    report.show(1000, truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()
