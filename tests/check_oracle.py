"""Compare every registered query with its SQL: ``python tests/check_oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages
    benchmark labels conversations""".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


_KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def _plain(value: object) -> object:
    return "NaN" if isinstance(value, float) and math.isnan(value) else value


def difference(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str:
    """Empty when both results hold the same rows, columns taken by name."""
    ours = queries()[name](spark, sf_dir)
    columns = sorted(ours.columns)
    theirs = con.execute(oracle_sql()[name])
    their_columns = [d[0] for d in theirs.description]
    if sorted(their_columns) != columns:
        return f"columns {columns} against {sorted(their_columns)}"
    kinds = {d[0]: _KINDS.get(str(d[1]), str(d[1])) for d in theirs.description}
    ours_kinds = {f.name: f.dataType.simpleString() for f in ours.schema.fields}
    if kinds != ours_kinds:
        return f"types {ours_kinds} against {kinds}"
    order = [their_columns.index(c) for c in columns]
    right = sorted((tuple(_plain(r[i]) for i in order) for r in theirs.fetchall()), key=repr)
    left = sorted((tuple(map(_plain, r)) for r in ours.select(*columns).collect()), key=repr)
    if left == right and left:
        return ""
    shown = [(a, b) for a, b in zip(left, right, strict=False) if a != b][:3]
    return f"{len(left)} rows against {len(right)}; columns {columns}; first differences {shown}"


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(oracle_sql())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.perf_counter()
        found = difference(spark, con, sf_dir, name)
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {time.perf_counter() - start:6.2f}s {name} {found[:1500]}", flush=True)
    print(f"{len(names) - bad} of {len(names)} match")
    spark.stop()


if __name__ == "__main__":
    main()
