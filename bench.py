"""Headline timings: one JSON line on stdout.

Each query is written to the ``noop`` sink, once to warm up and then three times; the median
counts. The dirtied orders and customers are stored as Parquet first, untimed, since a raw table
is read in practice and not computed. ``comparisons`` holds the same work done otherwise: row-at-a-time Python functions, and a
publication that counts and writes four independent results.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
# the Python workers of the comparisons import from here too, wherever the benchmark is started
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

from covenant import apply_contract  # noqa: E402
from covenant.operators.dedup import keep_one  # noqa: E402
from covenant.plans.batch import split  # noqa: E402
from covenant.plans.job import publish  # noqa: E402
from covenant.sinks.writers import write_outcome  # noqa: E402
from showcase.contracts import FORMATS, SCORES, customers_contract, orders_contract  # noqa: E402
from showcase.queries import QUERIES  # noqa: E402
from showcase.raw import raw_customers, raw_orders, table  # noqa: E402
from tests import value_model as model  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: How many times the given orders and customers are repeated; beyond 1, a third of the rows is on one key.
FACTOR = int(os.environ.get("BENCH_FACTOR", "1"))
HEADLINE = ("bundled_fraud_flags", "dedup_keep_last", "dedup_tiebreak", "rule_unique")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # no call-site capture per column operation: it slows plan building on the driver
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(work: Callable[[], object], repeats: int = 3) -> float:
    work()
    taken = []
    for _ in range(repeats):
        start = time.perf_counter()
        work()
        taken.append(time.perf_counter() - start)
    return round(statistics.median(taken), 3)


def to_noop(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


# --- the same contracts with Python functions per row --------------------------------------------


def landed(df: DataFrame, folder: str) -> DataFrame:
    """The raw table as it would lie in storage, in as many files as there are cores."""
    df.repartition(int(CPUS)).write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def many(df: DataFrame, key: str, hot: str) -> DataFrame:
    """FACTOR copies of a table with keys of their own, of which a third share one key and one value of ``hot``."""
    if FACTOR == 1:
        return df
    copies = df.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(FACTOR))))
    third = F.xxhash64(*df.columns, "__copy") % 3 == 0
    number = F.lit(10**8) * F.col("__copy")
    own = F.concat_ws("-", key, "__copy") if key == "txn_id" else (F.col(key).try_cast("long") + number).cast("string")
    value = F.when(third, "same@example.org" if hot == "email_txt" else "HOT").otherwise(F.concat_ws("-", hot, "__copy"))
    one = F.lit("T1" if key == "txn_id" else "1")
    return copies.withColumns({hot: F.when(F.col(hot).isNotNull(), value), key: F.when(F.col(key).isNotNull(), F.when(third, one).otherwise(own))}).drop("__copy")


def counted_texts(documents: DataFrame) -> DataFrame:
    """The unique check by a window that counts."""
    return documents.select("doc_id", F.count("text").over(Window.partitionBy("text")) > 1)


def windowed(lines: DataFrame) -> DataFrame:
    """Dedup by a window over the rows of a key, all columns in its order."""
    order = [F.desc_nulls_last(c) for c in ("l_shipdate", *(c for c in sorted(lines.columns) if c not in ("l_orderkey", "l_shipdate")))]
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
    return lines.withColumn("place", place).where("place = 1").drop("place")


def without_group_limit(spark: SparkSession, work: Callable[[], object]) -> None:
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    usual = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        work()
    finally:
        spark.conf.set(key, usual)


def udf_orders(raw: DataFrame) -> DataFrame:
    amount = F.udf(model.amount, "double")
    score = F.udf(lambda text: model.score(text, SCORES), "double")
    typed = raw.select(
        "order_id",
        "txn_id",
        F.col("cust_txt").try_cast("long").alias("cust_txt"),
        amount("amount_txt").try_cast("decimal(18,2)").alias("amount_txt"),
        F.coalesce(*[F.try_to_timestamp("ts_txt", F.lit(f)) for f in FORMATS]).alias("ts_txt"),
        "method",
        score("score_txt").alias("score_txt"),
        "status",
    )
    return split(typed, orders_contract()).valid


def udf_customers(raw: DataFrame) -> DataFrame:
    bare, email = F.udf(model.bare_id, "string"), F.udf(model.email_is_valid, "boolean")
    valid_id = F.udf(model.id_is_valid, "boolean")
    typed = raw.select(
        F.col("cust_txt").try_cast("long").alias("cust_txt"),
        "cust_name",
        "email_txt",
        bare("doc_txt").alias("doc_txt"),
        F.col("since_txt").try_cast("date").alias("since_txt"),
        "balance",
        "segment",
    )
    complete = typed.where("cust_txt IS NOT NULL AND cust_name IS NOT NULL AND since_txt IS NOT NULL")
    kept = keep_one(complete, ["cust_txt"], "since_txt")
    shared = F.count(F.lit(1)).over(Window.partitionBy("email_txt")) > 1
    return kept.withColumns(
        {
            "bad_email": F.col("email_txt").isNotNull() & ~email("email_txt"),
            "dup_email": F.col("email_txt").isNotNull() & shared,
            "bad_doc": F.col("doc_txt").isNotNull() & ~valid_id("doc_txt"),
        }
    )


def four_actions(raw: DataFrame, target: str) -> None:
    """Two counts and two writes over results that share nothing."""
    declared = orders_contract(amount="quarantine", partition_by=[])
    outcome = apply_contract(raw, declared)
    outcome.valid.count()
    outcome.quarantine.count()
    write_outcome(outcome, declared, target)


def main() -> None:
    spark = session()
    scratch = tempfile.mkdtemp(prefix="bench-")
    orders = landed(many(raw_orders(spark, SF_DIR), "txn_id", "method"), f"{scratch}/orders")
    customers = landed(many(raw_customers(spark, SF_DIR), "cust_txt", "email_txt"), f"{scratch}/customers")
    lines = table(spark, SF_DIR, "lineitem")
    warn, mixed = orders_contract(), orders_contract(amount="quarantine")
    people = customers_contract()
    unpartitioned = orders_contract(amount="quarantine", partition_by=[])

    works: dict[str, Callable[[], object]] = {
        "conform_orders": lambda: to_noop(apply_contract(orders, warn).valid),
        "quarantine_orders": lambda: to_noop(apply_contract(orders, mixed).quarantine),
        "conform_customers": lambda: to_noop(apply_contract(customers, people).valid),
        "dedup_lineitem": lambda: to_noop(keep_one(lines, ["l_orderkey"], "l_shipdate")),
        "publish_orders": lambda: publish(spark, unpartitioned, f"{scratch}/out", source=orders),
    }
    for name in HEADLINE:
        works[name] = lambda name=name: to_noop(QUERIES[name](spark, SF_DIR))
    others: dict[str, Callable[[], object]] = {
        "conform_orders_python_udf": lambda: to_noop(udf_orders(orders)),
        "conform_customers_python_udf": lambda: to_noop(udf_customers(customers)),
        "dedup_lineitem_window": lambda: to_noop(windowed(lines)),
        "dedup_lineitem_no_group_limit": lambda: without_group_limit(spark, lambda: to_noop(windowed(lines))),
        "rule_unique_count_window": lambda: to_noop(counted_texts(table(spark, SF_DIR, "documents"))),
        "publish_orders_four_actions": lambda: four_actions(orders, f"{scratch}/out"),
    }
    out = sys.stdout
    sys.stdout = sys.stderr  # the job prints its own lines
    timed = {name: seconds(work) for name, work in works.items()}
    comparisons = {name: seconds(work) for name, work in others.items()}
    sys.stdout = out
    result = {
        "metric": "contract_conformance_total",
        "value": round(sum(timed.values()), 3),
        "unit": "sec",
        "queries": timed,
        "comparisons": comparisons,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "cpus": int(CPUS),
        "factor": FACTOR,
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
