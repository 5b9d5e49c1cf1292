"""One query per operator: ``(spark, sf_dir) -> DataFrame`` over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covenant import Contract, apply_contract
from covenant.contract import FLAGS, REASON, UNDECLARED
from covenant.functions import (
    clean_numeric,
    is_valid_email,
    normalize_cpf,
    normalize_score,
    parse_timestamp,
    validate_cpf,
)
from covenant.operators.dedup import keep_one
from covenant.operators.expectations import (
    expect_or_drop,
    expectation_counts,
    hard_expectations,
    soft_expectations,
)
from covenant.operators.final import derive, final_columns
from covenant.operators.required import complete_rows, incomplete_rows
from covenant.operators.rules import judge
from covenant.operators.typing import conform
from covenant.plans.job import bundled_contracts, publish, run
from covenant.plans.named import create_views
from covenant.sinks.report import quality_report, report_frame
from covenant.sinks.staging import shared_folder
from covenant.sinks.writers import write_outcome
from covenant.sources import read_source
from showcase.contracts import (
    FORMATS,
    SCORES,
    contract,
    customers_contract,
    fraud_contract,
    orders_contract,
)
from showcase.raw import as_text, raw_customers, raw_fraud, raw_orders, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    """Register a query under its function's name, less a suffix that keeps it off library names."""
    QUERIES[run.__name__.removesuffix("_query")] = run
    return run


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/showcase/{spark.conf.get('spark.app.id')}/{name}"


# --- whole contracts ---------------------------------------------------------------------------


@query
def conform_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_text(apply_contract(raw_orders(spark, sf_dir), orders_contract()).valid)


@query
def quarantine_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = apply_contract(raw_orders(spark, sf_dir), orders_contract(amount="quarantine"))
    return as_text(found.quarantine)


@query
def conform_fraud_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_text(apply_contract(raw_fraud(spark, sf_dir), fraud_contract()).valid)


def _bundled(name: str) -> Contract:
    return next(c for c in bundled_contracts() if c.name == f"{name}_silver")


def _as_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_orders(spark, sf_dir).select(
        F.col("txn_id").alias("transaction_id"),
        F.col("cust_txt").alias("customer_id"),
        F.col("amount_txt").alias("transaction_amount"),
        F.col("ts_txt").alias("transaction_date"),
        F.col("method").alias("payment_method"),
        F.col("order_id").alias("source_key"),
    )


def _as_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_customers(spark, sf_dir).select(
        F.col("cust_txt").alias("customer_id"),
        F.col("cust_name").alias("customer_name"),
        F.col("email_txt").alias("customer_email"),
        F.col("doc_txt").alias("customer_cpf"),
        F.col("since_txt").alias("registration_date"),
    )


@query
def bundled_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = apply_contract(_as_transactions(spark, sf_dir), _bundled("transactions"))
    return as_text(found.valid)


@query
def bundled_transactions_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = apply_contract(_as_transactions(spark, sf_dir), _bundled("transactions"))
    return as_text(found.quarantine)


@query
def bundled_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_text(apply_contract(_as_customers(spark, sf_dir), _bundled("customers")).valid)


@query
def bundled_customers_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_text(apply_contract(_as_customers(spark, sf_dir), _bundled("customers")).quarantine)


@query
def bundled_fraud_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_text(apply_contract(raw_fraud(spark, sf_dir), _bundled("fraud_flags")).valid)


@query
def bundled_fraud_flags_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_text(apply_contract(raw_fraud(spark, sf_dir), _bundled("fraud_flags")).quarantine)


# --- sources -------------------------------------------------------------------------------------


@query
def scan_json_conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "orders.json")
    raw_orders(spark, sf_dir).write.mode("overwrite").json(path)
    source = {"format": "json", "path": path, "fields": ["order_id", "status"]}
    declared = orders_contract(source=source)
    return as_text(apply_contract(read_source(spark, declared), declared).valid)


@query
def scan_json_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "orders_inferred.json")
    raw_orders(spark, sf_dir).write.mode("overwrite").json(path)
    declared = orders_contract(source={"format": "json", "path": path, "infer": True})
    return as_text(apply_contract(read_source(spark, declared), declared).quarantine)


@query
def scan_csv_conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "customers.csv")
    keep_spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    raw = raw_customers(spark, sf_dir)
    raw.write.mode("overwrite").options(header=True, **keep_spaces).csv(path)
    declared = customers_contract(source={"format": "csv", "path": path})
    return as_text(apply_contract(read_source(spark, declared), declared).valid)


@query
def scan_table_conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw_fraud(spark, sf_dir).createOrReplaceTempView("raw_fraud_view")
    declared = fraud_contract(source={"format": "table", "path": "raw_fraud_view"})
    return as_text(apply_contract(read_source(spark, declared), declared).quarantine)


@query
def scan_json_extra_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that no contract declares, as the quarantine shows them; one declared name differs in case."""
    path = _folder(spark, "orders_extra.json")
    raw = raw_orders(spark, sf_dir).withColumnRenamed("txn_id", "Txn_ID")
    raw.write.mode("overwrite").json(path)
    declared = orders_contract(source={"format": "json", "path": path})
    rejected = apply_contract(read_source(spark, declared), declared).quarantine
    extra = {name: F.try_element_at(UNDECLARED, F.lit(name)).alias(name) for name in ("order_id", "status")}
    return rejected.select(*extra.values(), REASON, "txn_id")


@query
def scan_csv_corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the quarantine shows of records with a surplus field, and of others."""
    path = _folder(spark, "surplus.csv")
    number = F.col("c_custkey") + 1  # the first line, by which Spark counts the columns, has no surplus
    key = F.when(number % 5 != 0, number).cast("string")
    surplus = F.when(number % 10 == 0, F.lit("surplus"))
    line = F.concat_ws(",", F.coalesce(key, F.lit("")), "c_name", surplus)
    table(spark, sf_dir, "customer").select(line).write.mode("overwrite").text(path)
    columns = [{"name": "_c0", "type": "long", "nullable": False}, {"name": "_c1", "type": "string"}]
    source = {"format": "csv", "path": path, "options": {"header": "false", "columnNameOfCorruptRecord": "whole_text"}}
    declared = contract("surplus", columns, source=source)
    rejected = apply_contract(read_source(spark, declared), declared).quarantine
    return rejected.select(F.col("_c1").alias("name"), "whole_text", REASON)


@query
def publish_json_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid table of a job over JSON lines, whose typed rows land once and feed both tables."""
    path, out = _folder(spark, "published.json"), _folder(spark, "published")
    raw_orders(spark, sf_dir).write.mode("overwrite").json(path)
    source = {"format": "json", "path": path, "fields": ["order_id", "status"]}
    declared = orders_contract(source=source, partition_by=[])
    publish(spark, declared, out)
    return as_text(spark.read.parquet(f"{out}/{declared.name}"))


@query
def publish_json_once_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quarantine of the same job, with the fields that no contract declares."""
    path, out = _folder(spark, "rejected.json"), _folder(spark, "rejected")
    raw_orders(spark, sf_dir).withColumnRenamed("txn_id", "Txn_ID").write.mode("overwrite").json(path)
    declared = orders_contract(source={"format": "json", "path": path}, partition_by=[])
    publish(spark, declared, out)
    rejected = spark.read.parquet(f"{out}/{declared.name}_quarantine")
    extra = {name: F.try_element_at(UNDECLARED, F.lit(name)).alias(name) for name in ("order_id", "status")}
    return rejected.select(*extra.values(), REASON, "txn_id")


# --- sinks and report ----------------------------------------------------------------------------


def _written(spark: SparkSession, sf_dir: str, name: str) -> tuple[Contract, str]:
    declared = orders_contract(amount="quarantine", partition_by=["method"])
    path = _folder(spark, name)
    write_outcome(apply_contract(raw_orders(spark, sf_dir), declared), declared, path)
    return declared, path


@query
def sink_partitioned_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared, path = _written(spark, sf_dir, "valid_sink")
    return as_text(spark.read.parquet(f"{path}/{declared.name}"))


@query
def sink_quarantine_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared, path = _written(spark, sf_dir, "quarantine_sink")
    return as_text(spark.read.parquet(f"{path}/{declared.name}_quarantine"))


@query
def sink_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both managed tables, in a schema that the write creates."""
    declared = orders_contract(amount="quarantine", partition_by=["method"])
    schema = f"silver_{spark.conf.get('spark.app.id').replace('-', '_').replace('.', '_')}"
    write_outcome(apply_contract(raw_orders(spark, sf_dir), declared), declared, f"spark_catalog.{schema}")
    valid = spark.table(f"{schema}.{declared.name}").select("txn_id", F.lit(None).cast("string").alias("reason"))
    rejected = spark.table(f"{schema}.{declared.name}_quarantine").select("txn_id", F.col(REASON).alias("reason"))
    both = [df.withColumn("result", F.lit(name)) for name, df in (("valid", valid), ("quarantine", rejected))]
    return both[0].unionByName(both[1])


@query
def job_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over three raw files that lie elsewhere than the bundled contracts say: rows per table."""
    base = _folder(spark, "landing")
    keep_spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    _as_transactions(spark, sf_dir).write.mode("overwrite").json(f"{base}/transactions.json")
    _as_customers(spark, sf_dir).write.mode("overwrite").options(header=True, **keep_spaces).csv(f"{base}/customers.csv")
    raw_fraud(spark, sf_dir).write.mode("overwrite").json(f"{base}/fraud_flags.json")
    report = run(spark, bundled_contracts(), _folder(spark, "silver.v1"), base, as_table=False)
    return report.where(F.col("metric").isin("valid", "quarantine"))


@query
def quality_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = customers_contract(balance="quarantine")
    outcome = apply_contract(raw_customers(spark, sf_dir), declared)
    return quality_report(outcome, declared)


@query
def job_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = customers_contract(balance="quarantine", partition_by=[])
    raw = raw_customers(spark, sf_dir)
    return report_frame(spark, publish(spark, declared, _folder(spark, "job"), source=raw))


# --- typing --------------------------------------------------------------------------------------


@query
def schema_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_orders(spark, sf_dir).drop("method", "score_txt")
    return as_text(conform(raw, orders_contract()))


@query
def typed_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = contract(
        "casts",
        [
            {"name": "order_id", "type": "int"},
            {"name": "cust_txt", "type": "long"},
            {"name": "amount_txt", "type": "double"},
            {"name": "ts_txt", "type": "timestamp"},
            {"name": "status", "type": "boolean"},
        ],
    )
    typed = conform(raw_orders(spark, sf_dir), declared)
    return as_text(typed.select("order_id", "cust_txt", "amount_txt", "ts_txt", "status"))


@query
def parse_timestamp_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that are a time or a date already, under a transform whose formats describe text."""
    stamp = {"type": "timestamp", "nullable": False, "transform": "parse_timestamp", "formats": FORMATS}
    columns = [{"name": "o_orderkey", "type": "long"}, {"name": "o_orderdate", **stamp}, {"name": "day", **stamp}]
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.to_date("o_orderdate").alias("day"))
    found = apply_contract(orders, contract("typed_times", columns))
    names = ("o_orderkey", "o_orderdate", "day")
    rejected = found.quarantine.select(*names, REASON)
    return as_text(found.valid.select(*names, F.lit(None).cast("string").alias(REASON)).unionByName(rejected))


@query
def typed_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [
        {"name": "o_orderkey", "type": "string"},
        {"name": "o_totalprice", "type": "decimal( 7 , 2 )"},
        {"name": "o_custkey", "type": "double"},
    ]
    typed = conform(table(spark, sf_dir, "orders"), contract("decimals", columns))
    return as_text(typed.select("o_orderkey", "o_totalprice", "o_custkey"))


@query
def derive_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [
        {"name": "o_orderkey", "type": "long"},
        {"name": "o_orderdate", "type": "timestamp"},
    ]
    derived = [{"name": "day", "from": "o_orderdate"}]
    declared = contract("dated", columns, derived=derived)
    typed = conform(table(spark, sf_dir, "orders"), declared)
    return as_text(final_columns(derive(judge(typed, declared), declared), declared))


# --- value functions -----------------------------------------------------------------------------


@query
def clean_numeric_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_orders(spark, sf_dir)
    return raw.select("order_id", clean_numeric(F.col("amount_txt")).alias("amount"))


@query
def parse_timestamp_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_orders(spark, sf_dir)
    return as_text(raw.select("order_id", parse_timestamp(F.col("ts_txt"), FORMATS).alias("ts")))


@query
def normalize_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_customers(spark, sf_dir)
    return raw.select("cust_name", "doc_txt", normalize_cpf(F.col("doc_txt")).alias("doc"))


@query
def normalize_score_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_orders(spark, sf_dir)
    return raw.select("order_id", normalize_score(F.col("score_txt"), SCORES).alias("score"))


@query
def valid_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_customers(spark, sf_dir)
    return raw.select("cust_name", "doc_txt", validate_cpf(F.col("doc_txt")).alias("ok"))


@query
def valid_email_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_customers(spark, sf_dir)
    return raw.select("cust_name", "email_txt", is_valid_email(F.col("email_txt")).alias("ok"))


# --- hard rules ----------------------------------------------------------------------------------


def _reasons(typed: DataFrame, declared: Contract) -> DataFrame:
    return incomplete_rows(typed, declared).select("order_id", REASON)


@query
def hard_null_pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = orders_contract(primary_key=["txn_id", "cust_txt", "ts_txt"])
    return _reasons(conform(raw_orders(spark, sf_dir), declared), declared)


@query
def hard_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = orders_contract(primary_key=[])
    return _reasons(conform(raw_orders(spark, sf_dir), declared), declared)


@query
def hard_split_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = orders_contract()
    return as_text(complete_rows(conform(raw_orders(spark, sf_dir), declared), declared))


# --- dedup ---------------------------------------------------------------------------------------


@query
def dedup_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_text(keep_one(table(spark, sf_dir, "events"), ["user_id"], "ts", "last"))


@query
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = conform(raw_orders(spark, sf_dir), orders_contract())
    return as_text(keep_one(typed, ["txn_id"], "ts_txt", "first"))


@query
def dedup_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_text(keep_one(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]))


@query
def dedup_extra_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and sources are no part of the contract: they are neither read nor shuffled."""
    columns = [{"name": "lang", "type": "string", "nullable": False}, {"name": "doc_id", "type": "long"}]
    declared = contract("languages", columns, dedup={"keys": ["lang"], "order_by": "doc_id", "keep": "last"})
    return as_text(apply_contract(table(spark, sf_dir, "documents"), declared).valid)


@query
def schema_no_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a declaration all rows stay, repeated keys too."""
    columns = [{"name": "l_orderkey", "type": "long", "nullable": False}, {"name": "l_linenumber", "type": "int"}]
    declared = contract("lines", columns, primary_key=["l_orderkey"])
    return as_text(apply_contract(table(spark, sf_dir, "lineitem"), declared).valid)


# --- soft rules and policies ---------------------------------------------------------------------


@query
def rule_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"regex": r"^http://[a-z]+\.example\.com/(en|de)/"}
    columns = [{"name": "page_id", "type": "long"}, {"name": "url", "type": "string", "rules": rules}]
    declared = contract("urls", columns)
    judged = judge(conform(table(spark, sf_dir, "pages"), declared), declared)
    return as_text(final_columns(judged, declared))


@query
def rule_check_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [
        {"name": "cust_name", "type": "string"},
        {"name": "doc_txt", "type": "string", "rules": {"valid_cpf": True}},
    ]
    declared = contract("documents", columns)
    judged = judge(conform(raw_customers(spark, sf_dir), declared), declared)
    return as_text(final_columns(judged, declared))


@query
def rule_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [
        {"name": "cust_name", "type": "string"},
        {"name": "email_txt", "type": "string", "rules": {"valid_email": True}},
    ]
    declared = contract("emails", columns)
    judged = judge(conform(raw_customers(spark, sf_dir), declared), declared)
    return as_text(final_columns(judged, declared))


@query
def rule_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [
        {"name": "c_custkey", "type": "long"},
        {"name": "c_acctbal", "type": "double", "rules": {"min": 0, "max": 9000.5}},
    ]
    declared = contract("balances", columns)
    judged = judge(conform(table(spark, sf_dir, "customer"), declared), declared)
    return as_text(final_columns(judged, declared))


@query
def rule_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [
        {"name": "doc_id", "type": "long"},
        {"name": "text", "type": "string", "rules": {"unique": True}},
    ]
    declared = contract("texts", columns)
    judged = judge(conform(table(spark, sf_dir, "documents"), declared), declared)
    return as_text(judged.select("doc_id", FLAGS))


@query
def rule_unique_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three unique columns, two of them emptied where they repeat, one only after a pattern has emptied it too."""
    columns = [
        {"name": "event_id", "type": "long"},
        {"name": "user_id", "type": "long", "rules": {"unique": True, "on_fail": "warn"}},
        {"name": "event_type", "type": "string", "rules": {"unique": True, "on_fail": "nullify"}},
        {"name": "props", "type": "string", "rules": {"regex": "1", "unique": True, "on_fail": "nullify"}},
    ]
    declared = contract("events", columns)
    return as_text(apply_contract(table(spark, sf_dir, "events"), declared).valid)


def _customers(spark: SparkSession, sf_dir: str, policy: str):
    declared = customers_contract(email=policy, document=policy, balance=policy)
    return apply_contract(raw_customers(spark, sf_dir), declared)


@query
def policy_warn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_text(_customers(spark, sf_dir, "warn").valid)


@query
def policy_nullify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_text(_customers(spark, sf_dir, "nullify").valid)


@query
def policy_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_text(_customers(spark, sf_dir, "quarantine").valid)


@query
def policy_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = customers_contract(email="warn", document="nullify", balance="quarantine")
    return as_text(apply_contract(raw_customers(spark, sf_dir), declared).quarantine)


@query
def soft_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = _customers(spark, sf_dir, "quarantine").quarantine
    return as_text(rejected.where(F.col(REASON).startswith("rule_violation")))


# --- expectations and named datasets -------------------------------------------------------------


@query
def hard_expectations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = orders_contract()
    typed = conform(raw_orders(spark, sf_dir), declared)
    return expectation_counts(typed, hard_expectations(declared))


@query
def expect_or_drop_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = orders_contract()
    typed = conform(raw_orders(spark, sf_dir), declared)
    return as_text(expect_or_drop(typed, hard_expectations(declared), computed=True))


@query
def soft_expectations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = customers_contract()
    valid = apply_contract(raw_customers(spark, sf_dir), declared).valid
    return expectation_counts(valid, soft_expectations(declared))


@query
def declarative_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = create_views(spark, orders_contract(), raw_orders(spark, sf_dir))
    return as_text(spark.table(names[3]))


@query
def declarative_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = create_views(spark, orders_contract(amount="quarantine"), raw_orders(spark, sf_dir))
    return as_text(spark.table(names[4]))
