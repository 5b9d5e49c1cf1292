"""Raw tables for the registered queries: the clean test tables, made dirty by rule.

The rules are SQL that Spark and DuckDB both read; only whole-number division is spelled
differently. They produce the inputs; nothing of what the library does is in here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# o_totalprice as whole cents, then as text in several notations
_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_UNITS = f"CAST({_CENTS} {{div}} 100 AS STRING)"
_THOUSANDS = f"CAST({_CENTS} {{div}} 100000 AS STRING)"
_REST = f"lpad(CAST(({_CENTS} {{div}} 100) % 1000 AS STRING), 3, '0')"
_FRACTION = f"lpad(CAST({_CENTS} % 100 AS STRING), 2, '0')"
_HOUR = "lpad(CAST(o_orderkey % 24 AS STRING), 2, '0')"
_MINUTE = "lpad(CAST(o_orderkey % 60 AS STRING), 2, '0')"
_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"

RAW_ORDERS = {
    "order_id": "o_orderkey",
    "txn_id": """CASE WHEN o_orderkey % 97 = 0 THEN NULL
        WHEN o_orderkey % 50 = 7 THEN 'T' || CAST(o_orderkey - 1 AS STRING)
        ELSE 'T' || CAST(o_orderkey AS STRING) END""",
    "cust_txt": """CASE WHEN o_orderkey % 89 = 3 THEN 'unknown'
        ELSE CAST(o_custkey AS STRING) END""",
    "amount_txt": f"""CASE WHEN o_orderkey % 53 = 0 THEN 'to follow'
        WHEN o_orderkey % 82 = 0 THEN ' +' || CAST({_CENTS} AS STRING) || 'E-2 '
        WHEN o_orderkey % 41 = 0 THEN CAST({_CENTS} AS STRING) || 'e-2'
        WHEN o_orderkey % 5 = 0 THEN {_UNITS} || '.' || {_FRACTION}
        WHEN o_orderkey % 5 = 1 THEN 'R$ ' || {_THOUSANDS} || '.' || {_REST} || ',' || {_FRACTION}
        WHEN o_orderkey % 5 = 2 THEN {_UNITS} || ',' || {_FRACTION}
        WHEN o_orderkey % 5 = 3 THEN '  ' || {_UNITS} || '.' || {_FRACTION} || ' '
        ELSE '-' || {_UNITS} || '.' || {_FRACTION} || ' BRL' END""",
    "ts_txt": f"""CASE WHEN o_orderkey % 61 = 0 THEN '31/12/1999'
        WHEN o_orderkey % 2 = 0 THEN {_DAY} || 'T' || {_HOUR} || ':' || {_MINUTE} || ':07Z'
        ELSE {_DAY} || ' ' || {_HOUR} || ':' || {_MINUTE} || ':08' END""",
    "method": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END",
    "score_txt": """CASE WHEN o_orderkey % 71 = 0 THEN '???'
        WHEN o_orderkey % 73 = 0 THEN 'nan'
        WHEN o_orderkey % 79 = 0 THEN NULL
        WHEN o_orderkey % 4 = 0 THEN 'LOW'
        WHEN o_orderkey % 4 = 1 THEN ' medium '
        WHEN o_orderkey % 4 = 2 THEN '0.' || CAST(o_orderkey % 100 AS STRING)
        WHEN o_orderkey % 3 = 0 THEN '-1e-1'
        ELSE '1.7' END""",
    "status": "o_orderstatus",
}

# nine digits out of the key, then two check digits by the public rule; some spoiled on purpose
_BASE = "lpad(CAST((c_custkey * 7919 + 12345678) % 1000000000 AS STRING), 9, '0')"


def _weighted(digits: str, count: int) -> str:
    terms = [
        f"CAST(substr({digits}, {i + 1}, 1) AS INT) * {count + 1 - i}" for i in range(count)
    ]
    return f"CAST((({' + '.join(terms)}) * 10) % 11 % 10 AS STRING)"


RAW_CUSTOMERS_BASE = {
    "base9": _BASE,
    "key": "c_custkey",
    "nation": "c_nationkey",
    "name": "c_name",
    "balance": "c_acctbal",
    "segment": "c_mktsegment",
}
_TEN = {**{c: c for c in RAW_CUSTOMERS_BASE}, "base10": "base9 || " + _weighted("base9", 9)}
_ELEVEN = {**{c: c for c in _TEN}, "doc11": "base10 || " + _weighted("base10", 10)}
RAW_CUSTOMERS = {
    "cust_txt": """CASE WHEN key % 101 = 5 THEN NULL WHEN key % 60 = 11
        THEN CAST(key - 1 AS STRING) ELSE CAST(key AS STRING) END""",
    "cust_name": "CASE WHEN key % 83 = 9 THEN NULL ELSE name END",
    "email_txt": """CASE WHEN key % 6 = 0 THEN 'user' || CAST(key AS STRING) || '@mail.example.com'
        WHEN key % 6 = 1 THEN 'team' || CAST(key {div} 12 AS STRING) || '@example.org'
        WHEN key % 6 = 2 THEN 'broken@host'
        WHEN key % 6 = 3 THEN '  pad' || CAST(key AS STRING) || '@b.co '
        WHEN key % 6 = 4 THEN NULL
        ELSE 'no-at-sign' || CAST(key AS STRING) END""",
    "doc_txt": """CASE WHEN key % 29 = 0 THEN '111.111.111-11'
        WHEN key % 4 = 0 THEN doc11
        WHEN key % 4 = 1 THEN substr(doc11, 1, 3) || '.' || substr(doc11, 4, 3) || '.'
            || substr(doc11, 7, 3) || '-' || substr(doc11, 10, 2)
        WHEN key % 4 = 2 THEN base10 || CAST((CAST(substr(doc11, 11, 1) AS INT) + 1) % 10 AS STRING)
        ELSE '123' END""",
    "since_txt": """'20' || CAST(18 + key % 7 AS STRING) || '-' || lpad(CAST(1 + key % 12 AS STRING), 2, '0')
        || '-' || lpad(CAST(1 + key % 28 AS STRING), 2, '0')""",
    "balance": "balance",
    "segment": "segment",
}

RAW_FRAUD = {
    "transaction_id": """CASE WHEN event_id % 113 = 2 THEN NULL
        ELSE 'E' || CAST(event_id - event_id % 5 {div} 4 AS STRING) END""",
    "fraud_score": """CASE WHEN event_id % 5 = 0 THEN 'MEDIUM' WHEN event_id % 5 = 1 THEN 'high'
        WHEN event_id % 67 = 0 THEN '' ELSE '0.' || CAST(event_id % 89 AS STRING) END""",
    "fraud_flag": "CASE WHEN event_id % 3 = 0 THEN 'true' WHEN event_id % 3 = 1 THEN 'false' END",
    "fraud_reason": "CASE WHEN event_id % 4 = 0 THEN event_type END",
    "source_key": "event_id",
}


def _columns(rules: dict[str, str], div: str) -> list[str]:
    return [f"{rule.format(div=div)} AS {name}" for name, rule in rules.items()]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").selectExpr(*_columns(RAW_ORDERS, "div"))


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "customer")
    for rules in (RAW_CUSTOMERS_BASE, _TEN, _ELEVEN, RAW_CUSTOMERS):
        df = df.selectExpr(*_columns(rules, "div"))
    return df


def raw_fraud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").selectExpr(*_columns(RAW_FRAUD, "div"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _table(spark, sf_dir, name)


def _sql(rules: dict[str, str], source: str) -> str:
    return f"SELECT {', '.join(_columns(rules, '//'))} FROM {source}"


def raw_sql() -> dict[str, str]:
    """The same raw tables as common table expressions for DuckDB."""
    return {
        "raw_orders": _sql(RAW_ORDERS, "orders"),
        "customers9": _sql(RAW_CUSTOMERS_BASE, "customer"),
        "customers10": _sql(_TEN, "customers9"),
        "customers11": _sql(_ELEVEN, "customers10"),
        "raw_customers": _sql(RAW_CUSTOMERS, "customers11"),
        "raw_fraud": _sql(RAW_FRAUD, "events"),
    }


def as_text(df: DataFrame) -> DataFrame:
    """Plain result types for the comparison: flags, dates and timestamps as text."""
    out = []
    for field in df.schema.fields:
        col, kind = F.col(field.name), field.dataType.simpleString()
        if kind.startswith("array"):
            col = F.concat_ws("|", col)
        elif kind.startswith("timestamp"):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            col = F.date_format(col, "yyyy-MM-dd")
        elif kind.startswith("decimal"):
            col = col.cast("double")
        out.append(col.alias(field.name))
    return df.select(*out)
