"""The registered queries once more, as SQL for DuckDB over the same tables."""

from __future__ import annotations

from showcase.raw import raw_sql

# --- value functions -----------------------------------------------------------------------------


def _clean_numeric(x: str) -> str:
    kept = (
        f"CASE WHEN regexp_full_match(trim({x}), '[+-]?[0-9]+(\\.[0-9]+)?[eE][+-]?[0-9]+') "
        f"THEN ltrim(trim({x}), '+') ELSE regexp_replace({x}, '[^0-9,.-]', '', 'g') END"
    )
    dotted = (
        f"CASE WHEN contains({kept}, ',') THEN replace(replace({kept}, '.', ''), ',', '.') "
        f"ELSE {kept} END"
    )
    return f"TRY_CAST({dotted} AS DOUBLE)"


def _parse_ts(x: str) -> str:
    return f"coalesce(try_strptime({x}, '%Y-%m-%dT%H:%M:%SZ'), try_strptime({x}, '%Y-%m-%d %H:%M:%S'))"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def _normalize_cpf(x: str) -> str:
    return f"CASE WHEN length({_digits(x)}) = 11 THEN {_digits(x)} END"


def _check(d: str, count: int) -> str:
    total = " + ".join(
        f"TRY_CAST(substr({d}, {i + 1}, 1) AS INT) * {count + 1 - i}" for i in range(count)
    )
    return f"({total}) * 10 % 11 % 10 = TRY_CAST(substr({d}, {count + 1}, 1) AS INT)"


def _validate_cpf(x: str) -> str:
    d = _digits(x)
    return (
        f"coalesce(length({d}) = 11 AND {d} <> repeat(substr({d}, 1, 1), 11) "
        f"AND {_check(d, 9)} AND {_check(d, 10)}, FALSE)"
    )


def _valid_email(x: str) -> str:
    return f"coalesce(regexp_full_match(trim({x}), '[^@\\s]+@[^@\\s]+\\.[^@\\s]+'), FALSE)"


def _score(x: str) -> str:
    t = f"upper(trim({x}))"
    number = f"TRY_CAST({t} AS DOUBLE)"
    return (
        f"CASE WHEN {t} = 'NAN' THEN 1.0::DOUBLE "
        f"WHEN {number} IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, {number})) "
        f"WHEN {t} = 'LOW' THEN 0.1::DOUBLE WHEN {t} = 'MEDIUM' THEN 0.5::DOUBLE "
        f"WHEN {t} = 'HIGH' THEN 0.9::DOUBLE END"
    )


def _ts_text(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def _day_text(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def _flags(*pairs: tuple[str, str]) -> str:
    cases = [f"CASE WHEN {hit} THEN '{flag}' END" for hit, flag in pairs]
    return f"concat_ws('|', {', '.join(cases)})" if cases else "''"


def _with(steps: dict[str, str], final: str) -> str:
    parts = [f"{name} AS ({sql})" for name, sql in {**raw_sql(), **steps}.items()]
    return f"WITH {', '.join(parts)} {final}"


# --- orders --------------------------------------------------------------------------------------

_TYPED_ORDERS = f"""SELECT order_id, txn_id, TRY_CAST(cust_txt AS BIGINT) AS cust_txt,
    CAST({_clean_numeric("amount_txt")} AS DECIMAL(18,2)) AS amount_txt, {_parse_ts("ts_txt")} AS ts_txt,
    method, {_score("score_txt")} AS score_txt, status FROM raw_orders"""
_REQUIRED_ORDERS = ("txn_id", "cust_txt", "amount_txt", "ts_txt")
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in _REQUIRED_ORDERS)
_ORDER_REASON = """CASE WHEN txn_id IS NULL THEN 'null_primary_key:txn_id'
    WHEN cust_txt IS NULL THEN 'not_nullable_violation:cust_txt'
    WHEN amount_txt IS NULL THEN 'not_nullable_violation:amount_txt'
    WHEN ts_txt IS NULL THEN 'not_nullable_violation:ts_txt' END"""
_LATEST_ORDER = """row_number() OVER (PARTITION BY txn_id ORDER BY ts_txt DESC NULLS LAST,
    cust_txt DESC NULLS LAST, amount_txt DESC NULLS LAST, method DESC NULLS LAST,
    score_txt DESC NULLS LAST, order_id DESC NULLS LAST, status DESC NULLS LAST) = 1"""
_LOW, _HIGH = "amount_txt < 0", "amount_txt > 400000"
_ORDER_STEPS = {
    "typed": _TYPED_ORDERS,
    "complete": f"SELECT * FROM typed WHERE {_COMPLETE}",
    "kept": f"SELECT * FROM complete QUALIFY {_LATEST_ORDER}",
}
_ORDER_VALUES = f"""txn_id, cust_txt, amount_txt::DOUBLE AS amount_txt, {_ts_text("ts_txt")} AS ts_txt,
    method, score_txt"""
_ORDER_FLAGS = _flags((_LOW, "below_min:amount_txt"), (_HIGH, "above_max:amount_txt"))
_SOFT_ORDER = f"""CASE WHEN {_LOW} THEN 'rule_violation:below_min:amount_txt'
    WHEN {_HIGH} THEN 'rule_violation:above_max:amount_txt' END"""


def _orders_valid(policy: str) -> str:
    flags, keep = (_ORDER_FLAGS, "TRUE") if policy == "warn" else ("''", f"{_SOFT_ORDER} IS NULL")
    return _with(
        _ORDER_STEPS,
        f"""SELECT {_ORDER_VALUES}, {_day_text("ts_txt")} AS ts_day, {flags} AS _dq_flags
        FROM kept WHERE {keep}""",
    )


def _orders_quarantine(policy: str) -> str:
    columns = f"order_id, {_ORDER_VALUES}, status"
    hard = f"SELECT {columns}, {_ORDER_REASON} AS _quarantine_reason, '' AS _dq_flags FROM typed WHERE NOT ({_COMPLETE})"
    soft = f"SELECT {columns}, {_SOFT_ORDER} AS _quarantine_reason, '' AS _dq_flags FROM kept WHERE {_SOFT_ORDER} IS NOT NULL"
    return _with(_ORDER_STEPS, f"{hard} UNION ALL {soft}" if policy == "quarantine" else hard)


_TRANSACTION_STEPS = {
    "named": """SELECT txn_id AS transaction_id, cust_txt AS customer_id,
        amount_txt AS transaction_amount, ts_txt AS transaction_date, method AS payment_method,
        order_id AS source_key FROM raw_orders""",
    "typed": f"""SELECT transaction_id, TRY_CAST(customer_id AS BIGINT) AS customer_id,
        CAST({_clean_numeric("transaction_amount")} AS DECIMAL(18,2)) AS transaction_amount,
        {_parse_ts("transaction_date")} AS transaction_date, payment_method, source_key FROM named""",
    "kept": """SELECT * FROM typed WHERE transaction_id IS NOT NULL AND customer_id IS NOT NULL
        AND transaction_amount IS NOT NULL AND transaction_date IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY transaction_id
        ORDER BY transaction_date DESC NULLS LAST, customer_id DESC NULLS LAST,
        transaction_amount DESC NULLS LAST, payment_method DESC NULLS LAST, source_key DESC) = 1""",
}
_TRANSACTION_VALUES = f"""transaction_id, customer_id, transaction_amount::DOUBLE AS transaction_amount,
    {_ts_text("transaction_date")} AS transaction_date, payment_method"""

# --- customers -----------------------------------------------------------------------------------

_CUSTOMER_STEPS = {
    "typed": f"""SELECT TRY_CAST(cust_txt AS BIGINT) AS cust_txt, cust_name, email_txt,
        {_normalize_cpf("doc_txt")} AS doc_txt, TRY_CAST(since_txt AS DATE) AS since_txt, balance, segment
        FROM raw_customers""",
    "kept": """SELECT * FROM typed
        WHERE cust_txt IS NOT NULL AND cust_name IS NOT NULL AND since_txt IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY cust_txt ORDER BY since_txt DESC NULLS LAST,
        cust_name DESC NULLS LAST, email_txt DESC NULLS LAST, doc_txt DESC NULLS LAST,
        balance DESC NULLS LAST, segment DESC NULLS LAST) = 1""",
    "checked": f"""SELECT *, email_txt IS NOT NULL AND NOT {_valid_email("email_txt")} AS bad_email,
        doc_txt IS NOT NULL AND NOT {_validate_cpf("doc_txt")} AS bad_doc,
        coalesce(balance < 0, FALSE) AS low, coalesce(balance > 9000, FALSE) AS high FROM kept""",
    "judged": """SELECT *, email_txt IS NOT NULL
        AND count(*) OVER (PARTITION BY email_txt) > 1 AS dup FROM checked""",
    # under nullify, only values that passed the earlier check are compared
    "left_email": "SELECT *, CASE WHEN NOT bad_email THEN email_txt END AS mail FROM checked",
    "judged_left": """SELECT *, mail IS NOT NULL
        AND count(*) OVER (PARTITION BY mail) > 1 AS dup FROM left_email""",
}
_CUSTOMER_FLAGS = {
    "email": (("bad_email", "invalid_email:email_txt"), ("dup", "duplicate:email_txt")),
    "doc": (("bad_doc", "invalid_cpf:doc_txt"),),
    "balance": (("low", "below_min:balance"), ("high", "above_max:balance")),
}
_SINCE = _day_text("since_txt")


def _customers_valid(values: str, source: str, kinds: tuple[str, ...], keep: str = "TRUE") -> str:
    flags = _flags(*[pair for kind in kinds for pair in _CUSTOMER_FLAGS[kind]])
    return _with(
        _CUSTOMER_STEPS,
        f"SELECT cust_txt, cust_name, {values}, {_SINCE} AS since_txt, {_SINCE} AS since_day, "
        f"{flags} AS _dq_flags FROM {source} WHERE {keep}",
    )


_RAISED = [pair for pairs in _CUSTOMER_FLAGS.values() for pair in pairs]
_CUSTOMER_SOFT = (
    "CASE " + " ".join(f"WHEN {hit} THEN 'rule_violation:{flag}'" for hit, flag in _RAISED) + " END"
)
_CUSTOMER_HARD = """CASE WHEN cust_txt IS NULL THEN 'null_primary_key:cust_txt'
    WHEN cust_name IS NULL THEN 'not_nullable_violation:cust_name'
    WHEN since_txt IS NULL THEN 'not_nullable_violation:since_txt' END"""
_BALANCE_SOFT = """CASE WHEN low THEN 'rule_violation:below_min:balance'
    WHEN high THEN 'rule_violation:above_max:balance' END"""
_TWO_FLAGS = _flags(*_CUSTOMER_FLAGS["email"], *_CUSTOMER_FLAGS["doc"])
_AS_RAW = f"cust_txt, cust_name, email_txt, doc_txt, {_SINCE} AS since_txt, balance, segment"
_NULLED_DOC = _AS_RAW.replace("doc_txt", "CASE WHEN NOT bad_doc THEN doc_txt END AS doc_txt")
_DEFAULT_CUSTOMERS = _customers_valid(
    "email_txt, CASE WHEN NOT bad_doc THEN doc_txt END AS doc_txt, balance",
    "judged",
    ("email", "doc", "balance"),
)
_MIXED_CUSTOMERS = _with(
    _CUSTOMER_STEPS,
    f"""SELECT {_AS_RAW}, {_CUSTOMER_HARD} AS _quarantine_reason, '' AS _dq_flags FROM typed
    WHERE {_CUSTOMER_HARD} IS NOT NULL UNION ALL
    SELECT {_NULLED_DOC}, {_BALANCE_SOFT} AS _quarantine_reason, {_TWO_FLAGS} AS _dq_flags
    FROM judged WHERE {_BALANCE_SOFT} IS NOT NULL""",
)
_CUSTOMER_REPORT = _with(
    {
        **_CUSTOMER_STEPS,
        "good": f"SELECT * FROM judged WHERE {_BALANCE_SOFT} IS NULL",
        "bad": f"""SELECT {_CUSTOMER_HARD} AS reason FROM typed WHERE {_CUSTOMER_HARD} IS NOT NULL
            UNION ALL SELECT {_BALANCE_SOFT} FROM judged WHERE {_BALANCE_SOFT} IS NOT NULL""",
        "counts": " UNION ALL ".join(
            [
                "SELECT 'valid' AS metric, count(*) AS n FROM good",
                *[
                    f"SELECT '{flag}', count(*) FILTER (WHERE {hit}) FROM good"
                    for hit, flag in (*_CUSTOMER_FLAGS["email"], *_CUSTOMER_FLAGS["doc"])
                ],
                "SELECT 'quarantine', count(*) FROM bad",
                *[
                    f"SELECT '{code}', count(*) FILTER (WHERE reason = '{code}') FROM bad"
                    for code in (
                        "null_primary_key:cust_txt",
                        "not_nullable_violation:cust_name",
                        "not_nullable_violation:since_txt",
                        "rule_violation:below_min:balance",
                        "rule_violation:above_max:balance",
                    )
                ],
            ]
        ),
    },
    "SELECT 'customers_silver' AS \"table\", metric, n FROM counts",
)


def _bundled_customers(sql: str) -> str:
    for short, long in (
        ("cust_txt", "customer_id"), ("cust_name", "customer_name"), ("email_txt", "customer_email"),
        ("doc_txt", "customer_cpf"), ("since_txt", "registration_date"),
        ("since_day", "registration_month"),
    ):
        sql = sql.replace(f" AS {short}", f" AS {long}").replace(f":{short}", f":{long}")
    return sql


_BUNDLED_CUSTOMERS = _with(
    _CUSTOMER_STEPS,
    f"""SELECT cust_txt AS customer_id, cust_name AS customer_name, email_txt AS customer_email,
    CASE WHEN NOT bad_doc THEN doc_txt END AS customer_cpf, {_SINCE} AS registration_date,
    {_SINCE} AS registration_month, {_bundled_customers(_TWO_FLAGS)} AS _dq_flags FROM judged""",
)
_BUNDLED_CUSTOMERS_REJECTED = _with(
    _CUSTOMER_STEPS,
    f"""SELECT cust_txt AS customer_id, cust_name AS customer_name, email_txt AS customer_email,
    doc_txt AS customer_cpf, {_SINCE} AS registration_date,
    {_bundled_customers(_CUSTOMER_HARD)} AS _quarantine_reason, '' AS _dq_flags
    FROM typed WHERE {_CUSTOMER_HARD} IS NOT NULL""",
)

# --- fraud flags ---------------------------------------------------------------------------------

_FRAUD_STEPS = {
    "typed": f"""SELECT transaction_id, {_score("fraud_score")} AS fraud_score,
        TRY_CAST(fraud_flag AS BOOLEAN) AS fraud_flag, fraud_reason, source_key FROM raw_fraud""",
    "kept": """SELECT * FROM typed WHERE transaction_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY fraud_score DESC NULLS LAST,
        fraud_flag DESC NULLS LAST, fraud_reason DESC NULLS LAST, source_key DESC NULLS LAST) = 1""",
}
_FRAUD_VALID = _with(
    _FRAUD_STEPS,
    "SELECT transaction_id, fraud_score, fraud_flag, fraud_reason, '' AS _dq_flags FROM kept",
)
_FRAUD_REJECTED = _with(
    _FRAUD_STEPS,
    """SELECT *, 'null_primary_key:transaction_id' AS _quarantine_reason, '' AS _dq_flags
    FROM typed WHERE transaction_id IS NULL""",
)

# --- everything ----------------------------------------------------------------------------------

_RAW = "FROM raw_orders"
_TYPED_TEXT = f"order_id, {_ORDER_VALUES}, status"
_LINE_TIES = ", ".join(
    f"{c} DESC NULLS LAST"
    for c in (
        "l_discount", "l_extendedprice", "l_linestatus", "l_partkey", "l_quantity", "l_returnflag",
        "l_shipdate", "l_suppkey", "l_tax",
    )
)


def _expected(names: list[tuple[str, str]], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS expectation, count(*) FILTER (WHERE {good}) AS passed, "
        f"count(*) FILTER (WHERE NOT ({good})) AS failed FROM {source}"
        for name, good in names
    )


ORACLE: dict[str, str] = {
    "conform_orders": _orders_valid("warn"),
    "quarantine_union": _orders_quarantine("quarantine"),
    "conform_fraud_flags": _FRAUD_VALID,
    "bundled_transactions": _with(
        _TRANSACTION_STEPS,
        f"""SELECT {_TRANSACTION_VALUES}, {_day_text("transaction_date")} AS transaction_date_ref,
        {_flags(("transaction_amount < 0", "below_min:transaction_amount"))} AS _dq_flags FROM kept""",
    ),
    "bundled_transactions_quarantine": _with(
        _TRANSACTION_STEPS,
        f"""SELECT {_TRANSACTION_VALUES}, source_key, _quarantine_reason, '' AS _dq_flags FROM
        (SELECT *, CASE WHEN transaction_id IS NULL THEN 'null_primary_key:transaction_id'
        WHEN customer_id IS NULL THEN 'not_nullable_violation:customer_id'
        WHEN transaction_amount IS NULL THEN 'not_nullable_violation:transaction_amount'
        WHEN transaction_date IS NULL THEN 'not_nullable_violation:transaction_date' END
        AS _quarantine_reason FROM typed) WHERE _quarantine_reason IS NOT NULL""",
    ),
    "bundled_customers": _BUNDLED_CUSTOMERS,
    "bundled_customers_quarantine": _BUNDLED_CUSTOMERS_REJECTED,
    "bundled_fraud_flags": _FRAUD_VALID,
    "bundled_fraud_flags_quarantine": _FRAUD_REJECTED,
    "scan_json_conform": _with(
        _ORDER_STEPS,
        f"""SELECT {_ORDER_VALUES}, {_day_text("ts_txt")} AS ts_day, {_ORDER_FLAGS} AS _dq_flags
        FROM kept""",
    ),
    "scan_json_inferred": _orders_quarantine("warn"),
    "scan_csv_conform": _DEFAULT_CUSTOMERS,
    "scan_csv_corrupt": """SELECT c_name AS name, 'not_nullable_violation:_c0' AS _quarantine_reason,
        CASE WHEN (c_custkey + 1) % 10 = 0 THEN ',' || c_name || ',surplus' END AS whole_text FROM customer WHERE (c_custkey + 1) % 5 = 0""",
    "scan_table_conform": _FRAUD_REJECTED,
    "sink_partitioned_roundtrip": _orders_valid("quarantine"),
    "sink_quarantine_roundtrip": _orders_quarantine("quarantine"),
    "quality_report": _CUSTOMER_REPORT,
    "job_report": _CUSTOMER_REPORT,
    "schema_completion": _with(
        _ORDER_STEPS,
        f"""SELECT order_id, txn_id, cust_txt, amount_txt::DOUBLE AS amount_txt,
        {_ts_text("ts_txt")} AS ts_txt, status, NULL::VARCHAR AS method, NULL::DOUBLE AS score_txt
        FROM typed""",
    ),
    "typed_cast": _with(
        {},
        f"""SELECT TRY_CAST(order_id AS INT) AS order_id, TRY_CAST(cust_txt AS BIGINT) AS cust_txt,
        TRY_CAST(ltrim(trim(amount_txt), '+') AS DOUBLE) AS amount_txt,
        {_ts_text("TRY_CAST(ts_txt AS TIMESTAMP)")} AS ts_txt,
        CASE WHEN status = 'F' THEN FALSE END AS status {_RAW}""",
    ),
    "typed_decimal": """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
        TRY_CAST(o_totalprice AS DECIMAL(7,2))::DOUBLE AS o_totalprice,
        CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders""",
    "derive_date": f"""SELECT o_orderkey, {_ts_text("o_orderdate")} AS o_orderdate,
        {_day_text("CAST(o_orderdate AS DATE)")} AS day, '' AS _dq_flags FROM orders""",
    "clean_numeric": _with(
        {}, f"SELECT order_id, {_clean_numeric('amount_txt')} AS amount {_RAW}"
    ),
    "parse_timestamp_multi": _with(
        {}, f"SELECT order_id, {_ts_text(_parse_ts('ts_txt'))} AS ts {_RAW}"
    ),
    "normalize_id": _with(
        {}, f"SELECT cust_name, doc_txt, {_normalize_cpf('doc_txt')} AS doc FROM raw_customers"
    ),
    "normalize_score": _with({}, f"SELECT order_id, {_score('score_txt')} AS score {_RAW}"),
    "valid_document": _with(
        {}, f"SELECT cust_name, doc_txt, {_validate_cpf('doc_txt')} AS ok FROM raw_customers"
    ),
    "valid_email_text": _with(
        {}, f"SELECT cust_name, email_txt, {_valid_email('email_txt')} AS ok FROM raw_customers"
    ),
    "hard_null_pk": _with(
        _ORDER_STEPS,
        """SELECT * FROM (SELECT order_id, CASE WHEN ts_txt IS NULL THEN 'null_primary_key:ts_txt'
        WHEN cust_txt IS NULL THEN 'null_primary_key:cust_txt'
        WHEN txn_id IS NULL THEN 'null_primary_key:txn_id'
        WHEN amount_txt IS NULL THEN 'not_nullable_violation:amount_txt' END AS _quarantine_reason
        FROM typed) WHERE _quarantine_reason IS NOT NULL""",
    ),
    "hard_not_null": _with(
        _ORDER_STEPS,
        f"""SELECT order_id, {_ORDER_REASON.replace("null_primary_key", "not_nullable_violation")}
        AS _quarantine_reason FROM typed WHERE NOT ({_COMPLETE})""",
    ),
    "hard_split_valid": _with(_ORDER_STEPS, f"SELECT {_TYPED_TEXT} FROM complete"),
    "dedup_keep_last": f"""SELECT event_id, {_ts_text("ts")} AS ts, user_id, event_type, value, props
        FROM events QUALIFY row_number() OVER (PARTITION BY user_id
        ORDER BY events.ts DESC NULLS LAST, event_id DESC NULLS LAST) = 1""",
    "dedup_keep_first": _with(
        {
            **_ORDER_STEPS,
            "firsts": """SELECT * FROM typed QUALIFY row_number() OVER (PARTITION BY txn_id
            ORDER BY ts_txt ASC NULLS FIRST, amount_txt ASC NULLS FIRST, cust_txt ASC NULLS FIRST,
            method ASC NULLS FIRST, order_id ASC NULLS FIRST) = 1""",
        },
        f"SELECT {_TYPED_TEXT} FROM firsts",
    ),
    "dedup_tiebreak": f"""WITH best AS (SELECT * FROM lineitem QUALIFY row_number() OVER
        (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE_TIES}) = 1)
        SELECT * REPLACE ({_ts_text("l_shipdate")} AS l_shipdate) FROM best""",
    "rule_regex": """SELECT page_id, url, CASE WHEN NOT regexp_matches(url,
        '^http://[a-z]+\\.example\\.com/(en|de)/') THEN 'regex:url' ELSE '' END AS _dq_flags FROM pages""",
    "rule_check_digits": _with(
        {},
        f"""SELECT cust_name, doc_txt, CASE WHEN doc_txt IS NOT NULL AND NOT {_validate_cpf("doc_txt")}
        THEN 'invalid_cpf:doc_txt' ELSE '' END AS _dq_flags FROM raw_customers""",
    ),
    "rule_email": _with(
        {},
        f"""SELECT cust_name, email_txt, CASE WHEN email_txt IS NOT NULL
        AND NOT {_valid_email("email_txt")} THEN 'invalid_email:email_txt' ELSE '' END AS _dq_flags
        FROM raw_customers""",
    ),
    "rule_min_max": f"""SELECT c_custkey, c_acctbal,
        {_flags(("c_acctbal < 0", "below_min:c_acctbal"), ("c_acctbal > 9000.5", "above_max:c_acctbal"))}
        AS _dq_flags FROM customer""",
    "rule_unique": """SELECT doc_id, CASE WHEN text IS NOT NULL AND count(*) OVER (PARTITION BY text) > 1
        THEN 'duplicate:text' ELSE '' END AS _dq_flags FROM documents""",
    "policy_warn": _customers_valid(
        "email_txt, doc_txt, balance", "judged", ("email", "doc", "balance")
    ),
    "policy_nullify": _customers_valid(
        """CASE WHEN NOT bad_email AND NOT dup THEN email_txt END AS email_txt,
        CASE WHEN NOT bad_doc THEN doc_txt END AS doc_txt,
        CASE WHEN NOT low AND NOT high THEN balance END AS balance""",
        "judged_left",
        ("email", "doc", "balance"),
    ),
    "policy_quarantine": _customers_valid(
        "email_txt, doc_txt, balance", "judged", (), f"{_CUSTOMER_SOFT} IS NULL"
    ),
    "policy_mixed": _MIXED_CUSTOMERS,
    "soft_split": _with(
        _CUSTOMER_STEPS,
        f"""SELECT {_AS_RAW}, {_CUSTOMER_SOFT} AS _quarantine_reason, '' AS _dq_flags
        FROM judged WHERE {_CUSTOMER_SOFT} IS NOT NULL""",
    ),
    "hard_expectations": _with(
        _ORDER_STEPS,
        _expected(
            [
                ("null_primary_key_txn_id", "txn_id IS NOT NULL"),
                ("not_nullable_violation_cust_txt", "cust_txt IS NOT NULL"),
                ("not_nullable_violation_amount_txt", "amount_txt IS NOT NULL"),
                ("not_nullable_violation_ts_txt", "ts_txt IS NOT NULL"),
            ],
            "typed",
        ),
    ),
    "expect_or_drop": _with(_ORDER_STEPS, f"SELECT {_TYPED_TEXT} FROM complete"),
    "soft_expectations": _with(
        _CUSTOMER_STEPS,
        _expected([(flag.replace(":", "_"), f"NOT {hit}") for hit, flag in _RAISED], "judged"),
    ),
    "declarative_silver": _orders_valid("warn"),
    "declarative_quarantine": _orders_quarantine("quarantine"),
    # typed rows go through a text contract unharmed
    "parse_timestamp_typed": f"""SELECT o_orderkey, {_ts_text("o_orderdate")} AS o_orderdate,
        strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d %H:%M:%S') AS day, NULL::VARCHAR AS _quarantine_reason
        FROM orders""",
    "scan_json_extra_fields": _with(
        _ORDER_STEPS,
        f"""SELECT CAST(order_id AS VARCHAR) AS order_id, status, {_ORDER_REASON} AS _quarantine_reason,
        txn_id FROM typed WHERE NOT ({_COMPLETE})""",
    ),
    "rule_unique_many": """WITH left_values AS (SELECT event_id, user_id, event_type,
        CASE WHEN regexp_matches(props, '1') THEN props END AS props FROM events),
        counted AS (SELECT *, user_id IS NOT NULL AND count(*) OVER (PARTITION BY user_id) > 1 AS users,
        event_type IS NOT NULL AND count(*) OVER (PARTITION BY event_type) > 1 AS types,
        props IS NOT NULL AND count(*) OVER (PARTITION BY props) > 1 AS same FROM left_values)
        SELECT event_id, user_id, CASE WHEN NOT types THEN event_type END AS event_type,
        CASE WHEN NOT same THEN props END AS props,
        concat_ws('|', CASE WHEN users THEN 'duplicate:user_id' END,
        CASE WHEN types THEN 'duplicate:event_type' END,
        CASE WHEN props IS NULL AND event_id IN (SELECT event_id FROM events WHERE NOT regexp_matches(props, '1'))
        THEN 'regex:props' END, CASE WHEN same THEN 'duplicate:props' END) AS _dq_flags FROM counted""",
    "dedup_extra_columns": """SELECT lang, doc_id, '' AS _dq_flags FROM (SELECT lang, max(doc_id) AS doc_id
        FROM documents WHERE lang IS NOT NULL GROUP BY lang)""",
    "schema_no_dedup": """SELECT l_orderkey, l_linenumber, '' AS _dq_flags FROM lineitem""",
    "sink_table_roundtrip": _with(
        {**_ORDER_STEPS, "rejected": f"""SELECT txn_id, {_ORDER_REASON} AS reason FROM typed WHERE NOT ({_COMPLETE})
        UNION ALL SELECT txn_id, {_SOFT_ORDER} FROM kept WHERE {_SOFT_ORDER} IS NOT NULL"""},
        f"""SELECT 'valid' AS result, txn_id, NULL::VARCHAR AS reason FROM kept WHERE {_SOFT_ORDER} IS NULL
        UNION ALL SELECT 'quarantine', txn_id, reason FROM rejected""",
    ),
    "job_run": _with(
        {
            **{f"t_{k}": v for k, v in _TRANSACTION_STEPS.items() if k == "named"},
            "t_typed": _TRANSACTION_STEPS["typed"].replace("FROM named", "FROM t_named"),
            "t_kept": _TRANSACTION_STEPS["kept"].replace("FROM typed", "FROM t_typed"),
            **{f"c_{k}": v.replace("FROM typed", "FROM c_typed").replace("FROM kept", "FROM c_kept").replace("FROM checked", "FROM c_checked")
               for k, v in _CUSTOMER_STEPS.items() if k in ("typed", "kept", "checked", "judged")},
            "f_typed": _FRAUD_STEPS["typed"],
        },
        """SELECT 'transactions_silver' AS "table", 'valid' AS metric, count(*) AS n FROM t_kept
        UNION ALL SELECT 'transactions_silver', 'quarantine', count(*) FROM t_typed WHERE transaction_id IS NULL
        OR customer_id IS NULL OR transaction_amount IS NULL OR transaction_date IS NULL
        UNION ALL SELECT 'customers_silver', 'valid', count(*) FROM c_judged
        UNION ALL SELECT 'customers_silver', 'quarantine', count(*) FROM c_typed
        WHERE cust_txt IS NULL OR cust_name IS NULL OR since_txt IS NULL
        UNION ALL SELECT 'fraud_flags_silver', 'valid', count(DISTINCT transaction_id) FROM f_typed
        UNION ALL SELECT 'fraud_flags_silver', 'quarantine', count(*) FROM f_typed WHERE transaction_id IS NULL""",
    ),
}
ORACLE |= {
    "publish_json_once": ORACLE["scan_json_conform"],
    "publish_json_once_quarantine": ORACLE["scan_json_extra_fields"],
}
