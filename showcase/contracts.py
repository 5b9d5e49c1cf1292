"""Contracts of the registered queries."""

from __future__ import annotations

from typing import Any

from covenant import Contract

# The two accepted timestamp forms and the score words.
FORMATS = ["yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd HH:mm:ss"]
SCORES = {"LOW": 0.1, "MEDIUM": 0.5, "HIGH": 0.9}


def contract(name: str, columns: list[dict[str, Any]], **parts: Any) -> Contract:
    source = parts.pop("source", {"format": "parquet", "path": name})
    return Contract.from_dict(
        {"version": "1.0", "name": name, "source": source, "columns": columns, **parts}
    )


def orders_contract(amount: str = "warn", **parts: Any) -> Contract:
    columns = [
        {"name": "txn_id", "type": "string", "nullable": False},
        {"name": "cust_txt", "type": "long", "nullable": False},
        {
            "name": "amount_txt", "type": "decimal(18,2)", "nullable": False,
            "transform": "clean_numeric", "rules": {"min": 0, "max": 400000, "on_fail": amount},
        },
        {
            "name": "ts_txt", "type": "timestamp", "nullable": False,
            "transform": "parse_timestamp", "formats": FORMATS,
        },
        {"name": "method", "type": "string"},
        {"name": "score_txt", "type": "double", "transform": "normalize_score", "score_map": SCORES},
    ]
    given = {
        "primary_key": ["txn_id"],
        "partition_by": ["ts_day"],
        "dedup": {"keys": ["txn_id"], "order_by": "ts_txt", "keep": "last"},
        "derived": [{"name": "ts_day", "from": "ts_txt", "expr": "to_date"}],
        **parts,
    }
    return contract("orders_silver", columns, **given)


def customers_contract(
    email: str = "warn", document: str = "nullify", balance: str = "warn", **parts: Any
) -> Contract:
    columns = [
        {"name": "cust_txt", "type": "long", "nullable": False},
        {"name": "cust_name", "type": "string", "nullable": False},
        {
            "name": "email_txt", "type": "string",
            "rules": {"valid_email": True, "unique": True, "on_fail": email},
        },
        {
            "name": "doc_txt", "type": "string", "transform": "normalize_cpf",
            "rules": {"valid_cpf": True, "on_fail": document},
        },
        {"name": "since_txt", "type": "date", "nullable": False},
        {"name": "balance", "type": "double", "rules": {"min": 0, "max": 9000, "on_fail": balance}},
    ]
    given = {
        "primary_key": ["cust_txt"],
        "partition_by": ["since_day"],
        "dedup": {"keys": ["cust_txt"], "order_by": "since_txt", "keep": "last"},
        "derived": [{"name": "since_day", "from": "since_txt", "expr": "to_date"}],
        **parts,
    }
    return contract("customers_silver", columns, **given)


def fraud_contract(**parts: Any) -> Contract:
    columns = [
        {"name": "transaction_id", "type": "string", "nullable": False},
        {
            "name": "fraud_score", "type": "double", "transform": "normalize_score",
            "score_map": SCORES, "rules": {"min": 0, "max": 1, "on_fail": "warn"},
        },
        {"name": "fraud_flag", "type": "boolean"},
        {"name": "fraud_reason", "type": "string"},
    ]
    given = {
        "primary_key": ["transaction_id"],
        "dedup": {"keys": ["transaction_id"], "order_by": "transaction_id", "keep": "last"},
        **parts,
    }
    return contract("fraud_flags_silver", columns, **given)
