"""Small builders for contracts and plans used across tests."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from covenant import Contract


def column(name: str, kind: str = "string", **parts: Any) -> dict[str, Any]:
    return {"name": name, "type": kind, **parts}


def make(*columns: dict[str, Any], **parts: Any) -> Contract:
    raw = {
        "version": "1",
        "name": "sample",
        "source": {"format": "parquet", "path": "unused"},
        "columns": list(columns),
        **parts,
    }
    return Contract.from_dict(raw)


def plan_of(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
