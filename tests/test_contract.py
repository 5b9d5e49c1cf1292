"""Loading and checking contracts."""

from __future__ import annotations

import copy
import os
import subprocess
import sys
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import covenant
from covenant import Contract, ContractError, apply_contract
from covenant.contract import spark_type
from covenant.functions import TRANSFORM_BUILDERS, register_transform
from covenant.plans.job import load_contracts
from tests.helpers import column, make, rows

GOOD = {
    "version": "1.0",
    "name": "t",
    "source": {"format": "json", "path": "in/t.json"},
    "primary_key": ["a"],
    "partition_by": ["day"],
    "dedup": {"keys": ["a"], "order_by": "ts", "keep": "first"},
    "columns": [
        {"name": "a", "type": "long", "nullable": False},
        {"name": "ts", "type": "timestamp", "transform": "parse_timestamp", "formats": ["yyyy"]},
        {"name": "s", "type": "string", "rules": {"regex": "^x", "unique": True}},
        {"name": "n", "type": "decimal(10,2)", "rules": {"min": 0, "max": 5, "on_fail": "nullify"}},
    ],
    "derived": [{"name": "day", "from": "ts"}],
}


def changed(path: str, value: object) -> dict:
    raw = copy.deepcopy(GOOD)
    *parents, last = path.split(".")
    target = raw
    for key in parents:
        target = target[int(key)] if key.isdigit() else target[key]
    if value is ...:
        del target[last]
    else:
        target[last] = value
    return raw


def test_a_good_contract_loads():
    contract = Contract.from_dict(GOOD)
    assert contract.required == ["a"]
    assert contract.columns[3].rules.min == 0.0
    assert contract.schema().fieldNames() == ["a", "ts", "s", "n", "day", "_dq_flags"]


@pytest.mark.parametrize(
    ("path", "value", "message"),
    [
        ("extra", 1, "unknown key 'extra'"),
        ("columns.0.extra", 1, "unknown key 'extra'"),
        ("columns.2.rules.extra", 1, "unknown key 'extra'"),
        ("source.extra", 1, "unknown key 'extra'"),
        ("dedup.extra", 1, "unknown key 'extra'"),
        ("derived.0.extra", 1, "unknown key 'extra'"),
        ("version", ..., "missing key 'version'"),
        ("columns.0.type", ..., "missing key 'type'"),
        ("version", 1.0, "version: expected str"),
        ("columns.0.nullable", "no", "nullable: expected bool"),
        ("columns.3.rules.min", True, "min: expected"),
        ("columns", {}, "columns: expected list"),
        ("columns", [], "at least one column"),
        ("columns.0.type", "binary", "unsupported column type"),
        ("columns.0.type", "decimal", "unsupported column type"),
        ("columns.0.type", "decimal(18)", "unsupported column type"),
        ("columns.0.type", "decimal(40,2)", "unsupported column type"),
        ("columns.1.formats", [], "needs 'formats'"),
        ("columns.1.transform", "shout", "unknown transform 'shout'"),
        ("columns.2.rules.on_fail", "explode", "unknown on_fail"),
        ("columns.2.rules.regex", "(", "bad regex"),
        ("columns.2.rules.min", 1, "need a numeric type"),
        ("columns.3.rules.min", 9, "is above max"),
        ("columns.2.name", "A", "declared twice"),
        ("columns.2.name", "_dq_flags", "is reserved"),
        ("derived.0.name", "a", "declared twice"),
        ("primary_key", ["zz"], "primary_key: 'zz'"),
        ("partition_by", ["zz"], "partition_by: 'zz'"),
        ("dedup.keys", ["zz"], "dedup.keys: 'zz'"),
        ("dedup.keys", [], "at least one key"),
        ("dedup.order_by", "zz", "dedup.order_by: 'zz'"),
        ("dedup.keep", "middle", "dedup.keep"),
        ("derived.0.from", "zz", "'zz' is not a column"),
        ("derived.0.expr", "year", "unknown expr"),
        ("source.format", "xml", "unknown format"),
        ("columns.1.score_map", {"LOW": "a"}, "must map a text to a number"),
    ],
)
def test_a_bad_contract_is_refused(spark, path, value, message):
    with pytest.raises(ContractError, match=message.replace("(", r"\(")):
        Contract.from_dict(changed(path, value))


def test_all_problems_are_named_together(spark):
    raw = changed("primary_key", ["p"])
    raw["partition_by"] = ["q"]
    with pytest.raises(ContractError, match="'p'.*'q'"):
        Contract.from_dict(raw)


def test_java_only_patterns_are_accepted(spark):
    Contract.from_dict(changed("columns.2.rules.regex", r"^\p{Lu}\p{L}*+$"))


@pytest.mark.parametrize(
    ("declared", "kind"),
    [
        (" String ", T.StringType()), ("LONG", T.LongType()), ("int", T.IntegerType()),
        ("integer", T.IntegerType()), ("double", T.DoubleType()), ("float", T.FloatType()),
        ("bool", T.BooleanType()), ("boolean", T.BooleanType()), ("date", T.DateType()),
        ("timestamp", T.TimestampType()), ("decimal( 18 , 2 )", T.DecimalType(18, 2)),
    ],
)
def test_types(declared, kind):
    assert spark_type(declared) == kind


def test_bundled_contracts_load_sorted():
    assert [c.name for c in load_contracts()] == ["customers_silver", "fraud_flags_silver", "transactions_silver"]


def test_no_contract_found(tmp_path):
    with pytest.raises(SystemExit, match="no contract"):
        load_contracts(str(tmp_path / "*.yaml"))


def test_yaml_errors_name_the_file(tmp_path):
    path = tmp_path / "bad.yaml"
    path.write_text("version: '1'\nname: x\n")
    with pytest.raises(ContractError, match=r"bad\.yaml: .*missing key 'source'"):
        Contract.from_yaml(path)


def test_contracts_inside_a_zip_file_load(tmp_path):
    package = Path(covenant.__file__).parent
    archive = tmp_path / "covenant.zip"
    with zipfile.ZipFile(archive, "w") as zipped:
        for path in package.rglob("*"):
            if path.suffix in (".py", ".yaml"):
                zipped.write(path, path.relative_to(package.parent))
    code = "from covenant.plans.job import load_contracts; print(len(load_contracts()))"
    env = {**os.environ, "PYTHONPATH": str(archive)}
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "3", done.stderr


def test_source_moves_to_another_folder():
    contract = Contract.from_dict(GOOD)
    assert contract.reading_from("/vol/raw/").source.path == "/vol/raw/t.json"
    assert contract.reading_from(None) is contract


def test_users_can_register_a_transform(spark):
    register_transform("shout", lambda col, spec, kind: F.upper(col))
    try:
        contract = make(column("a", transform="shout"))
        df = spark.createDataFrame([("x",)], "a string")
        assert rows(apply_contract(df, contract).valid) == [("X", [])]
    finally:
        del TRANSFORM_BUILDERS["shout"]


@pytest.mark.parametrize("pattern, fits", [(r"\h+", True), (r"a\z", True), (r"\Qa.b\E", True), (r"^\p{Lu}+$", True), ("(?<x", False), ("a(", False)])
def test_java_judges_patterns_in_any_state_of_the_session(spark, tmp_path, pattern, fits):
    path = tmp_path / "c.yaml"
    path.write_text(f"version: '1'\nname: t\nsource: {{format: parquet, path: x}}\ncolumns:\n  - {{name: s, type: string, rules: {{regex: '{pattern}'}}}}\n")
    if fits:
        assert load_contracts(str(path))[0].columns[0].rules.regex == pattern
    else:
        with pytest.raises(ContractError, match="bad regex"):
            load_contracts(str(path))


def test_patterns_loaded_without_a_session_are_judged_at_use(spark, monkeypatch):
    monkeypatch.setattr(SparkSession, "getActiveSession", classmethod(lambda cls: None))
    contract = make(column("s", rules={"regex": "(?<x"}))
    monkeypatch.undo()
    with pytest.raises(ContractError, match="bad regex"):
        apply_contract(spark.createDataFrame([("x",)], "s string"), contract)
