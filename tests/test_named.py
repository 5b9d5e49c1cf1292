"""Expectations and the named-dataset composition."""

from __future__ import annotations

from dataclasses import replace
from types import SimpleNamespace

import pytest
from pyspark.sql import Observation

from covenant import apply_contract
from covenant.operators.expectations import (
    expect_or_drop,
    expect_warn,
    expectation_counts,
    hard_expectations,
    soft_expectations,
)
from covenant.operators.typing import conform
from covenant.plans.batch import judged_rows
from covenant.plans.named import create_views, define_datasets, typed_rows, valid_rows
from tests.helpers import column, make, rows


@pytest.fixture
def sample(spark):
    contract = make(
        column("k", "long", nullable=False),
        column("r", "double", transform="clean_numeric", nullable=False),
        column("w", rules={"regex": "^a", "unique": True}),
        column("q", "int", rules={"min": 0, "on_fail": "quarantine"}),
        column("n", rules={"valid_email": True, "on_fail": "nullify"}),
        primary_key=["k"],
        dedup={"keys": ["k"], "order_by": "r"},
    )
    data = [("1", "1", "a", 1, "x"), ("1", "2", "b", 1, None), ("2", "x", "a", 1, None), (None, "3", "a", 1, None), ("3", "3", "b", -1, "a@b.c")]
    return contract, spark.createDataFrame(data, "k string, r string, w string, q int, n string")


def test_predicates(sample):
    contract, _ = sample
    assert hard_expectations(contract) == {"null_primary_key_k": "`k` IS NOT NULL", "not_nullable_violation_r": "`r` IS NOT NULL"}
    assert soft_expectations(contract) == {
        "regex_w": "NOT array_contains(_dq_flags, 'regex:w')",
        "duplicate_w": "NOT array_contains(_dq_flags, 'duplicate:w')",
        "invalid_email_n": "NOT array_contains(_dq_flags, 'invalid_email:n')",
    }


def test_drop_and_warn_count_failures(spark, sample):
    contract, df = sample
    dropped, watched = Observation(), Observation()
    typed = typed_rows(df, contract, dropped)
    assert typed.count() == 3
    assert dropped.get == {"rows": 5, "null_primary_key_k": 1, "not_nullable_violation_r": 1}
    valid = valid_rows(judged_rows(typed_rows(df, contract), contract), contract, watched)
    assert len(valid.collect()) == 1
    assert watched.get == {"rows": 1, "regex_w": 1, "duplicate_w": 1, "invalid_email_n": 0}
    counts = expectation_counts(conform(df, contract), hard_expectations(contract))
    assert rows(counts) == [("not_nullable_violation_r", 4, 1), ("null_primary_key_k", 4, 1)]


def test_no_rules_leave_the_table_alone(spark):
    df = spark.range(3)
    contract = make(column("id", "long"))
    assert hard_expectations(contract) == soft_expectations(contract) == {}
    assert expect_or_drop(df, {}, Observation()).count() == 3
    assert expect_warn(df, {}, Observation()).count() == 3
    assert rows(expectation_counts(df, {})) == []


def test_views_equal_the_batch_plan(spark, sample):
    contract, df = sample
    names = create_views(spark, contract, df)
    assert names == ["sample_bronze", "sample_typed", "sample_judged", "sample", "sample_quarantine"]
    batch = apply_contract(df, contract)
    assert rows(spark.table("sample")) == rows(batch.valid)
    assert rows(spark.table("sample_quarantine")) == rows(batch.quarantine)
    assert spark.table("sample_typed").count() == 3


@pytest.mark.parametrize("with_expectations", [True, False])
def test_pipeline_datasets(spark, sample, tmp_path, with_expectations):
    contract, df = sample
    df.write.parquet(str(tmp_path / "raw"))
    contract = replace(contract, source=replace(contract.source, path="elsewhere/raw"))
    defined, handed = {}, {}

    def dataset(**options):
        def define(function):
            defined[options["name"]] = (function, options)
            return function

        return define

    def expecting(kind):
        return lambda rules: (lambda function: handed.setdefault(kind, rules) and function)

    recorder = SimpleNamespace(temporary_view=dataset, materialized_view=dataset)
    if with_expectations:
        recorder.expect_all = expecting("warn")
        recorder.expect_all_or_drop = expecting("drop")
    define_datasets(spark, [contract], recorder, str(tmp_path))
    assert list(defined) == ["sample_bronze", "sample_typed", "sample_judged", "sample", "sample_quarantine"]
    for function, options in defined.values():
        function().createOrReplaceTempView(options["name"])
    batch = apply_contract(df, contract)
    assert rows(spark.table("sample")) == rows(batch.valid)
    assert rows(spark.table("sample_quarantine")) == rows(batch.quarantine)
    assert spark.table("sample_typed").count() == (5 if with_expectations else 3)
    assert handed == ({"drop": hard_expectations(contract), "warn": soft_expectations(contract)} if with_expectations else {})
