"""Plan shapes that decide how the stages behave on large and skewed tables."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from covenant import apply_contract
from covenant.operators.dedup import keep_one
from covenant.operators.uniqueness import mark_repeated
from tests.helpers import column, make, plan_of

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture
def settings(spark):
    changed = []

    def change(**values):
        for key, value in values.items():
            name = "spark.sql." + key.replace("__", ".")
            changed.append(name)
            spark.conf.set(name, value)

    yield change
    for name in changed:
        spark.conf.unset(name)


def final_plan(df) -> str:
    df.collect()
    return plan_of(df).split("Initial Plan")[0]


def test_losers_of_a_key_are_dropped_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id AS o")
    plan = plan_of(keep_one(df, ["k"], "o"))
    below_exchange = plan[plan.index("Exchange hashpartitioning(k"):]
    assert "partial_max(struct" in below_exchange and "Window" not in plan
    sorts = [line for line in plan.split("\n") if "Sort [" in line]
    assert sorts and all("Sort [k#" in line and line.count("ASC") == 1 for line in sorts)  # by the key alone


def test_a_hot_key_sends_one_row_per_task(spark, tmp_path):
    spark.range(0, 40000, 1, 8).selectExpr("IF(id % 3 = 0, 0, id) AS k", "id AS o").write.parquet(str(tmp_path / "h"))
    result = keep_one(spark.read.parquet(str(tmp_path / "h")), ["k"], "o")
    assert result.count() == 40000 - 13334 + 1
    assert result.where("k = 0").first()["o"] == 39999


def test_no_python_in_any_stage(spark):
    contract = make(
        column("c_custkey", "long", nullable=False),
        column("c_name", transform="normalize_cpf", rules={"valid_cpf": True, "valid_email": True, "unique": True}),
        column("c_acctbal", "double", transform="clean_numeric", rules={"min": 0, "on_fail": "quarantine"}),
        column("c_mktsegment", "double", transform="normalize_score", score_map={"BUILDING": 0.1}),
        dedup={"keys": ["c_custkey"]},
    )
    found = apply_contract(spark.read.parquet(f"{TESTDATA}/customer.parquet"), contract)
    for df in (found.valid, found.quarantine):
        assert "Python" not in plan_of(df) and "CartesianProduct" not in plan_of(df)


def test_null_tests_and_columns_reach_the_scan(spark):
    contract = make(column("o_orderkey", "long", nullable=False), column("o_totalprice", "double"))
    found = apply_contract(spark.read.parquet(f"{TESTDATA}/orders.parquet"), contract)
    valid, quarantine = plan_of(found.valid), plan_of(found.quarantine)
    assert "PushedFilters: [IsNotNull(o_orderkey)]" in valid
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in valid
    assert "PushedFilters: [IsNull(o_orderkey)]" in quarantine
    assert "Exchange" not in valid and "Exchange" not in quarantine


def test_quarantine_without_soft_policy_is_one_scan_without_shuffle(spark):
    contract = make(
        column("o_orderkey", "long", nullable=False),
        column("o_custkey", "long", rules={"unique": True}),
        dedup={"keys": ["o_orderkey"]},
    )
    plan = plan_of(apply_contract(spark.read.parquet(f"{TESTDATA}/orders.parquet"), contract).quarantine)
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_transforms_of_required_columns_are_computed_once(spark):
    contract = make(column("o_orderpriority", "double", nullable=False, transform="clean_numeric"))
    plan = plan_of(apply_contract(spark.read.parquet(f"{TESTDATA}/orders.parquet"), contract).valid)
    kept = plan[plan.index("Filter") :].split("\n")[0]
    assert "isnotnull(o_orderpriority" in kept and "translate" not in kept
    assert plan.index("translate") > plan.index("Filter")  # projected below the filter, once


def unique_after_dedup(spark):
    contract = make(
        column("event_id", "long", nullable=False),
        column("ts", "timestamp"),
        column("tag", rules={"unique": True}),
        dedup={"keys": ["event_id"], "order_by": "ts"},
    )
    tag = F.when(F.col("event_id") % 3 == 0, "hot").when(F.col("event_id") % 3 == 1, F.col("event_id").cast("string"))
    df = spark.read.parquet("/root/testdata/sf0.01/events.parquet").withColumn("tag", tag).repartition(8)
    return apply_contract(df, contract).valid


def test_hot_values_are_split_by_the_skew_join(spark, settings):
    settings(
        autoBroadcastJoinThreshold="-1",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="2k",
        adaptive__skewJoin__skewedPartitionFactor="1.5",
        adaptive__advisoryPartitionSizeInBytes="4k",
        adaptive__coalescePartitions__enabled="false",
    )
    valid = unique_after_dedup(spark)
    flagged = valid.where(F.size("_dq_flags") > 0)
    assert flagged.count() == 3334
    assert "SortMergeJoin(skew=true)" in final_plan(valid)


def test_the_lookup_is_a_hash_join_where_partitions_are_small(spark, settings):
    settings(
        autoBroadcastJoinThreshold="-1",
        adaptive__maxShuffledHashJoinLocalMapThreshold="64MB",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="2k",
        adaptive__skewJoin__skewedPartitionFactor="1.5",
        adaptive__advisoryPartitionSizeInBytes="4k",
        adaptive__coalescePartitions__enabled="false",
    )
    assert "ShuffledHashJoin(skew=true)" in final_plan(unique_after_dedup(spark))


def test_a_small_list_of_repeated_values_is_broadcast_by_size(spark):
    assert "BroadcastHashJoin" in final_plan(unique_after_dedup(spark))


def test_dedup_shuffle_is_shared_by_count_and_lookup(spark, settings):
    settings(autoBroadcastJoinThreshold="-1")
    plan = final_plan(unique_after_dedup(spark))
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_nulls_spread_over_all_partitions(spark, settings):
    settings(autoBroadcastJoinThreshold="-1", adaptive__enabled="false")
    df = spark.range(4000).selectExpr("id", "CAST(NULL AS STRING) AS v")
    marked = mark_repeated(df, {"v": "hit"})
    sizes = [r["count"] for r in marked.groupBy(F.spark_partition_id()).count().collect()]
    assert marked.where("hit").count() == 0 and len(sizes) == 4 and max(sizes) < 1300


def test_many_unique_columns_grow_the_plan_by_one_relation_each(spark):
    names = [f"u{i}" for i in range(10)]
    contract = make(column("id", "long"), *(column(n, rules={"unique": True}) for n in names))
    df = spark.range(5).selectExpr("id", *(f"CAST(id % {i + 2} AS STRING) AS u{i}" for i in range(10)))
    df.write.mode("overwrite").saveAsTable("many_unique")
    began = time.time()
    valid = apply_contract(spark.table("many_unique"), contract).valid
    assert time.time() - began < 3
    assert valid._jdf.queryExecution().analyzed().toString().count("Relation ") == 11
    assert len(valid.where("id = 0").first()["_dq_flags"]) == 3  # u0 to u2 repeat 0 within five rows


def test_columns_outside_the_contract_are_not_read_without_a_soft_policy(spark):
    pages = spark.read.parquet(f"{TESTDATA}/pages.parquet")
    columns = (column("url", nullable=False), column("page_id", "long"))
    dedup = {"keys": ["url"], "order_by": "page_id"}
    plan = plan_of(apply_contract(pages, make(*columns, dedup=dedup)).valid)
    assert "html" not in plan
    limit = column("page_id", "long", rules={"min": 5, "on_fail": "quarantine"})
    found = apply_contract(pages, make(columns[0], limit, dedup=dedup))
    assert "html" in plan_of(found.quarantine) and found.quarantine.where("html IS NOT NULL").count() > 0


def test_the_winner_does_not_depend_on_the_order_of_columns(spark):
    contract = make(column("k", "long", nullable=False), column("a"), column("b"), dedup={"keys": ["k"]})
    df = spark.createDataFrame([(1, "x", "p", "m"), (1, "y", "o", "n")], "k long, a string, b string, e string")
    for order in (["k", "a", "b", "e"], ["e", "b", "a", "k"], ["b", "k", "e", "a"]):
        assert [tuple(r)[:3] for r in apply_contract(df.select(*order), contract).valid.collect()] == [(1, "y", "o")]
    kept = [keep_one(df.select(*order), ["k"]).select("k", "a", "b", "e").first() for order in (["k", "b", "a", "e"], ["e", "a", "k", "b"])]
    assert kept[0] == kept[1]
    maps = df.selectExpr("k", "map('m', a) AS m", "parse_json(concat('\"', b, '\"')) AS v")
    assert keep_one(maps, ["k"]).first()["m"] == {"m": "y"}


def test_plain_null_tests_are_pushed_beside_computed_ones(spark):
    contract = make(column("o_orderkey", "long", nullable=False), column("o_comment", "double", transform="clean_numeric", nullable=False))
    orders = spark.read.parquet(f"{TESTDATA}/orders.parquet").withColumn("o_comment", F.lit("7"))
    assert "PushedFilters: [IsNotNull(o_orderkey)]" in plan_of(apply_contract(orders, contract).valid)
