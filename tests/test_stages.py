"""Typing, hard rules, dedup, soft rules and their policies on small hand-made tables."""

from __future__ import annotations

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from covenant import apply_contract
from covenant.contract import FLAGS, REASON
from covenant.operators.dedup import keep_one
from covenant.operators.required import complete_rows, incomplete_rows
from covenant.operators.rules import checks_of, judge, soft_flags
from covenant.operators.typing import conform
from covenant.sinks import SharedStage
from tests.helpers import column, make, rows

# --- typing ---------------------------------------------------------------------------------------


def test_missing_columns_become_null_and_extra_ones_stay_for_quarantine(spark):
    contract = make(column("id", "long", nullable=False), column("n", "double", transform="clean_numeric"))
    df = spark.createDataFrame([("1", "x"), (None, "y")], "id string, extra string")
    typed = conform(df, contract)
    assert typed.dtypes == [("id", "bigint"), ("extra", "string"), ("n", "double")]
    found = apply_contract(df, contract)
    assert rows(found.valid) == [(1, None, [])]
    assert found.quarantine.columns == ["id", "extra", "n", REASON, FLAGS]
    assert rows(found.quarantine) == [(None, "y", None, "not_nullable_violation:id", [])]


def test_header_that_differs_in_case_is_matched(spark):
    df = spark.createDataFrame([("7",)], "Customer_ID string")
    contract = make(column("customer_id", "long"))
    assert conform(df, contract).columns == ["customer_id"]
    assert rows(apply_contract(df, contract).valid) == [(7, [])]
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        assert conform(df, contract).columns == ["Customer_ID", "customer_id"]
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")


def test_names_with_dots_and_backticks(spark):
    name = "a.b`c"
    df = spark.createDataFrame([(1,), (None,)], "x int").toDF(name)
    found = apply_contract(df, make(column(name, "long", nullable=False, rules={"unique": True, "min": 0}), primary_key=[name], dedup={"keys": [name]}))
    assert rows(found.valid) == [(1, [])]
    assert rows(found.quarantine) == [(None, f"null_primary_key:{name}", [])]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_casts_give_null_under_any_ansi_mode(spark, ansi):
    kinds = {
        "l": "long", "i": "int", "d": "double", "f": "float", "b": "boolean", "t": "timestamp",
        "day": "date", "m": "decimal(5,2)", "s": "string",
    }
    df = spark.createDataFrame(
        [("1.9",) * 9, (" 12 ",) * 9, ("2024-02-30",) * 9, ("99999999999",) * 9, ("true",) * 9, ("2024-02-03T04:05:06Z",) * 9],
        ", ".join(f"{k} string" for k in kinds),
    )
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        got = [tuple(r) for r in conform(df, make(*[column(k, v) for k, v in kinds.items()])).collect()]
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    assert got[0][:2] == (1, 1) and got[0][7] is not None
    assert got[1][:3] == (12, 12, 12.0)
    assert got[2][:7] == (None,) * 7
    assert got[3][:2] == (99999999999, None) and got[3][7] is None
    assert got[4][4] is True
    assert got[5][5] == datetime(2024, 2, 3, 4, 5, 6) and got[5][6] == date(2024, 2, 3)


def test_number_to_decimal_rounds_and_overflows_to_null(spark):
    df = spark.createDataFrame([(1.005,), (1e20,), (None,)], "x double")
    got = [r[0] for r in conform(df, make(column("x", "decimal(18,2)"))).collect()]
    assert [None if g is None else str(g) for g in got] == ["1.01", None, None]


def test_parsed_timestamp_takes_the_declared_type(spark):
    df = spark.createDataFrame([("03/02/2024",), ("x",)], "x string")
    contract = make(column("x", "date", transform="parse_timestamp", formats=["dd/MM/yyyy"]))
    assert rows(conform(df, contract)) == [(None,), (date(2024, 2, 3),)]


# --- hard rules -----------------------------------------------------------------------------------


def test_reasons_name_the_last_key_and_the_first_required_column(spark):
    contract = make(
        column("a"), column("b"), column("c", nullable=False), column("d", nullable=False), primary_key=["a", "b"]
    )
    df = spark.createDataFrame(
        [(None, None, "c", "d"), (None, "b", None, None), ("a", "b", None, None), ("a", "b", "c", None), ("a", "b", "c", "d")],
        "a string, b string, c string, d string",
    )
    reasons = [r[REASON] for r in incomplete_rows(df, contract).collect()]
    assert reasons == [
        "null_primary_key:b", "null_primary_key:a", "not_nullable_violation:c", "not_nullable_violation:d",
    ]
    assert rows(complete_rows(df, contract)) == [("a", "b", "c", "d")]


def test_a_required_key_column_gives_the_key_reason(spark):
    contract = make(column("a", nullable=False), primary_key=["a"])
    df = spark.createDataFrame([(None,)], "a string")
    assert rows(apply_contract(df, contract).quarantine) == [(None, "null_primary_key:a", [])]


def test_nothing_required_rejects_nothing(spark):
    found = apply_contract(spark.createDataFrame([(None,)], "a string"), make(column("a")))
    assert rows(found.valid) == [(None, [])] and rows(found.quarantine) == []


def test_rejected_rows_do_not_take_part_in_dedup_or_unique(spark):
    contract = make(
        column("k", "long"), column("v", rules={"unique": True}), column("r", nullable=False), dedup={"keys": ["k"], "order_by": "v"}
    )
    df = spark.createDataFrame([(1, "z", None), (1, "a", "r"), (2, "z", "r")], "k long, v string, r string")
    found = apply_contract(df, contract)
    assert rows(found.valid) == [(1, "a", "r", []), (2, "z", "r", [])]
    assert found.quarantine.count() == 1


# --- dedup ----------------------------------------------------------------------------------------


def test_null_order_value_loses_last_and_wins_first(spark):
    df = spark.createDataFrame([(1, None), (1, 2), (1, 3)], "k int, o int")
    assert rows(keep_one(df, ["k"], "o", "last")) == [(1, 3)]
    assert rows(keep_one(df, ["k"], "o", "first")) == [(1, None)]


def test_rows_with_null_key_collapse(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (3, 3)], "k int, o int")
    assert rows(keep_one(df, ["k"], "o")) == [(3, 3), (None, 2)]


def test_ties_do_not_depend_on_order_or_partitions(spark):
    data = [(i % 7, i % 2, f"v{i % 5}", float(i % 3)) for i in range(500)]
    results = set()
    for seed, parts in ((1, 1), (2, 3), (3, 11)):
        random.Random(seed).shuffle(data)
        df = spark.createDataFrame(data, "k int, o int, s string, d double").repartition(parts)
        results.add(str(rows(keep_one(df, ["k"], "o"))))
    assert len(results) == 1


def test_unsortable_columns_are_carried_along(spark):
    df = spark.sql("SELECT 1 AS k, map('a', 1) AS m, array(1) AS l UNION ALL SELECT 1, map('a', 1), array(2)")
    assert [tuple(r) for r in keep_one(df, ["k"]).collect()] == [(1, {"a": 1}, [2])]


# --- soft rules -----------------------------------------------------------------------------------


def judged(spark, policy, values, kind="string", **rules):
    contract = make(column("i", "int"), column("c", kind, rules={**rules, "on_fail": policy}))
    df = spark.createDataFrame(list(enumerate(values)), f"i int, c {'decimal(9,2)' if kind.startswith('dec') else kind}")
    return [tuple(r) for r in judge(df, contract).orderBy("i").select("c", FLAGS, REASON).collect()]


TWO = {"regex": "^x", "valid_email": True}
BOTH = ["regex:c", "invalid_email:c"]


def test_warn_flags_every_failing_check(spark):
    assert judged(spark, "warn", ["q", "x@y.z", None, ""], **TWO) == [
        ("q", BOTH, None), ("x@y.z", [], None), (None, [], None), ("", BOTH, None),
    ]


def test_nullify_flags_the_first_failing_check_only(spark):
    assert judged(spark, "nullify", ["q", "xq", "x@y.z", None], **TWO) == [
        (None, ["regex:c"], None), (None, ["invalid_email:c"], None), ("x@y.z", [], None), (None, [], None),
    ]


def test_quarantine_names_the_first_failing_check_and_flags_nothing(spark):
    assert judged(spark, "quarantine", ["q", "xq", "x@y.z"], **TWO) == [
        ("q", [], "rule_violation:regex:c"), ("xq", [], "rule_violation:invalid_email:c"), ("x@y.z", [], None),
    ]


def test_bounds_are_strict_and_nan_is_above(spark):
    got = judged(spark, "warn", [0.0, -0.1, 1.0, 1.1, float("nan"), None], "double", min=0, max=1)
    assert [flags for _, flags, _ in got] == [[], ["below_min:c"], [], ["above_max:c"], ["above_max:c"], []]


def test_regex_searches_and_does_not_match_whole(spark):
    assert [f for _, f, _ in judged(spark, "warn", ["abc", "ac"], regex="b")] == [[], ["regex:c"]]


def test_text_rules_take_numbers_too(spark):
    assert [f for _, f, _ in judged(spark, "warn", [12, 34], "int", regex="^1")] == [[], ["regex:c"]]


def test_unique_flags_all_members_and_no_nulls(spark):
    got = judged(spark, "warn", ["a", "b", "a", None, None, "a"], unique=True)
    assert [f for _, f, _ in got] == [["duplicate:c"], [], ["duplicate:c"], [], [], ["duplicate:c"]]


def test_unique_under_nullify_counts_values_left_by_earlier_checks(spark):
    got = judged(spark, "nullify", ["q", "q", "x", "x", "xy"], regex="^x", unique=True)
    assert got == [
        (None, ["regex:c"], None), (None, ["regex:c"], None), (None, ["duplicate:c"], None),
        (None, ["duplicate:c"], None), ("xy", [], None),
    ]


def test_unique_counts_rows_that_another_rule_quarantines(spark):
    contract = make(
        column("i", "int", rules={"min": 1, "on_fail": "quarantine"}), column("c", rules={"unique": True, "on_fail": "quarantine"})
    )
    found = apply_contract(spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "i int, c string"), contract)
    assert rows(found.valid) == [(2, "b", [])]
    assert rows(found.quarantine) == [
        (0, "a", "rule_violation:below_min:i", []), (1, "a", "rule_violation:duplicate:c", []),
    ]


def test_flags_follow_column_order_then_check_order(spark):
    contract = make(
        column("u", rules={"unique": True, "regex": "^z"}),
        column("v", rules={"regex": "^z", "on_fail": "nullify"}),
        column("w", rules={"unique": True}),
    )
    df = spark.createDataFrame([("a", "b", "c"), ("a", "b", "c")], "u string, v string, w string")
    flags = ["regex:u", "duplicate:u", "regex:v", "duplicate:w"]
    assert rows(apply_contract(df, contract).valid) == [("a", None, "c", flags)] * 2
    assert [flag for flag, _ in soft_flags(contract)] == flags
    assert [c.name for c in checks_of(contract)] == ["regex", "duplicate", "regex", "duplicate"]


def test_quarantined_row_keeps_flags_and_emptied_values_of_other_columns(spark):
    contract = make(
        column("a", "int", rules={"max": 1, "on_fail": "quarantine"}),
        column("b", rules={"valid_cpf": True, "on_fail": "nullify"}),
        column("c", rules={"valid_email": True}),
    )
    df = spark.createDataFrame([(2, "123", "no")], "a int, b string, c string")
    expected = (2, None, "no", "rule_violation:above_max:a", ["invalid_cpf:b", "invalid_email:c"])
    assert rows(apply_contract(df, contract).quarantine) == [expected]


def test_derived_dates_see_emptied_values(spark):
    contract = make(
        column("t", "timestamp"), column("d", "date"), derived=[{"name": "day", "from": "t"}, {"name": "same", "from": "d"}]
    )
    df = spark.createDataFrame([("2024-02-03 23:59:59", "2024-02-04"), (None, None)], "t string, d string")
    got = apply_contract(df, contract).valid.select("day", "same", FLAGS)
    assert rows(got) == [(None, None, []), (date(2024, 2, 3), date(2024, 2, 4), [])]


# --- whole-table properties -----------------------------------------------------------------------


@pytest.fixture
def messy(spark):
    contract = make(
        column("k", "long", nullable=False),
        column("o", "timestamp", transform="parse_timestamp", formats=["yyyy-MM-dd"]),
        column("e", rules={"unique": True, "valid_email": True, "on_fail": "nullify"}),
        column("n", "double", transform="clean_numeric", nullable=False, rules={"min": 0, "on_fail": "quarantine"}),
        primary_key=["k"],
        dedup={"keys": ["k"], "order_by": "o"},
    )
    rng = random.Random(9)
    data = [
        (
            rng.choice([None, "1", "2", *map(str, range(3, 400))]),
            rng.choice([None, "2024-01-01", "2024-01-02", "bad"]),
            rng.choice([None, "hot@x.y", "hot@x.y", f"a{rng.randint(0, 300)}@x.y", "broken"]),
            rng.choice(["1,5", "-2", "x", "R$ 3"]),
        )
        for _ in range(3000)
    ]
    return contract, data


def test_result_does_not_depend_on_order_or_partitions(spark, messy):
    contract, data = messy
    seen = set()
    for seed, parts in ((1, 1), (2, 4), (3, 17)):
        random.Random(seed).shuffle(data)
        df = spark.createDataFrame(data, "k string, o string, e string, n string").repartition(parts)
        found = apply_contract(df, contract)
        seen.add(str((rows(found.valid), rows(found.quarantine))))
    assert len(seen) == 1


def test_every_row_is_valid_quarantined_or_lost_to_dedup(spark, messy):
    contract, data = messy
    df = spark.createDataFrame(data, "k string, o string, e string, n string")
    found = apply_contract(df, contract)
    complete = complete_rows(conform(df, contract), contract)
    lost = complete.count() - complete.select("k").distinct().count()
    assert found.valid.count() + found.quarantine.count() + lost == len(data)


def test_unique_agrees_with_a_count_window(spark, messy):
    contract, data = messy
    df = spark.createDataFrame(data, "k string, o string, e string, n string")
    plain = make(column("k"), column("e", rules={"unique": True}))
    marked = judge(df, plain).where(F.size(FLAGS) > 0).count()
    counted = df.groupBy("e").count().where("count > 1 AND e IS NOT NULL").agg(F.sum("count")).first()[0]
    assert marked == counted > 0


def test_warn_only_contract_is_idempotent(spark):
    contract = make(column("k", "long", nullable=False), column("e", rules={"unique": True, "regex": "^a"}), dedup={"keys": ["k"]})
    df = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "b"), ("3", "c")], "k string, e string")
    once = apply_contract(df, contract).valid
    assert rows(apply_contract(once, contract).valid) == rows(once)


def test_columns_named_like_helpers_are_kept(spark):
    rules = {"valid_cpf": True, "unique": True, "regex": ".", "on_fail": "quarantine"}
    contract = make(
        column("k", "double", nullable=False, transform="clean_numeric"),
        column("doc", rules=rules),
        column("__spread", rules={"unique": True}),
        dedup={"keys": ["k"], "order_by": "__spread"},
    )
    helpers = ["__task", "__rank", "__winner", "__value", "__hash", "__value0", "__hash0", "__spread0", "__rejected", "__hit_duplicate:doc", "__digits_doc"]
    shown = [f"'own' AS `{name}`" for name in helpers]
    df = spark.createDataFrame([("1", "x", "s"), ("1", "x", "s"), (None, "y", "s"), ("2", "z", "t")], "k string, doc string, __spread string")
    stage = SharedStage(spark, "clash")
    for given in (None, stage):
        found = apply_contract(df.selectExpr("*", *shown), contract, given)
        assert found.valid.count() == 0
        rejected = found.quarantine.collect()
        assert len(rejected) == 3 and {r[name] for r in rejected for name in helpers} == {"own"}
    stage.discard()
    assert found.valid.columns == ["k", "doc", "__spread", "_dq_flags"]
