"""Sources, sinks, staging and the report."""

from __future__ import annotations

import json
from dataclasses import replace
from datetime import date
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from covenant import apply_contract
from covenant.contract import FLAGS, REASON
from covenant.plans import job
from covenant.plans.job import publish
from covenant.sinks import SharedStage, is_table_target, shared_folder, write_outcome
from covenant.sinks.report import quality_report
from covenant.sinks.writers import FolderSwap
from covenant.sources import read_source
from tests.helpers import column, make, plan_of, rows


@pytest.fixture
def small(spark):
    contract = make(
        column("k", "long", nullable=False),
        column("d", "date"),
        column("v", "int", rules={"min": 0, "on_fail": "quarantine"}),
        column("w", rules={"regex": "^a"}),
        primary_key=["k"],
        partition_by=["d"],
    )
    df = spark.createDataFrame(
        [(1, "2024-01-01", 5, "a"), (2, "2024-01-02", -5, "a"), (None, "2024-01-02", 1, "b"), (3, "2024-01-02", 1, "b")],
        "k long, d string, v int, w string",
    )
    return contract, df


def test_target_kinds():
    assert is_table_target("main.silver")
    assert not is_table_target("data/silver")
    assert not is_table_target("/Volumes/main/bronze")
    assert not is_table_target("C:\\data.d")
    assert not is_table_target("silver")


def test_files_are_partitioned_and_overwritten(spark, small, tmp_path):
    contract, df = small
    for _ in range(2):
        write_outcome(apply_contract(df, contract), contract, str(tmp_path))
    valid = spark.read.parquet(str(tmp_path / "sample"))
    assert rows(valid.select("k", "d", "v", "w", FLAGS)) == [
        (1, date(2024, 1, 1), 5, "a", []), (3, date(2024, 1, 2), 1, "b", ["regex:w"]),
    ]
    assert sorted(p.name for p in (tmp_path / "sample").glob("d=*")) == ["d=2024-01-01", "d=2024-01-02"]
    pruned = valid.where("d = DATE'2024-01-01'")
    assert "PartitionFilters: [isnotnull(d" in plan_of(pruned) and pruned.count() == 1
    quarantine = tmp_path / "sample_quarantine"
    assert not list(quarantine.glob("d=*"))
    assert rows(spark.read.parquet(str(quarantine)).select("k", REASON)) == [
        (2, "rule_violation:below_min:v"), (None, "null_primary_key:k"),
    ]


def test_a_partition_is_written_to_few_files(spark, tmp_path):
    contract = make(column("k", "long"), column("p", "int"), partition_by=["p"])
    df = spark.range(0, 4000, 1, 16).selectExpr("id AS k", "CAST(id % 3 AS INT) AS p")
    write_outcome(apply_contract(df, contract), contract, str(tmp_path))
    files = list(Path(tmp_path / "sample").glob("p=*/*.parquet"))
    assert len(files) == 3


def test_tables_are_created_in_their_schema(spark, small):
    contract, df = small
    where = write_outcome(apply_contract(df, contract), contract, "spark_catalog.silver_test")
    assert where == "parquet tables in spark_catalog.silver_test"
    write_outcome(apply_contract(df, contract), contract, "spark_catalog.silver_test")
    assert spark.table("silver_test.sample").count() == 2
    assert spark.table("silver_test.sample_quarantine").count() == 2
    parts = spark.sql("SHOW PARTITIONS silver_test.sample").count()
    assert parts == 2


def test_a_folder_with_a_dot_can_be_forced(spark, small, tmp_path, monkeypatch):
    contract, df = small
    monkeypatch.chdir(tmp_path)
    target = f"file:{tmp_path}/out.v2"
    write_outcome(apply_contract(df, contract), contract, target, as_table=False)
    assert (tmp_path / "out.v2" / "sample").is_dir()


def test_publish_counts_while_writing(spark, small, tmp_path):
    contract, df = small
    counted = {metric: n for _, metric, n in publish(spark, contract, str(tmp_path), source=df)}
    assert counted == {
        "valid": 2, "regex:w": 1, "quarantine": 2, "null_primary_key:k": 1, "rule_violation:below_min:v": 1,
    }
    lazy = {r["metric"]: r["n"] for r in quality_report(apply_contract(df, contract), contract).collect()}
    assert lazy == counted


def test_publish_to_tables_counts_too(spark, small):
    contract, df = small
    counted = {metric: n for _, metric, n in publish(spark, contract, "spark_catalog.silver_counts", source=df)}
    assert (counted["valid"], counted["quarantine"]) == (2, 2)
    assert spark.table("silver_counts.sample").count() == 2


def test_scattered_rejects_share_a_file(spark, tmp_path):
    contract = make(column("k", "long", nullable=False))
    df = spark.range(0, 4000, 1, 16).selectExpr("IF(id % 100 = 7, NULL, id) AS k")
    write_outcome(apply_contract(df, contract), contract, str(tmp_path))
    assert len(list(Path(tmp_path / "sample_quarantine").glob("*.parquet"))) == 1
    assert spark.read.parquet(str(tmp_path / "sample_quarantine")).count() == 40


def test_shuffles_start_with_room_for_the_input(spark, monkeypatch):
    key, zone = job.PARTITIONS, job.ZONE
    df = spark.range(0, 10, 1, 6)
    for size, expected in ((1000, None), (10 * 2**30, "80"), (100 * 2**40, "81920"), (2**63 - 1, "6")):
        monkeypatch.setattr(job, "input_bytes", lambda _, size=size: size)
        spark.conf.set(zone, "America/Manaus")
        with job.tuned(spark, df):
            assert spark.conf.get(key, None) == expected
            assert spark.conf.get(job.HASH_JOIN) == "64MB"
            assert spark.conf.get(zone) == "UTC"
        assert spark.conf.get(key, None) is None
        assert spark.conf.get(job.HASH_JOIN, None) is None
        assert spark.conf.get(zone) == "America/Manaus"
        spark.conf.set(zone, "UTC")
    with job.tuned(spark, df, 33):
        assert spark.conf.get(key) == "33"
    spark.conf.set(key, "7")
    with job.tuned(spark, df):
        assert spark.conf.get(key) == "7"
    spark.conf.unset(key)


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_publish_does_not_depend_on_the_zone(spark, tmp_path, zone):
    contract = make(column("at", "timestamp", transform="parse_timestamp", formats=["yyyy-MM-dd HH:mm:ss"]))
    df = spark.createDataFrame([("2024-03-01 23:30:00",)], "at string")
    spark.conf.set("spark.sql.session.timeZone", zone)
    publish(spark, contract, str(tmp_path), source=df)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert str(spark.read.parquet(str(tmp_path / "sample")).first()["at"].isoformat()) in ("2024-03-01T23:30:00",)


def test_a_folder_may_look_like_a_schema(spark, small, tmp_path, monkeypatch):
    contract, df = small
    monkeypatch.chdir(tmp_path)
    publish(spark, contract, str(tmp_path / "out.v2"), source=df, as_table=False)
    assert (tmp_path / "out.v2" / "sample").is_dir()
    assert is_table_target("out.v2")


def test_input_size_is_known_before_the_run(spark, tmp_path):
    spark.range(100000).write.parquet(str(tmp_path / "p"))
    assert 1000 < job.input_bytes(spark.read.parquet(str(tmp_path / "p"))) < 2**21


def test_own_folder_only_on_a_local_master(spark):
    def session(**known):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: known.get(key.rsplit(".", 1)[1], default)))

    assert shared_folder(session(dir="hdfs://shared/x/", master="yarn")) == "hdfs://shared/x"
    assert shared_folder(session(master="local[4]")) == shared_folder(session(master="local"))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", ""):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(master=master))


def test_judged_rows_are_staged_once_in_the_shared_folder(spark, small):
    contract, df = small
    plain = apply_contract(df, contract)
    stage, other = SharedStage(spark, "sample"), SharedStage(spark, "sample")
    staged, again = apply_contract(df, contract, stage), apply_contract(df.limit(0), contract, other)
    assert rows(staged.valid) == rows(plain.valid)
    assert rows(staged.quarantine) == rows(plain.quarantine)
    assert again.valid.count() == 0  # a second outcome leaves the first one's rows alone
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert "staged/sample-" in plan_of(staged.valid)
    assert "PartitionFilters: [" in plan_of(staged.valid) and "__rejected" in plan_of(staged.valid)
    for each in (stage, other):
        assert Path(each.path).exists()
        each.discard()
        assert not Path(each.path).exists()


def test_json_reads_text_with_declared_fields(spark, tmp_path):
    path = tmp_path / "in.json"
    records = [{"k": 1, "n": 12345678.90, "extra": {"x": 1}}, {"k": "2", "n": "1e-1"}]
    path.write_text("\n".join(map(json.dumps, records)) + "\nnot json\n")
    source = {"format": "json", "path": str(path), "fields": ["extra"]}
    contract = make(column("k", "long", nullable=False), column("n", "double", transform="clean_numeric"), source=source)
    raw = read_source(spark, contract)
    assert raw.dtypes == [("k", "string"), ("n", "string"), ("extra", "string"), ("_corrupt_record", "string"), ("_undeclared_fields", "map<string,string>")]
    found = apply_contract(raw, contract)
    assert rows(found.valid) == [(1, 12345678.9, []), (2, 0.1, [])]
    assert [(r["_corrupt_record"], r["extra"]) for r in found.quarantine.collect()] == [("not json", None)]
    inferred = make(column("k", "long"), source={**source, "infer": True, "fields": []})
    assert "extra" in read_source(spark, inferred).columns


def test_json_keeps_what_the_contract_does_not_declare(spark, tmp_path):
    path = tmp_path / "in.json"
    path.write_text('{"n":"b","zz":"kept?","o":{"x":1}}\n\n[{"k":1,"n":"c"},{"n":"d","y":2.50}]\n{"K":"7","N":"e","k2":1}\n[broken\n')
    source = {"format": "json", "path": str(path)}
    contract = make(column("k", "long", nullable=False), column("n"), source=source)
    found = apply_contract(read_source(spark, contract), contract)
    assert rows(found.valid) == [(1, "c", []), (7, "e", [])]  # the session ignores case
    rejected = {r["n"]: (r["_undeclared_fields"], r["_corrupt_record"]) for r in found.quarantine.collect()}
    assert rejected == {"b": ({"zz": "kept?", "o": '{"x":1}'}, None), "d": ({"y": "2.5"}, None), None: (None, "[broken")}
    spelled = make(column("k", "long", nullable=False), column("n"), source={**source, "fields": ["K", "k2"]})
    raw = read_source(spark, spelled)
    assert raw.columns == ["K", "n", "k2", "_corrupt_record", "_undeclared_fields"]
    assert rows(apply_contract(raw, spelled).valid) == [(1, "c", []), (7, "e", [])]


def test_json_names_are_exact_where_the_session_says_so(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"K":"7"}\n{"k":"8"}\n')
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        raw = read_source(spark, make(column("k"), source={"format": "json", "path": str(tmp_path / "in.json")}))
        assert rows(raw.select("k", "_undeclared_fields")) == [("8", None), (None, {"K": "7"})]
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_csv_is_text_with_a_header_unless_told_otherwise(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("a;b\n1;\n2;x\n")
    source = {"format": "csv", "path": str(path), "options": {"sep": ";"}}
    raw = read_source(spark, make(column("a"), source=source))
    assert raw.columns == ["a", "b", "_corrupt_record"] and rows(raw) == [("1", None, None), ("2", "x", None)]
    typed = {**source, "options": {"sep": ";", "inferSchema": True}}
    assert read_source(spark, make(column("a"), source=typed)).dtypes[0] == ("a", "int")


def test_parquet_and_table_sources(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "p"))
    assert read_source(spark, make(column("id"), source={"format": "parquet", "path": str(tmp_path / "p")})).count() == 3
    spark.range(4).createOrReplaceTempView("four_rows")
    assert read_source(spark, make(column("id"), source={"format": "table", "path": "four_rows"})).count() == 4


def test_partitions_grow_slower_than_a_very_large_input():
    expected = {2**30: 8, 2**40: 8192, 100 * 2**40: 81920, 2**50: 524288}
    for size, partitions in expected.items():
        assert -(-size // job.partition_bytes(size)) == partitions
    assert job.partition_bytes(100 * 2**40) == 10 * job.PARTITION_BYTES


def test_scans_of_very_large_inputs_get_larger_tasks(spark, monkeypatch):
    usual = spark.conf.get(job.SCAN_BYTES)
    for size, expected in ((2**40, usual), (100 * 2**40, str(1280 * 2**20)), (2**63 - 1, usual)):
        monkeypatch.setattr(job, "input_bytes", lambda _, size=size: size)
        with job.tuned(spark, spark.range(1)):
            assert spark.conf.get(job.SCAN_BYTES) == expected
        assert spark.conf.get(job.SCAN_BYTES) == usual


def test_csv_records_that_do_not_fit_show_in_the_quarantine(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('k,v\n1,a\n,b,surplus,"more"\n2\n,c\n3,d,e\n')
    source = {"format": "csv", "path": str(path)}
    contract = make(column("k", "long", nullable=False), column("v"), source=source)
    found = apply_contract(read_source(spark, contract), contract)
    assert rows(found.valid) == [(1, "a", []), (2, None, []), (3, "d", [])]
    assert rows(found.quarantine.select("v", "_corrupt_record")) == [("b", ',b,surplus,"more"'), ("c", None)]
    (tmp_path / "own.csv").write_text("k,_corrupt_record\n1,a\n,b\n")
    own = make(column("k", "long", nullable=False), source={"format": "csv", "path": str(tmp_path / "own.csv")})
    assert rows(apply_contract(read_source(spark, own), own).quarantine.select("_corrupt_record")) == [("b",)]


@pytest.mark.parametrize("fmt", ["json", "csv"])
@pytest.mark.parametrize("policy", ["warn", "quarantine"])
def test_publish_parses_text_once(spark, tmp_path, monkeypatch, fmt, policy):
    path = str(tmp_path / "in")
    data = [("1", "a", "x"), ("1", "b", "y"), (None, "c", "z"), ("2", "a", "w"), ("3", None, "v")]
    getattr(spark.createDataFrame(data, "k string, u string, more string").coalesce(1).write.options(header=True), fmt)(path)
    rules = {"unique": True, "regex": "^a", "on_fail": policy}
    parts = {"source": {"format": fmt, "path": path, "fields": ["more"]}, "dedup": {"keys": ["k"], "order_by": "u"}}
    contract = make(column("k", "long", nullable=False), column("u", rules=rules), **parts)
    plain = apply_contract(read_source(spark, contract), contract)
    scans, outcomes = [], []
    land, write = SharedStage.land, job.write_outcome
    monkeypatch.setattr(SharedStage, "land", lambda self, typed, condition: (scans.append(plan_of(typed)), land(self, typed, condition))[1])
    monkeypatch.setattr(job, "write_outcome", lambda outcome, *rest: (outcomes.append(outcome), write(outcome, *rest))[1])
    publish(spark, contract, str(tmp_path / "out"))
    assert len(scans) == 1 and scans[0].count("FileScan") == 1
    for df in (outcomes[0].valid, outcomes[0].quarantine):
        assert "FileScan parquet" in plan_of(df) and "FileScan text" not in plan_of(df) and "FileScan csv" not in plan_of(df)
    written = [spark.read.parquet(str(tmp_path / "out" / f"sample{suffix}")) for suffix in ("", "_quarantine")]
    assert rows(written[0]) == rows(plain.valid)
    shown = [c for c in plain.quarantine.columns if not c.startswith("_undeclared")]
    assert rows(written[1].select(shown)) == rows(plain.quarantine.select(shown))


def test_a_publication_that_stores_nothing_needs_no_folder(spark, small, tmp_path, monkeypatch):
    def none(_):
        raise ValueError("spark.checkpoint.dir")

    monkeypatch.setattr("covenant.sinks.staging.shared_folder", none)
    (tmp_path / "in.json").write_text('{"k":1}\n{"k":null}\n')
    source = {"format": "json", "path": str(tmp_path / "in.json")}
    contract = make(column("k", "long", nullable=False), source=source)
    counted = {metric: n for _, metric, n in publish(spark, contract, str(tmp_path / "out"))}
    assert (counted["valid"], counted["quarantine"]) == (1, 1)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        publish(spark, small[0], str(tmp_path / "out"), source=small[1])


def test_partitions_of_an_earlier_run_go_in_dynamic_mode_too(spark, small, tmp_path):
    contract, df = small
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        for target in (str(tmp_path), "silver_dynamic"):
            for given in (df, df.where("d = '2024-01-02'")):
                write_outcome(apply_contract(given, contract), contract, target, as_table=target[0] != "/")
        assert rows(spark.read.parquet(str(tmp_path / "sample")).select("k")) == [(3,)]
        assert rows(spark.table("silver_dynamic.sample").select("k")) == [(3,)]
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")


def test_a_failing_write_leaves_both_old_folders(spark, small, tmp_path):
    contract, df = small
    found = apply_contract(df, contract)
    write_outcome(found, contract, str(tmp_path))
    broken = found.quarantine.withColumn("w", F.raise_error(F.lit("no")))
    with pytest.raises(Exception, match="no"):
        write_outcome(replace(found, valid=found.valid.limit(0), quarantine=broken), contract, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "sample")).count() == 2
    assert spark.read.parquet(str(tmp_path / "sample_quarantine")).count() == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["sample", "sample_quarantine"]


def test_a_failing_move_puts_both_old_folders_back(spark, small, tmp_path, monkeypatch):
    contract, df = small
    write_outcome(apply_contract(df, contract), contract, str(tmp_path))
    move = FolderSwap._move

    def fails(self, name, to):
        if to.endswith("/sample_quarantine") and "_new_" in name:
            raise OSError("no")
        move(self, name, to)

    monkeypatch.setattr(FolderSwap, "_move", fails)
    with pytest.raises(OSError, match="no"):
        write_outcome(apply_contract(df.limit(0), contract), contract, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "sample")).count() == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["sample", "sample_quarantine"]


def named(tmp_path, name, text, **parts):
    (tmp_path / f"{name}.json").write_text(text)
    return make(column("k", "long", nullable=False), name=name, source={"format": "json", "path": str(tmp_path / f"{name}.json")}, **parts)


def test_contracts_run_side_by_side_and_one_failure_leaves_the_others(spark, tmp_path):
    good = [named(tmp_path, f"t{i}", '{"k":%d}\n{}\n' % i) for i in range(3)]
    spark.range(2).createOrReplaceTempView("two_rows")
    view = make(column("id", "long"), name="of_view", source={"format": "table", "path": "two_rows"})
    lost = make(column("k", "long"), name="lost", source={"format": "parquet", "path": str(tmp_path / "nowhere")})
    report = job.run(spark, [*good, view], str(tmp_path / "out"), at_once=3).collect()
    assert [r["table"] for r in report if r["metric"] == "valid"] == ["t0", "t1", "t2", "of_view"]
    with pytest.raises(job.PublishFailed, match="lost: AnalysisException") as failed:
        job.run(spark, [good[0], lost, *good[1:]], str(tmp_path / "again"))
    assert list(failed.value.failures) == ["lost"]
    assert [name for name, metric, n in failed.value.rows if metric == "valid" and n == 1] == ["t0", "t1", "t2"]
    assert all((tmp_path / "again" / f"t{i}").is_dir() for i in range(3))


def test_sessions_of_contracts_have_the_settings_of_the_caller(spark, tmp_path):
    exact = named(tmp_path, "exact", '{"K":1}\n{"k":2}\n')
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        counted = {r["metric"]: r["n"] for r in job.run(spark, [exact, named(tmp_path, "other", "{}\n")], str(tmp_path / "out")).collect() if r["table"] == "exact"}
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert (counted["valid"], counted["quarantine"]) == (1, 1)
