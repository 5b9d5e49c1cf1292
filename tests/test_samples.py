"""The bundled contracts on raw files that hold every kind of trouble they are made for."""

from __future__ import annotations

import json

import pytest

from covenant.plans.job import load_contracts, main, run
from tests import value_model as model

def _json(path, records):
    path.write_text("".join(r if isinstance(r, str) else json.dumps(r) + "\n" for r in records))


def _document(body):
    return next(body + f"{c:02d}" for c in range(100) if model.id_is_valid(body + f"{c:02d}"))


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    """Invented records: 20 payments (15 good ids), 6 customers and a nameless one, 8 fraud signals."""
    folder = tmp_path_factory.mktemp("landing")
    keys = ("transaction_id", "customer_id", "transaction_amount", "transaction_date", "payment_method")
    payments = [dict(zip(keys, (f"tx-{i:03d}", 70 + i, f"{i},{i:02d}", f"2022-11-{i + 1:02d} 0{i % 10}:15:00", "card"))) for i in range(14)]
    payments += [
        dict(zip(keys, ("tx-900", 71, "-4.10", "2022-12-24T18:00:00+02", "cash"))),  # negative: flagged
        dict(zip(keys, ("tx-003", 99, 77, "2022-11-04 03:15:00", None))),  # same id and time: larger customer wins
        dict(zip(keys, ("tx-005", 98, 1, "2021-01-01 00:00:00", "card"))),  # same id, earlier: loses
        dict(zip(keys, ("tx-901", None, "8.00", "2022-12-24 18:00:00", "card"))),
        dict(zip(keys, ("tx-902", 80, "free of charge", "2022-12-24 18:00:00", "card"))),
        dict(zip(keys, ("tx-903", 81, 3.5, "24.12.2022", "card"))),
    ]
    _json(folder / "transactions.json", payments)

    header = "customer_id,customer_name,customer_email,customer_cpf,registration_date\n"
    good = _document("314159265")
    lines = [
        f"11,Zoë Quill,zoe@quill.dev,{good},2019-02-28\n",
        "12,Bram Odd,odd@shared.net,00000000000,2019-03-01\n",
        f"13,Ida Even,odd@shared.net,{good[:9]}-{good[9:]},2020-02-29\n",
        "14,Lou Blank,,,2018-07-07\n",
        "15,Kim Broken,kim#broken.org,5,2018-07-08\n",
        "16,Max Old,max@old.example,,2001-01-01\n",
        "17,,nobody@old.example,,2001-01-02\n",
    ]
    (folder / "customers.csv").write_text(header + "".join(lines), encoding="utf-8")

    signals = [("a", "LOW"), ("b", 0.625), ("c", " High "), ("d", "-3"), ("e", 250), ("f", "unclear"), ("g", None), ("a", 0.75)]
    _json(
        folder / "fraud_flags.json",
        [{"transaction_id": i, "fraud_score": s, "fraud_flag": i in "ace", "fraud_reason": f"r{n}"} for n, (i, s) in enumerate(signals)],
    )
    return folder


@pytest.fixture(scope="module")
def published(spark, landing, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("silver"))
    report = {(r["table"], r["metric"]): r["n"] for r in run(spark, load_contracts(), target, str(landing)).collect()}
    return target, report


def table(spark, published, name, key):
    return {r[key]: r for r in spark.read.parquet(f"{published[0]}/{name}").collect()}


def test_counts(published):
    counts = {name: (published[1][name, "valid"], published[1][name, "quarantine"]) for name, _ in published[1]}
    assert counts == {"transactions_silver": (15, 3), "customers_silver": (6, 1), "fraud_flags_silver": (7, 0)}


def test_transactions(spark, published):
    got = table(spark, published, "transactions_silver", "transaction_id")
    assert set(got) == {f"tx-{i:03d}" for i in range(14)} | {"tx-900"}
    assert str(got["tx-013"]["transaction_amount"]) == "13.13" and got["tx-005"]["customer_id"] == 75
    assert (got["tx-003"]["customer_id"], got["tx-003"]["payment_method"]) == (99, None)
    assert str(got["tx-900"]["transaction_date"]) == "2022-12-24 16:00:00"
    assert str(got["tx-900"]["transaction_date_ref"]) == "2022-12-24"
    assert {i for i in got if got[i]["_dq_flags"]} == {"tx-900"}
    rejected = table(spark, published, "transactions_silver_quarantine", "transaction_id")
    assert {i: r["_quarantine_reason"] for i, r in rejected.items()} == {
        "tx-901": "not_nullable_violation:customer_id",
        "tx-902": "not_nullable_violation:transaction_amount",
        "tx-903": "not_nullable_violation:transaction_date",
    }


def test_customers(spark, published):
    got = table(spark, published, "customers_silver", "customer_id")
    shared = ["duplicate:customer_email"]
    assert {i: r["_dq_flags"] for i, r in got.items()} == {
        11: [], 12: [*shared, "invalid_cpf:customer_cpf"], 13: shared, 14: [], 15: ["invalid_email:customer_email"], 16: [],
    }
    assert got[11]["customer_cpf"] == got[13]["customer_cpf"] == _document("314159265")
    assert got[12]["customer_cpf"] is None and got[11]["customer_name"] == "Zo\u00eb Quill"
    assert str(got[13]["registration_month"]) == "2020-02-29"  # the full date
    assert published[1]["customers_silver", "invalid_cpf:customer_cpf"] == 1


def test_fraud_flags(spark, published):
    got = table(spark, published, "fraud_flags_silver", "transaction_id")
    assert {i: r["fraud_score"] for i, r in got.items()} == {"a": 0.75, "b": 0.625, "c": 0.9, "d": 0.0, "e": 1.0, "f": None, "g": None}
    assert got["c"]["fraud_flag"] is True and got["b"]["fraud_flag"] is False and got["a"]["fraud_reason"] == "r7"


def test_corrupt_lines_are_quarantined_with_their_text(spark, landing, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    good = (landing / "transactions.json").read_text()
    (source / "transactions.json").write_text(good + "{bad json\n")
    contract = [c for c in load_contracts() if c.name == "transactions_silver"]
    run(spark, contract, str(tmp_path / "out"), str(source))
    rejected = spark.read.parquet(str(tmp_path / "out" / "transactions_silver_quarantine"))
    assert [r["_corrupt_record"] for r in rejected.collect() if r["_corrupt_record"]] == ["{bad json"]
    assert rejected.count() == 4


def test_command_line_options_reach_the_job(monkeypatch, spark, landing, tmp_path, capsys):
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    main(["--output", str(tmp_path / "cli"), "--source-base", str(landing)])
    printed = capsys.readouterr().out
    assert "[customers_silver] valid=6 quarantine=1" in printed
    assert "[transactions_silver] valid=15 quarantine=3" in printed
