from __future__ import annotations

import inspect

from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from covenant.llm.oracle import ORACLE
from covenant.llm.queries import QUERIES
from tests.check_oracle import connect, difference
from tests.llm.cases import odd, words
from tests.llm.test_decontaminate import plain as contaminated
from tests.llm.test_line_dedup import without_copies
from tests.llm.test_repetition import plain as measured
from tests.llm.test_simhash import groups, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLE) <= set(oracle_sql())
    assert sorted(int(n[2 : n.index("_")]) for n in QUERIES) == list(range(1, 14))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)


def test_sql(spark):
    duck = connect(SF)
    for name in ORACLE:
        assert difference(spark, duck, SF, name) == "", name


def test_stages_against_plain_python(spark):
    """Each stage on what the one before left, against brute force on the same rows."""
    stages = [f for _, f in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.where("length(text) < 4000").cache()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    def after(stage):
        nonlocal docs
        columns = docs.columns
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        return {r["doc_id"]: r["text"] for r in docs.collect()}

    want = {d: t for d, t in texts.items() if measured(t)[-1]}
    assert (got := after(stages[0])) == want and len(got) < len(texts)
    want = {d: t for d, t in without_copies(list(got.items()), 50).items() if words(t)}
    assert (got := after(stages[1])) == want
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    roots = groups({d: plain_fingerprint(t) for d, t in got.items()})
    want = {d: t for d, t in got.items() if roots[d] == d}
    assert (got := after(stages[2])) == want
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, _ in contaminated(list(got.items()), items)}
    want = {d: t for d, t in got.items() if d not in bad}
    assert bad and (got := after(stages[3])) == want
    packed = stages[4](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == set(got)
    assert corpus_pipeline.run(spark, SF).columns == packed[0].__fields__


def test_stages_take_odd_rows_and_empty_tables(spark):
    """Nulls everywhere, repeated rows, clashing names; every stage hands on the columns it got."""
    docs = odd(spark).withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == table.columns, name
            assert out.count() <= table.count()
        packed = corpus_pipeline.STAGES[-1][1](spark, table, SF)
        assert packed.select("doc_id").distinct().count() == table.select("doc_id").distinct().count()
