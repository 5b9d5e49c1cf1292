from __future__ import annotations

import random
import time
from collections import defaultdict

import pytest

from covenant.llm.line_dedup import dedup_lines, later_copies, line_report
from tests.llm.cases import CLASHES, ODD, odd, words


def without_copies(rows: list[tuple[int, str]], least: int) -> dict[int, str]:
    """Every run of lines with words, of enough words, that occurs earlier loses its lines."""
    seen, runs, gone = {}, [], defaultdict(set)
    for doc, text in sorted(rows):
        lines = [(n, line) for n, line in enumerate(text.split("\n")) if words(line)]
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(len(words(line)) for _, line in lines[a : b + 1]) >= least:
                    key = tuple(line for _, line in lines[a : b + 1])
                    seen.setdefault(key, (doc, a))
                    runs.append((key, (doc, a), [n for n, _ in lines[a : b + 1]]))
    for key, place, numbers in runs:
        if seen[key] < place:
            gone[place[0]].update(numbers)
    return {d: "\n".join(line for n, line in enumerate(t.split("\n")) if n not in gone[d]) for d, t in rows}


@pytest.mark.parametrize("least", [1, 3, 4, 7, 20])
def test_against_all_runs(spark, least):
    draw = random.Random(least)
    lines = ["a", "b", "c d", "e f g", "", "h i j k l", " "]
    rows = [(i, "\n".join(draw.choice(lines) for _ in range(draw.randint(0, 14)))) for i in range(40)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), least_words=least).collect()
    assert {r["doc_id"]: r["text"] for r in got} == without_copies(rows, least)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["text"].count("\n") < 40]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["text"] for r in got} == without_copies(rows, 50)


def test_odd_rows(spark):
    docs = odd(spark)
    out = dedup_lines(docs, least_words=3)
    assert out.columns == docs.columns and out.count() == len(ODD)
    texts = sorted(((r["doc_id"] or 0, r["text"]) for r in out.collect() if r["doc_id"] in (1, 2, 5, 6)), key=repr)
    # the repeated rows of document 6 are one document, a later copy of document 5
    assert texts == sorted([(1, None), (2, ""), (5, ODD[5][1]), (6, ""), (6, ""), (6, ODD[8][1])], key=repr)
    assert all(r[c] == c for r in out.collect() for c in CLASHES)


def test_empty_table(spark):
    none = odd(spark).limit(0)
    assert dedup_lines(none).count() == 0 and line_report(none).count() == 0


def test_sources_are_the_earliest(spark):
    passage = " ".join(map(str, range(60)))
    docs = spark.createDataFrame([(i, f"head {i}\n{passage}\ntail {i}") for i in range(5)], "doc_id long, text string")
    runs = later_copies(docs).collect()
    assert sorted(r["doc"]["id"] for r in runs) == [1, 2, 3, 4]
    assert {(r["source"]["doc"]["id"], r["source"]["start"], r["start"], r["length"]) for r in runs} == {(0, 1, 1, 1)}


def test_many_lines_in_one_text(spark):
    """Two texts of 60,000 lines each, half of the second copied from the first."""
    lines = [f"line number {i} of some words that are told" for i in range(60_000)]
    other = [line if i % 100 < 50 else f"own {i}" for i, line in enumerate(lines)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(other))], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs).collect()}
    assert got == {1: "\n".join(lines), 2: "\n".join(line for line in other if line.startswith("own"))}
    assert time.time() - began < 120
