from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from covenant.llm.spelling import LOWER, UPPER, Acceptors, variants, vocabulary
from tests.llm.cases import odd


def counts(rows: list[tuple]) -> dict[str, int]:
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(UPPER, LOWER))
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += len(run) >= 5
    return {word: n for word, n in found.items() if n >= 3}


def near(n: dict[str, int]) -> dict[str, set[str]]:
    """By every word with a letter left out, and words that share one with the letter at the same place."""
    found, holes = defaultdict(set), defaultdict(set)
    for word in n:
        for i in range(len(word)):
            holes[word[:i], word[i + 1 :]].add(word)
            if (less := word[:i] + word[i + 1 :]) in n:
                found[word].add(less)
                found[less].add(word)
    for alike in holes.values():
        for word in alike:
            found[word] |= alike - {word}
    return found


def told(n: dict[str, int]) -> dict[str, tuple]:
    links, form, out = near(n), {}, {}
    for word in n:
        best = min(links[word], key=lambda w: (-n[w], w), default=None)
        form[word] = best if best is not None and n[best] >= 2 * n[word] else None
    for word in n:
        root = word
        while form[root] is not None:
            root = form[root]
        out[word] = (n[word], len(links[word]), form[word], n.get(form[word]), root)
    return out


def found(spark, n: dict[str, int], **sizes) -> dict[str, tuple]:
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    rows = variants(words, **sizes).collect()
    assert len(rows) == len(n)
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}


def some_words(seed: int, count: int, letters: str) -> dict[str, int]:
    draw, n = random.Random(seed), {}
    while len(n) < count:
        n["".join(draw.choice(letters) for _ in range(draw.randint(1, 7)))] = draw.choice((3, 4, 6, 8, 12, 30))
    return n


@pytest.mark.parametrize("sizes", [{}, {"cell": 20}, {"cell": 2, "span": 2}])
def test_against_all_pairs(spark, sizes):
    n = some_words(7, 700, "abé")
    assert found(spark, n, **sizes) == told(n)


def test_long_words_and_runs_of_one_letter(spark):
    draw = random.Random(8)
    base = "".join(draw.choice("acgt") for _ in range(500))
    n = {base[:i] + draw.choice(["", "a", "c", "gg"]) + base[i + 1 :]: draw.randint(3, 50) for i in draw.choices(range(500), k=25)}
    n |= {"a" * (60 + k // 4) + draw.choice(["", "b"]) + "a" * (k % 4): draw.randint(3, 40) for k in range(30)}
    assert found(spark, n, cell=5) == told(n)


def test_chains_of_forms(spark):
    n = {"chain" + "x" * k: 3 * 2**k for k in range(20)} | {"lonely": 3}
    got = found(spark, n)
    assert got == told(n)
    assert {r[4] for w, r in got.items() if w != "lonely"} == {"chain" + "x" * 19} and got["lonely"] == (3, 0, None, None, "lonely")


def test_acceptors_are_minimal():
    machine = Acceptors()
    start = machine.of(sorted(["tap", "taps", "top", "tops"]))
    assert len(machine.states) == 5 and machine.of(sorted(["tap", "taps", "top", "tops"])) == start
    assert machine.both(start, machine.of(["tap", "tip", "tops"])) == ["tap", "tops"]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    n = counts([tuple(r) for r in docs.collect()])
    words = vocabulary(docs)
    assert {r["word"]: r["n"] for r in words.collect()} == n
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in variants(words).collect()}
    assert got == told(n)


def test_odd_rows(spark):
    docs = odd(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    words = vocabulary(docs.unionByName(docs).unionByName(docs))
    n = counts(rows * 3)
    assert {r["word"]: r["n"] for r in words.collect()} == n and max(map(len, n)) >= 70_000 - 1
    assert {r["word"]: r["root"] for r in variants(words).collect()} == {w: r[4] for w, r in told({w: k for w, k in n.items() if len(w) < 99}).items()} | {w: w for w in n if len(w) > 99}
    assert variants(vocabulary(docs.limit(0))).count() == 0
