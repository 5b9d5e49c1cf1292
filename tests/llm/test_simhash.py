from __future__ import annotations

import random

import pytest
import xxhash

from covenant.llm.common import components
from covenant.llm.simhash import _signed, fingerprint, keep_one, links, near_duplicates
from tests.llm.cases import ODD, odd, shingles, words


def plain_fingerprint(text: str | None) -> int:
    found = words(text)
    hashes = [xxhash.xxh64_intdigest(" ".join(s), 42) for s, n in shingles(found, 3).items() for _ in range(n)] if found else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(marks: dict[int, int]) -> dict[int, int]:
    """The smallest id that links of three bits or fewer lead to."""
    todo, out = sorted(marks), {}
    while todo:
        root, edge = todo[0], [todo[0]]
        while edge:
            at = edge.pop()
            out[at] = root
            todo.remove(at) if at in todo else None
            edge += [o for o in todo if o not in out and o not in edge and (marks[o] ^ marks[at]).bit_count() <= 3]
    return out


@pytest.mark.parametrize("text", [None, "", "One", "one TWO", "a b c", "É A b é a B", *(t for _, t, _ in ODD)])
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


def test_groups_of_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = near_duplicates(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    marks = {d: plain_fingerprint(t) for d, t in texts.items()}
    assert {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in rows} == marks
    assert {r["doc_id"]: r["component_id"] for r in rows} == groups(marks)


def test_near_fingerprints(spark):
    """Balls around a few centres: chains and dense groups, against all pairs."""
    draw, marks = random.Random(4), {}
    for _ in range(12):
        centre = draw.getrandbits(64)
        for _ in range(25):
            near = centre
            for bit in draw.sample(range(64), draw.choice((0, 1, 2, 3, 4, 5))):
                near ^= 1 << bit
            marks[_signed(near)] = near
    fps = spark.createDataFrame([(m,) for m in marks], "fp long")
    found = links(fps)
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in found.collect())
    got = {r["node"]: r["component"] for r in components(found).collect()}
    assert {m: got.get(m, m) for m in marks} == groups(marks)


def test_long_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(500, 400), (400, 450)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 400 for i in (400, 450, 500)}


def test_odd_rows(spark):
    docs = odd(spark)
    rows = near_duplicates(docs).collect()
    assert len(rows) == len(ODD)
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}  # all without a word
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 4, 5, 6, 7]
    assert near_duplicates(docs.limit(0)).count() == 0 and keep_one(docs.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    """Decisions hold for the text they were made on."""
    text = [" ".join(f"{w}{i}" for i in range(60)) for w in "abc"]
    rows = [(None, text[0]), (None, text[0]), (1, text[1]), (1, text[2]), (2, text[2]), (None, text[1]), (3, text[0])]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, text[1]), (1, text[2]), (3, text[0])]
    alone = keep_one(spark.createDataFrame([(None, text[0]), (None, text[0]), (None, text[1])], "doc_id long, text string"))
    assert sorted(r["text"] for r in alone.collect()) == [text[0], text[0], text[1]]
