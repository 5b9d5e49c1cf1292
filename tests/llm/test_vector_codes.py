from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from covenant.llm.queries import op12_vector_codes
from covenant.llm.vector_codes import codes, compress, grow, label_errors, owners, sums


def plain(rows: list[tuple], parts: int, entries: int, rounds: int) -> tuple[list[tuple], list]:
    """(id, label, code, error) and codebooks, in plain Python numbers."""
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    width = len(kept[0][2]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, rows[k][2]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def assigned(p: int, part: list[int]) -> tuple[int, int]:
        return min((sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        moved = []
        for p in range(parts):
            mine = [[] for _ in books[p]]
            for vector in cut:
                mine[assigned(p, vector[p])[1]].append(vector[p])
            moved.append([[sum(c) // len(own) for c in zip(*own, strict=True)] if own else books[p][e] for e, own in enumerate(mine)])
        books = moved
    out = []
    for (i, label, _), vector in zip(kept, cut, strict=True):
        found = [assigned(p, vector[p]) for p in range(parts)]
        out.append((i, label, [e for _, e in found], sum(far for far, _ in found)))
    return out, books


@pytest.mark.parametrize(("n", "parts", "width", "entries", "spread"), [(5, 2, 3, 3, 50), (400, 3, 4, 20, 9), (1500, 4, 2, 64, 40), (300, 1, 1, 8, 2), (900, 2, 2, 16, 0)])
def test_trees_agree_with_all_distances(n, parts, width, entries, spread):
    draw = np.random.default_rng(n)
    points = draw.integers(-spread, spread + 1, (n, parts, width))
    books = points[:entries].swapaxes(0, 1).copy()
    forest = grow(points)
    far = ((points[:, :, None] - books[None]) ** 2).sum(-1)
    found, error = codes(forest, books)
    assert (found == far.argmin(-1)).all() and (error == far.min(-1)).all()
    want = np.zeros((parts, len(books[0]), width + 1), np.int64)
    for p in range(parts):
        np.add.at(want[p], found[:, p], np.column_stack([points[:, p], np.ones(n, int)]))
    assert (sums(forest, books) == want).all()
    for ball, parent in enumerate(forest.parent):
        _, inside = forest.runs(np.array([ball]))
        assert (points[inside, forest.tree[ball]].sum(axis=0) == forest.total[ball]).all()
        assert parent < 0 or forest.first[parent] <= forest.first[ball] <= forest.last[ball] <= forest.last[parent]


def test_balls_around_an_entry_are_owned_wholly():
    draw = np.random.default_rng(3)
    centres = np.array([[0, 0], [10_000, 0], [0, 10_000]])
    points = (centres[draw.integers(0, 3, 2000)] + draw.integers(-50, 51, (2000, 2)))[:, None]
    forest = grow(points)
    balls, _, (_, single, _) = owners(forest, centres[None])
    assert len(single) < 20 and (forest.last[balls] - forest.first[balls]).sum() + len(single) == 2000


def test_against_plain_python(spark):
    draw = random.Random(4)
    rows = [(i // 2 if i > 40 else i, draw.choice([None, 1, 2]), [draw.choice([0.0, 0.25, -0.1, draw.uniform(-1, 1)]) for _ in range(8)]) for i in range(400)]
    rows += [(None, 3, [0.5] * 8), (None, 3, [0.5] * 8), (399, 3, [-0.5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    found = compress(df, parts=4, entries=10, rounds=3)
    want, books = plain(rows, 4, 10, 3)
    assert found.books.tolist() == books
    got = [(r["vec_id"], r["label"], r["code"], r["error"]) for r in found.codes.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    of_label = {}
    for _, label, _, error in want:
        of_label[label] = of_label.get(label, 0) + error
    assert all(r["label_error"] == of_label[r["label"]] for r in label_errors(found.codes).collect())


def test_odd_vectors(spark):
    good = [0.25] * 16
    odd = [None, [], [None, *good[1:]], [math.nan, *good[1:]], [math.inf, *good[1:]], [-math.inf, *good[1:]], good[:15], good * 2, [1e30, *good[1:]]]
    rows = [(i, None if i % 2 else 7, v, "x") for i, v in enumerate([good, *odd, good])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, code string")
    told = label_errors(compress(df).codes).collect()
    assert sorted((r["vec_id"], r["label"], r["code"], r["error"], r["label_error"]) for r in told) == [(0, 7, [0] * 16, 0, 0), (10, 7, [0] * 16, 0, 0)]
    for none in (df.where("vec_id in (1, 3)"), df.limit(0)):
        found = compress(none)
        assert label_errors(found.codes).count() == 0 and found.books.size == 0


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    want, books = plain([(r["vec_id"], r["label"], r["embedding"]) for r in rows], 16, 64, 2)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    got = op12_vector_codes(spark, "/root/testdata/sf0.01").collect()
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == {i: ("".join(f"{e:02x}" for e in code), far) for i, _, code, far in want}
    assert {r["codebooks_sha256"] for r in got} == {digest}
