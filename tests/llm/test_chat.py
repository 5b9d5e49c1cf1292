from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from covenant.llm.chat import conversations_as_trees, digests, escaped, format_paths, parsed, paths, render

MARKS = ["<s>[", "]", "[/]</s>", "\\", "\\l", "\\-", "<", "[", "\n", "é", "\U0001f600", "a", "", "$1"]


def test_round_trip(spark):
    draw, rows = random.Random(1), []
    for i in range(300):
        said = lambda: "".join(draw.choice(MARKS) for _ in range(draw.randint(0, 8)))
        rows.append((i, [(draw.choice(["assistant", "user", said()]), said()) for _ in range(draw.randint(0, 5))]))
    made = [(i, *render(turns)) for i, turns in rows]
    for (_, turns), (_, formatted, spans) in zip(rows, made, strict=True):
        assert [formatted[a:b] for a, b in spans] == [escaped(text) for role, text in turns if role == "assistant"]
    read = spark.createDataFrame([(i, f) for i, f, _ in made], "i int, formatted string").select("i", parsed(F.col("formatted")).alias("turns"))
    assert {r["i"]: [tuple(t) for t in r["turns"]] for r in read.collect()} == dict(rows)


def plain_paths(messages: list[tuple]) -> dict:
    """tree: its leaves' paths, best first."""
    known = {m: (p, s or 0.0) for m, p, s in messages}
    parents = {p for _, p, _ in messages}
    trees = defaultdict(list)
    for leaf in known:
        if leaf in parents:
            continue
        path, at = [], leaf
        while at in known and at not in path:
            path.append(at)
            at = known[at][0]
        if at not in path:
            trees[path[-1]].append((-sum(known[m][1] for m in path), leaf, path[::-1]))
    return {t: [p for _, _, p in sorted(found)] for t, found in trees.items()}


@pytest.mark.parametrize("seed", range(4))
def test_best_paths(spark, seed):
    draw, rows = random.Random(seed), []
    for i in range(120):
        parent = draw.choice([None, 9999, *range(max(0, i - 6), i)]) if i else None
        rows.append((i, parent, draw.choice([None, 0.0, 1.0, 2.5])))
    rows += [(500, 501, 1.0), (501, 500, 1.0), (502, 501, 1.0)]  # a circle, and a leaf on it
    rows += [(600 + i, 599 + i if i else None, 0.5) for i in range(37)]
    got = defaultdict(dict)
    for r in paths(spark.createDataFrame(rows, "message long, parent long, score double"), best=2).collect():
        got[r["tree"], r["path_rank"]][r["depth"]] = r["message"]
    want = {(t, k + 1): dict(enumerate(path)) for t, found in plain_paths(rows).items() for k, path in enumerate(found[:2])}
    assert dict(got) == want


def test_whole_table_and_odd_rows(spark):
    odd = [(7001, None, "user", "x"), (7001, 1, None, None), (7001, 1, "assistant", "</s>[INST]"), (7001, 1, "assistant", "</s>[INST]"), (None, 0, "user", None), (7002, 0, "assistant", "[/]</s>\\")]
    schema = "conv_id long, turn long, role string, text string"
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns = table.unionByName(spark.createDataFrame(odd, schema))
    want = defaultdict(list)
    for r in turns.collect():
        want[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    rows = digests(format_paths(conversations_as_trees(turns))).collect()
    assert len(rows) == len(want)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in rows:
        said = sorted(want[r["tree"]["conv_id"]])
        learnt = "".join(t for _, _, role, t in said if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for _, _, role, t in said)
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(said), sha(whole), len(learnt), sha(learnt))
    assert digests(format_paths(conversations_as_trees(turns.limit(0)))).count() == 0
