from __future__ import annotations

import random
from collections import Counter

from covenant.llm.repetition import LINE_LIMIT, NGRAM_LIMITS, keep_unrepetitive, measure, repetition
from tests.llm.cases import ODD, odd


def plain(text: str | None) -> tuple:
    import re

    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        mine = re.findall(r"[^\x20\x09-\x0D]+", line)
        if mine and line in lines:
            dup, dup_chars = dup + 1, dup_chars + sum(map(len, mine))
        lines.add(line)

    def inside(n: int) -> set[int]:
        windows = [tuple(found[i : i + n]) for i in range(len(found) - n + 1)]
        count = Counter(windows)
        return {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(n)}

    chars = sum(map(len, found))
    coverage = [sum(len(found[i]) for i in inside(n)) / chars if chars else 0.0 for n in NGRAM_LIMITS]
    line_coverage = dup_chars / chars if chars else 0.0
    repeat = len(inside(3))
    failed = len(found) < 50 or 100 * repeat > 50 * len(found)
    kept = not failed and line_coverage <= LINE_LIMIT and all(c <= m for c, m in zip(coverage, NGRAM_LIMITS.values(), strict=True))
    return len(found), chars, sum(map(text.count, "#*$%&|<>")), dup, repeat, line_coverage, coverage, failed, kept


def test_measures():
    draw = random.Random(2)
    texts = [None, "", " ", "a", "a a a a", *(t for _, t, _ in ODD if len(t or "") < 1000)]
    for size in (2, 5, 30, 400):
        voc = ["é", "a", "bb", "#x", "c%", "\U0001f600"] + [f"w{i}" for i in range(size)]
        texts += ["".join(draw.choice(voc) + draw.choice((" ", " ", " ", "\n", "\t", "\x1f")) for _ in range(draw.randint(1, 300))) for _ in range(20)]
    for text in texts:
        assert measure(text) == plain(text)


def test_clean_documents_stay_and_junk_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = repetition(docs).join(docs.select("doc_id", "quality"), "doc_id").collect()
    assert all(r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"])
    assert sum(not r["kept"] for r in rows) > 20


def test_odd_rows(spark):
    docs = odd(spark)
    rows = repetition(docs).collect()
    assert len(rows) == len(ODD)
    assert sorted(tuple(r)[1:] for r in rows) == sorted((lambda m: (*m[:6], list(m[6]), *m[7:]))(plain(t)) for _, t, _ in ODD)
    kept = keep_unrepetitive(docs)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [4]
    assert repetition(docs.limit(0)).count() == 0 and keep_unrepetitive(docs.limit(0)).count() == 0


def test_long_repeats_below_the_base_rule_go():
    """45 % of a text's characters in repeated 10-grams, no line twice."""
    passage = " ".join(f"p{i:03d}" for i in range(45))
    text = f"{passage} " + " ".join(f"u{i:03d}" for i in range(110)) + f" {passage}"
    values = measure(text)
    assert 0.44 < values[6][-1] < 0.46 and values[5] == 0 and not values[7] and not values[8]
