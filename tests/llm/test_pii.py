from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np

from covenant.llm.crf import Chain, Sequences, margin, viterbi
from covenant.llm.pii import _TRIM, BASE, KINDS, added_spans, base_spans, find_personal_data, trained
from covenant.llm.pii_lines import labelled_lines
from tests.llm.cases import ODD, odd


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's patterns as they stand."""

    def luhn(digits: str) -> bool:
        values = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return sum(v - 9 if v > 9 else v for v in values) % 10 == 0

    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    digits = lambda s: "".join(re.findall("[0-9]", s))
    good = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s)),
        "phone": lambda s: 8 <= len(digits(s)) <= 15,
    }
    return [(k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, text) if good[k](m[0])]


def test_base_spans():
    draw = random.Random(6)
    parts = ["a@b.c", "@", "a.b-c@x.y.z", "@x.y", ".", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.04", "4111 1111 1111 1111", "4111111111111111", "-", "+", "+1 (555) 123-4567", "+49", "9" * 21, "x", "é", "\U0001f600", "+12345678)", "%", "(2)", "0.0.0.0"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) + draw.choice(("", "", " ", "\n", ".")) for _ in range(draw.randint(1, 12)))
        assert base_spans(text) == plain_spans(text), text


def test_base_spans_are_linear():
    for text in ("a" * 300_000 + " x@y.z", "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000):
        base_spans(text)


def test_viterbi_is_the_best_path():
    draw = np.random.default_rng(1)
    chain = Chain(*(draw.normal(size=s).astype(np.float32) for s in ((1, 3), (1, 3), (1, 3), (3, 3), (3,))))
    lengths = np.array([1, 4, 2, 6, 3, 1])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    scores = draw.normal(size=(lengths.sum(), 3)).astype(np.float32)
    states = viterbi(scores, chain, Sequences.of(starts, lengths))

    def value(path, at):
        steps = sum(chain.steps[a, b] for a, b in itertools.pairwise(path))
        return chain.first[path[0]] + steps + sum(scores[at + i, s] for i, s in enumerate(path))

    for at, n in zip(starts, lengths, strict=True):
        best = max(itertools.product(range(3), repeat=int(n)), key=lambda p: value(p, at))
        assert tuple(states[at : at + n]) == best
        if (scores[at : at + n, 0] - scores[at : at + n, 1:].max(axis=1) > margin(chain)).all():
            assert set(best) == {0}


def test_held_out_lines():
    chain, right, wrong, missed = trained(), 0, 0, 0
    lines = labelled_lines(600, seed=99)
    for (text, spans), got in zip(lines, added_spans([t for t, _ in lines], chain), strict=True):
        want = {(k, a + len(text[a:b]) - len(text[a:b].lstrip(_TRIM)), b) for k, a, b in spans}
        right, wrong, missed = right + len(want & set(got)), wrong + len(set(got) - want), missed + len(want - set(got))
    assert right / (right + wrong) > 0.93 and right / (right + missed) > 0.93


def test_texts_in_a_batch_do_not_touch():
    texts = ["", "mail a.b@c.de", 'token = "' + "a1" * 20 + '"', "\n\n", "plain words only", "1.2.3.4"]
    alone = [added_spans([t], trained())[0] for t in texts]
    assert added_spans(texts, trained()) == alone
    assert alone[2] == [("secret", 9, 49)] and alone[4] == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = find_personal_data(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_spans(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [r[f"n_{k}"] for k in BASE] == [sum(kind == k for kind, _, _ in base) for k in BASE]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        spans = [tuple(s.split(":")) for s in r["spans"].split(",") if s]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(",")) | {""}
        assert spans == sorted(spans, key=lambda s: (KINDS.index(s[0]), int(s[1])))


def test_odd_rows(spark):
    docs = odd(spark)
    assert len(find_personal_data(docs).collect()) == len(ODD)
    assert find_personal_data(docs.limit(0)).count() == 0
