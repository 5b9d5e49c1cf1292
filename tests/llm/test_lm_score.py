from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from covenant.llm import lm_score as lm
from tests.llm.cases import ODD, odd

OWN = 1000


def test_gradient_step_learns_and_scores_agree():
    draw = np.random.default_rng(0)
    flat = lm.start(OWN)
    model, squares = lm._shaped(flat, OWN), lm._shaped(np.full(len(flat), 1e-3, np.float32), OWN)
    windows = draw.integers(0, OWN, (2 * lm.REACH, 400))
    targets = (windows[1] * 7 + 3) % OWN
    first = lm.log_chances(model, windows, targets).mean()
    scores = [lm.step(model, squares, windows, targets) for _ in range(150)]
    assert abs(scores[0] - first) < 1e-3 and scores[-1] > scores[0] + 1


def test_chances_add_up_to_one():
    model = lm._shaped(lm.start(OWN) * 5, OWN)
    numbers = len(model["classes"][0]) ** 2
    windows = np.random.default_rng(1).integers(0, OWN + lm.BUCKETS + 1, (2 * lm.REACH, 3))
    total = sum(np.exp(lm.log_chances(model, windows, np.full(3, w))) for w in range(numbers))
    assert OWN < numbers and np.allclose(total, 1, atol=1e-4)


def plain(texts: list[str], known: lm.Vocabulary, flat: np.ndarray) -> list[float]:
    """The scores from their definition, word by word."""
    own, letters = known.own, known.letters.reshape(-1, 256)
    model = lm._shaped(flat.astype(np.float64), len(own))
    of, out = {w: i for i, w in enumerate(own)}, []
    side, none = len(model["words"]), len(own) + lm.BUCKETS
    for text in texts:
        words = text.encode().lower().split()
        numbers = [of.get(w, len(own) + lm.zlib.crc32(w) % lm.BUCKETS) for w in words]
        total = 0.0
        for i, word in enumerate(words):
            hidden = model["bias"].copy()
            for k, o in enumerate((-2, -1, 1, 2)):
                number = numbers[i + o] if 0 <= i + o < len(words) else none
                hidden += model["embedding"][number] @ model["places"][k]
            hidden = np.tanh(hidden)
            target = min(numbers[i], len(own))
            kinds = hidden @ model["classes"] + model["class_bias"]
            inside = hidden @ model["words"][target % side] + model["word_bias"][target % side]
            total += kinds[target % side] - math.log(np.exp(kinds).sum()) + inside[target // side] - math.log(np.exp(inside).sum())
            if word in known.shares:
                total += known.shares[word]
            elif word not in of:
                total += known.rest + sum(letters[c, b] for c, b in spelled(word))
        out.append(total)
    return out


def spelled(word: bytes) -> list[tuple[int, int]]:
    """The bytes of a word and its end, each with its context."""
    out, last, earlier = [], 32, 32
    for byte in word + b" ":
        out.append((((earlier * 40_503 >> 3) % (lm.CONTEXTS >> 8)) << 8 | last, byte))
        last, earlier = byte, last if last != 32 else 32
    return out


def test_whole_table_from_the_definition(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    pieces, known, flat = lm.fitted(docs)
    got = {r["doc_id"]: r["log_likelihood"] for r in lm.scored(pieces, len(known.own), flat).collect()}
    counts = Counter(w for t in texts.values() for w in t.encode().lower().split())
    total = sum(counts.values())
    enough, some = lm.least(total), lm.listed(total)
    assert known.own == sorted((w for w, n in counts.items() if n >= enough), key=lambda w: (-counts[w], w))
    others = sum(n for n in counts.values() if n < enough)
    shares = {w: math.log(n / others) for w, n in counts.items() if some <= n < enough}
    assert known.shares.keys() == shares.keys() and all(math.isclose(known.shares[w], x) for w, x in shares.items())
    want = plain(list(texts.values()), known, flat)
    assert got.keys() == texts.keys()
    assert np.allclose([got[d] for d in texts], want, rtol=1e-4, atol=1e-2)


def test_word_order_counts_in_held_out_texts(spark):
    """A language in which each word tells the next: true texts score above their shuffled words."""
    draw = random.Random(8)

    def text() -> list[str]:
        at, out = draw.randrange(60), []
        for _ in range(60):
            out.append(f"w{at}")
            at = (at * 7 + draw.choice((1, 2))) % 60
        return out

    train = [(i, " ".join(text())) for i in range(1500)]
    held = [text() for _ in range(100)]
    mixed = [draw.sample(words, len(words)) for words in held]
    rows = train + [(2000 + i, " ".join(w)) for i, w in enumerate(held)] + [(3000 + i, " ".join(w)) for i, w in enumerate(mixed)]
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert sum(got[2000 + i] > got[3000 + i] for i in range(100)) > 90


def test_counts_cover_all_documents(spark):
    docs = spark.createDataFrame([("a B b",), ("b c",), (None,)], "text string").repartition(2)
    assert {bytes(r["word"]): r["n"] for r in lm.word_counts(docs).collect()} == {b"a": 1, b"b": 3, b"c": 1}


def test_odd_rows(spark):
    rows = lm.score(odd(spark)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert (r["mean_log_likelihood"] is None) == (r["n_words"] == 0)
        assert r["log_likelihood"] < 0 or r["n_words"] == 0
    assert lm.score(odd(spark).limit(0)).count() == 0


def test_letters_come_from_the_words_that_are_not_listed(monkeypatch, spark):
    monkeypatch.setattr(lm, "least", lambda total: 100)
    monkeypatch.setattr(lm, "listed", lambda total: 3)
    draw = random.Random(3)
    words = ["".join(draw.choice("abcé") for _ in range(draw.randint(1, 4))) for _ in range(400)]
    docs = spark.createDataFrame([(" ".join(words[i::7]),) for i in range(7)], "text string")
    known = lm.vocabulary(lm.word_counts(docs), len(words))
    counts = Counter(w.encode() for w in words)
    rest = {w: n for w, n in counts.items() if n < 3}
    pairs, after = np.ones((256, 256)), np.zeros((lm.CONTEXTS, 256))
    for word, n in rest.items():
        for (context, byte), last in zip(spelled(word), b" " + word, strict=True):
            after[context, byte] += n
            pairs[last, byte] += n
    pairs /= pairs.sum(axis=1, keepdims=True)
    after += lm.PRIOR * pairs[np.arange(lm.CONTEXTS) % 256]
    assert np.allclose(known.letters.reshape(-1, 256), np.log(after / after.sum(axis=1, keepdims=True)), atol=1e-5)
    assert math.isclose(known.rest, math.log(sum(rest.values()) / len(words)))
    assert math.isclose(sum(math.exp(x) for x in known.shares.values()) + math.exp(known.rest), 1)


def test_words_without_a_number_differ_by_their_letters(spark):
    base = [f"c{i}" for i in range(40)] * 20_000
    seldom = [f"same{i}ending" for i in range(300)]
    rows = [(0, " ".join(base)), (1, "c1 c2 same999ending c3"), (2, "c1 c2 xqzvjkwxq c3"), (3, " ".join(seldom))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, known, _ = lm.fitted(docs)
    assert len(known.own) == 40
    got = {r["doc_id"]: r["log_likelihood"] for r in lm.score(docs).collect()}
    assert got[1] > got[2] + 5


def test_the_vocabulary_grows_with_the_documents(spark):
    draw = np.random.default_rng(4)
    sizes = []
    for n in (20_000, 400_000):
        words = draw.zipf(1.3, n)
        docs = spark.createDataFrame([(" ".join(f"w{w}" for w in part),) for part in np.array_split(words, 50)], "text string")
        own = lm.vocabulary(lm.word_counts(docs), n).own
        often = [f"w{w}".encode() for w, c in Counter(words.tolist()).items() if c >= lm.least(n)]
        assert sorted(own) == sorted(often) and len(own) <= n / lm.least(n)
        sizes.append(len(own))
    assert sizes[1] > sizes[0]


@pytest.mark.parametrize("total", [0, 10**5, 10**8, 3 * 10**13])
def test_what_reaches_the_driver_grows_with_the_cube_root(total):
    assert total // lm.least(total) <= max(total, 1) ** (1 / 3) * 65 + 4096
    assert lm.BATCHES[0] <= lm.batch_size(total) <= lm.BATCHES[1]


def test_training_does_not_depend_on_how_rows_are_split(spark):
    draw = random.Random(9)
    rows = []
    for i in range(1200):
        at, words = draw.randrange(60), []
        for _ in range(50):
            words.append(f"w{at}")
            at = (at * 7 + draw.choice((1, 2))) % 60
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few, many = (lm.score(docs.repartition(n)).agg(F.avg("mean_log_likelihood")).first()[0] for n in (1, 48))
    assert abs(few - many) < 0.1 and min(few, many) > -3.9  # by chance: log(1 / 60) = -4.1
