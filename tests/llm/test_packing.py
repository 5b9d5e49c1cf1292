from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from covenant.llm.packing import Remembered, first_fit_decreasing, pack_documents, packed, vocabulary
from tests.llm.cases import ODD, odd


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary())


def test_words_encode_as_the_whole_text(tokenizer):
    draw, words = random.Random(1), Remembered(vocabulary())
    parts = ["it's", "DON'T", "'S", "!'s", "x1y22", "ÉCOLE", "ß", "ÿ", "<|endoftext|>", "<|", "½", "é", "İ", "ΑΣ", "\x0b", " ", "日本", "##", "a" * 90, "'", "--", "_", "\U0001f600", "ﬁ"]
    texts = ["".join(draw.choice([*parts, "word", "Ünter"]) + draw.choice((" ", "\n", "", "  ", "\t")) for _ in range(30)) for _ in range(300)]
    for text in ["", " ", *parts, *texts]:
        assert words.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_first_fit_decreasing():
    draw = random.Random(3)
    for _ in range(60):
        capacity = draw.choice((10, 100))
        lengths = np.array([draw.randint(1, capacity) for _ in range(draw.randint(1, 80))])
        bins, room = {}, []
        for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            at = next((b for b, r in enumerate(room) if r >= lengths[piece]), len(room))
            room += [capacity] * (at == len(room))
            bins[piece] = (at, capacity - room[at])
            room[at] -= int(lengths[piece])
        got = first_fit_decreasing(lengths, capacity)
        assert list(zip(*(g.tolist() for g in got), strict=True)) == [bins[i] for i in range(len(lengths))]


def check(rows, texts, tokenizer):
    """Every id of every document lies in one piece, and sequences are gapless."""
    mine = defaultdict(list)
    for r in rows:
        mine[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    want = defaultdict(list)
    for doc, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        for s in range(0, len(ids), 4096):
            piece = ids[s : s + 4096]
            want[doc].append((s, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
    assert {d: sorted(p) for d, p in mine.items()} == {d: sorted(p) for d, p in want.items()}
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    return sum(r["length"] for r in rows) / (4096 * len(sequences))


def test_whole_table(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pack_documents(docs, vocabulary(), keep_ids=True).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert check(rows, texts, tokenizer) > 0.99
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)


def test_rows_of_one_id_are_dealt_to_all_groups(spark):
    """Null ids and one text on half the rows: no group takes them all."""
    same = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("start"))
    cut = same.unionByName(spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start")))
    rows = packed(cut.withColumn("length", F.lit(100).cast("long")), 8).collect()
    mine = Counter(r["sequence_id"] >> 32 for r in rows if r["doc_id"] is None)
    assert len(rows) == 4000 and len(mine) == 8 and max(mine.values()) < 400


def test_odd_rows(spark, tokenizer):
    docs = odd(spark)
    check(pack_documents(docs, vocabulary()).collect(), [(d, t) for d, t, _ in ODD], tokenizer)
    assert pack_documents(docs.limit(0), vocabulary()).count() == 0
