from __future__ import annotations

import random

import pytest
import tiktoken

from covenant.llm.byte_bpe import Encoder, decode, encode, merged, pattern, read_ranks, vocabulary
from covenant.llm.queries import op11_byte_bpe
from tests.llm.cases import ODD, odd

PARTS = ["it's", "'ll", "'l", "'", "DON'T", " ", "  ", "\n", " \n ", "\t", "x1y22", "é", "日本", "\x1c", " ", "!?", "\U0001f600", "½", "a" * 90]


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(vocabulary())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("test", pat_str=pattern(), mergeable_ranks=ranks, special_tokens={})


def texts(seed: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice([*PARTS, "word", " Unter"]) for _ in range(draw.randint(0, 300))) for _ in range(60)]


def test_merging_by_heap(ranks, library):
    draw = random.Random(5)
    for _ in range(300):
        piece = "".join(draw.choice("abcé日 !t h e") for _ in range(draw.randint(1, 60))).encode()
        assert merged(piece, ranks) == library._encode_single_piece(piece)


def test_boundaries_do_not_depend_on_what_follows(ranks):
    encoder = Encoder(ranks, pattern())
    for text in texts(6):
        whole = encoder.boundaries(text, True).tolist()
        for cut in range(0, len(text), 7):
            found = encoder.boundaries(text[:cut], False).tolist()
            assert found == [b for b in whole if b <= (found[-1] if found else -1)]


@pytest.mark.parametrize(("chunk", "overlap"), [(20_000, 500), (40, 10), (9, 4)])
def test_chunks_encode_as_the_whole_text(spark, ranks, library, chunk, overlap):
    rows = list(enumerate([*texts(chunk), "", " " * 700 + "x", "a" * 1000, "'l" * 300, "copy " * 50, "copy " * 50]))
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in encode(docs, ranks, pattern(), chunk=chunk, overlap=overlap).collect()}
    assert got == {i: library.encode_ordinary(t) for i, t in rows}


def test_whole_table(spark, library):
    import hashlib

    def sha(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for doc, text in docs:
        ids = library.encode_ordinary(text or "")
        want[doc] = (len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode()))
    rows = op11_byte_bpe(spark, "/root/testdata/sf0.01").collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows} == want
    assert len(rows) == len(docs)


def test_odd_rows(spark, ranks, library):
    docs = odd(spark)
    ids = encode(docs, ranks, pattern())
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in ids.collect()) == sorted((d or 0, library.encode_ordinary(t or "")) for d, t, _ in ODD)
    back = decode(ids.selectExpr("doc_id", "ids", "'x' as decoded", "'y' as `a.b`"), ranks).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"]).decode(), r["a.b"]) for r in back) == sorted((d or 0, t or "", "y") for d, t, _ in ODD)
    none = encode(docs.limit(0), ranks, pattern())
    assert none.count() == 0 and decode(none, ranks).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert decode(nothing, ranks).first()["decoded"] is None


def test_an_overlap_shorter_than_the_look_ahead_is_refused(spark, ranks):
    with pytest.raises(ValueError):
        encode(odd(spark), ranks, pattern(), chunk=10, overlap=2)
