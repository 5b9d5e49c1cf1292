"""Byte-level BPE encoding and decoding, long texts by overlapping chunks.

A pattern splits a text, from left to right, into pre-tokens that are encoded one by one. Texts of up to CHUNK characters
are split and encoded as they are. Longer ones are cut into windows that overlap by OVERLAP, and every window is
pre-tokenised from its own start, in parallel. Where two neighbours share a boundary in their overlap they have
resynchronised: a match depends on its start and what follows alone, so from there on both go on alike. By induction from
the first window, everything from the first shared boundary on is as in a scan of the whole text. Windows that share none
(one pre-token fills the overlap) are joined and scanned again until all do. The pieces between shared boundaries are
encoded in parallel, and a text's ids are put together in their order.

Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covenant.llm.common import settled

#: Characters of a window without its overlap, and of the overlap.
CHUNK, OVERLAP = 32_768, 1_024
#: A match never looks further than this beyond its end: past white space at the next character, past ' at two.
_AHEAD = 3
#: Pre-tokens of more characters are merged by a heap here; the library's own merge is quick for short ones.
_SHORT = 2_000
#: So many different pre-tokens are remembered by a task, and as many again from before; and the longest of them.
_REMEMBERED, _LONGEST = 150_000, 40
#: Rows of a batch that leave a task together.
_ROWS = 256

_IDS = T.ArrayType(T.IntegerType())


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank of each token, from lines of a token in base64 and its rank. Read on the driver, sent along with the tasks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the pair of the lowest rank is merged first, the leftmost of equal ones."""
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(at: int) -> None:
        if at >= 0 and after[at] < n and (rank := ranks.get(piece[at : end[after[at]]])) is not None:
            heapq.heappush(heap, (rank, at, end[after[at]]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, at, to = heapq.heappop(heap)
        if not alive[at] or after[at] >= n or end[after[at]] != to:
            continue  # one of the two has been merged meanwhile
        gone = after[at]
        alive[gone], end[at], after[at] = False, to, after[gone]
        if after[at] < n:
            before[after[at]] = at
        offer(at)
        offer(before[at])
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Encoder(dict):
    """The ids of pre-tokens as bytes of 32-bit numbers; short pre-tokens are remembered in two generations."""

    def __init__(self, ranks: dict[bytes, int], pat: str) -> None:
        import regex
        import tiktoken

        self.ranks, self.split = ranks, regex.compile(pat)
        self.short = tiktoken.Encoding("ranks", pat_str=pat, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.before: dict[str, bytes] = {}

    def __missing__(self, token: str) -> bytes:
        ids = self.before.get(token)
        if ids is None:
            found = self.short(token) if len(token) <= _SHORT else merged(token.encode(), self.ranks)
            ids = array("i", found).tobytes()
        if len(token) <= _LONGEST:
            self[token] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if len(self) > _REMEMBERED:
            self.before = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, self.split.findall(text)))

    def boundaries(self, text: str, whole: bool) -> np.ndarray:
        """Ends of pre-tokens after which a text can be cut, found by a scan from its start. whole: nothing follows it.

        Left out are ends that what follows could change, and ends after white space: a piece that ends there would be
        split otherwise when it stands alone.
        """
        sure = len(text) if whole else len(text) - _AHEAD
        ends = (m.end() for m in self.split.finditer(text))
        return np.fromiter((e for e in ends if e <= sure and not text[e - 1].isspace()), np.int64)


def _lists(parts: list[bytes]) -> pa.Array:
    """Arrays of ids out of their bytes."""
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pat: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """(doc_id, ids) for every row, repeated rows each: ids as an array of int, without special tokens.

    A null text is an empty one and has no ids. Other columns are not read. A row's ids must fit in a task, as its text does.
    """
    if not _AHEAD < overlap < chunk:
        raise ValueError("the overlap must be shorter than a chunk")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long = F.length("text") > chunk
    key = F.sha2("text", 256)
    texts = rows.where(long).select(key.alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    joined = _encoded_texts(texts, ranks, pat, chunk, overlap)
    apart = rows.where(long).select("doc_id", key.alias("key")).join(joined, "key").select("doc_id", "ids")
    return _encoded(rows.where(~long), ranks, pat).unionByName(apart)


def _encoded(rows: DataFrame, ranks: dict[bytes, int], pat: str) -> DataFrame:
    """The rows with ids in place of their last column, the text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks, pat)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                ids = _lists([encoder.encode(text.as_py()) for text in part.columns[-1]])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names=[*part.schema.names[:-1], "ids"])

    return rows.mapInArrow(each, T.StructType([*rows.schema.fields[:-1], T.StructField("ids", _IDS)]))


def _encoded_texts(texts: DataFrame, ranks: dict[bytes, int], pat: str, chunk: int, overlap: int) -> DataFrame:
    """(key, ids) of long texts (key, text) with different keys."""
    windows = settled(_windows(texts, chunk, overlap).repartition("key", "at"))
    order = Window.partitionBy("key").orderBy("at")
    while True:
        shared = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
        begins = F.when(F.col("at") == 0, F.lit(0).cast("long")).otherwise(shared)
        marks = settled(_scanned(windows, ranks, pat, overlap).withColumn("begins", begins).select("key", "at", "begins"))
        if marks.where("begins is null").isEmpty():
            break
        run = F.count("begins").over(order)  # a window that does not begin belongs to the one before it
        parts = windows.join(marks.withColumn("run", run).select("key", "at", "run"), ["key", "at"])
        together = F.sort_array(F.collect_list(F.struct("at", "size", "text")))
        grouped = parts.groupBy("key", "run").agg(together.alias("p"), F.sum("size").alias("size"), F.max("last").alias("last"))
        bodies = F.transform("p", lambda p, i: F.when(i < F.size("p") - 1, F.substr(p["text"], F.lit(1), p["size"].cast("int"))).otherwise(p["text"]))
        windows = settled(grouped.select("key", F.col("p")[0]["at"].alias("at"), "size", "last", F.array_join(bodies, "").alias("text")))
    spans = marks.withColumn("ends", F.lead("begins").over(order))
    ends = F.coalesce(F.col("ends") - F.col("at"), F.length("text"))
    first = F.col("begins") - F.col("at")
    piece = F.substr("text", (first + 1).cast("int"), (ends - first).cast("int"))
    pieces = windows.join(spans, ["key", "at"]).select("key", "at", piece.alias("text"))
    in_order = F.sort_array(F.collect_list(F.struct("at", "ids")))
    whole = _encoded(pieces, ranks, pat).groupBy("key").agg(in_order.alias("p"))
    return whole.select("key", F.flatten(F.transform("p", lambda p: p["ids"])).alias("ids"))


def _windows(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(key, at, size, last, text): windows of chunk characters and the overlap, whose text ends with the text if last."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(*batch.columns, strict=True):
                whole = text.as_py()
                for at in range(0, len(whole), chunk):
                    cut = whole[at : at + chunk + overlap]
                    size, last = len(whole[at : at + chunk]), at + chunk >= len(whole)
                    yield pa.RecordBatch.from_pydict({"key": [key.as_py()], "at": [at], "size": [size], "last": [last], "text": [cut]})

    return texts.select("key", "text").mapInArrow(each, "key string, at long, size long, last boolean, text string")


def _scanned(windows: DataFrame, ranks: dict[bytes, int], pat: str, overlap: int) -> DataFrame:
    """(key, at, head, tail): sure boundaries in the overlap at a window's start and in the one beyond its size."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks, pat)
        for batch in batches:
            for row in range(batch.num_rows):
                key, at, size, last, text = (column[row].as_py() for column in batch.columns)
                found = encoder.boundaries(text, last)
                head = at + found[found <= overlap]
                tail = at + found[(found > size) & (not last)]
                arrays = {"key": [key], "at": [at], "head": [head.tolist()], "tail": [tail.tolist()]}
                schema = pa.schema({"key": pa.string(), "at": pa.int64(), "head": pa.list_(pa.int64()), "tail": pa.list_(pa.int64())})
                yield pa.RecordBatch.from_pydict(arrays, schema=schema)

    columns = windows.select("key", "at", "size", "last", "text")
    return columns.mapInArrow(each, "key string, at long, head array<long>, tail array<long>")


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """encoded with the bytes of its ids in the column into, in place of the ids; all other columns go along.

    Null ids give null bytes. An id outside the vocabulary is an error. A column that is called like into is replaced.
    """
    others = [c for c in encoded.columns if c not in (ids_col, into)]
    rows = encoded.select(*[F.col("`" + c.replace("`", "``") + "`") for c in [*others, ids_col]])
    plain = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])  # the call below takes dots for fields

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {rank: token for token, rank in ranks.items()}.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                texts = [None if ids is None else b"".join(map(of, ids)) for ids in _id_lists(part.columns[-1])]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.binary())], names=[*others, into])

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(into, T.BinaryType())])
    return plain.mapInArrow(each, schema)


def _id_lists(column: pa.ListArray) -> Iterator[list[int] | None]:
    for ids in column:
        yield ids.values.to_numpy(zero_copy_only=False).tolist() if ids.is_valid else None
