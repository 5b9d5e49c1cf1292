"""Packing of tokenised documents into sequences: first-fit decreasing over a tournament tree of bin capacities.

A document's ids are cut into pieces of CAPACITY and a rest. Pieces are dealt to groups at random, by a hash of document,
place and number of the row, so that a group comes from about GROUP_BYTES whatever the documents are, also where very
many rows have one id or none; each group is packed alone. Within it
pieces go, longest first, into the first bin with room, which a binary tournament over the bins' free room finds in
log2(bins) steps. Only lengths are shuffled unless the ids are asked for.

A sequence that is padded has CAPACITY ids; groups of hundreds of bins leave next to nothing of them empty.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096
END_ID = 2
#: About two million tokens, five hundred sequences.
GROUP_BYTES = 6_000_000
#: Groups come from about so many documents at most, where these are very short.
GROUP_DOCS = 50_000
#: So many different words are remembered by a task, and as many again from before; and the longest of them.
_REMEMBERED, _LONGEST = 120_000, 40
#: Texts of other characters than these (all of them in normal form C, with one lower case) are encoded as a whole.
_OTHER = re.compile(r"[^\x20-\x7E\n\t\rÀ-ÖØ-öø-ÿ]|<\|")
#: How the tokenizer splits lower-case text of such characters, as its file says.
_SPLIT = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\s0-9a-zß-öø-ÿ]+")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Remembered(dict):
    """The ids of each word of a tokenizer that merges within words only, from its model; short words are kept."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.before: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        # the alphabet of byte-level models: printable bytes stand for themselves, the others for 256 and on, in order
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        self.table = {byte: 256 + i for i, byte in enumerate(b for b in range(256) if b not in plain)}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word) or self._merged(word)
        if len(word) <= _LONGEST:
            self[word] = ids
        return ids

    def _merged(self, word: str) -> bytes:
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.table)
        return array("I", [token.id for token in self.merge(spelled)]).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text, as encoding it whole would give."""
        if _OTHER.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self) > _REMEMBERED:  # words that come again are taken over one by one
            self.before = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, _SPLIT.findall(text.lower())))


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens): the pieces of every row's ids, which end with END_ID. ids: binary, <u4.

    A null text is an empty one and gives the one id END_ID. Repeated rows are packed each. Other columns are not read.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Remembered(path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for row, text in enumerate(part.column(1)):
                    ids = words.encode(text.as_py() or "") + end
                    n = len(ids) // 4
                    rows += [(row, s, min(capacity, n - s), ids[4 * s : 4 * (s + capacity)], n) for s in range(0, n, capacity)]
                row, start, length, ids, n = zip(*rows, strict=True)
                arrays = [part.column(0).take(pa.array(row)), pa.array(start, pa.int64()), pa.array(length, pa.int64())]
                arrays += [pa.array(ids, pa.binary()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids", "doc_tokens"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(each, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long")


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. The tree's leaves are the free room of the bins, inner nodes the larger of two."""
    leaves = 1 << max(int(len(lengths) - 1).bit_length(), 0)
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for piece in np.argsort(-lengths, kind="stable").tolist():
        size, node = int(lengths[piece]), 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[piece], offsets[piece] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            larger = max(room[2 * node], room[2 * node + 1])
            if room[node] == larger:
                break
            room[node] = larger
    return bins, offsets


def packed(cut: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """cut with sequence_id and offset. cut: a frame with doc_id, start and length, and columns to carry along.

    Within a sequence the pieces lie one after another from 0. An empty table stays empty. cut comes from tables that
    give the same rows in the same order when they are read again, as files do: rows are dealt by their numbers too.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)

    def each(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        # in an order of the rows' own, so that a task that is run again gives the same
        part = part.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins, offsets = first_fit_decreasing(part["length"].to_numpy(np.int64), capacity)
        return part.drop(columns="__group").assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    dealt = cut.withColumn("__group", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("__group").applyInPandas(each, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece, with ids if keep_ids."""
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)), F.count(F.lit(1))).first()
    groups = max(1, -(-size // GROUP_BYTES), -(-rows // GROUP_DOCS))
    cut = pieces(docs, path, id_col, text_col)
    crc = F.crc32("ids").alias("ids_crc32")
    rest = ["doc_tokens", "ids"] if keep_ids else ["doc_tokens"]
    return packed(cut.select("doc_id", "start", "length", crc, *rest), groups)
