"""SimHash near-duplicates through pivot distance tables.

Every text gets a 64-bit fingerprint. Fingerprints link at RADIUS or fewer differing bits, and a group is what links
lead to. Only different fingerprints are compared, so exact copies cost one row each and nothing more.

Candidates come from a table of Hamming distances to reference fingerprints, the pivots. One pivot is the origin; the
pivots of a family differ from it within one block of bits only, so their distances minus the origin's depend on that
block alone. Of SIX blocks at most RADIUS = 3 can hold a difference, so two linked fingerprints have equal coordinates
in at least three families: the twenty choices of three families are the cells in which pairs meet. Within a cell pairs
are discarded by the maximum difference of the remaining coordinates (by the triangle inequality no coordinate of
linked fingerprints differs by more than RADIUS), and what survives is verified bit by bit.

A cell of many near copies would still give the square of its size. Each cell therefore chooses four of its own
fingerprints as local pivots; members within RADIUS of one are linked to it, and a pair that shares such a pivot is
connected already and is not made. What is left of a cell meets in a shuffled join that Spark can split.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.llm.common import broadcast_up_to, components, fresh, settled

RADIUS = 3
SIX = 6
SEED = 42
#: Up to so many rows that go are broadcast to the texts; beyond, the texts are shuffled.
MOST_BROADCAST = 100_000
_CHUNK = 1 << 16

_draw = random.Random(2024)
_EDGES = [round(64 * i / SIX) for i in range(SIX + 1)]
#: Masks that make the pivots of each family from the origin: random halves of the family's block.
FAMILIES = [
    [sum(1 << b for b in _draw.sample(range(low, high), (high - low) // 2)) for _ in range(6)]
    for low, high in zip(_EDGES, _EDGES[1:], strict=False)
]
ORIGIN = _draw.getrandbits(64)
#: Pivots anywhere, for the test of the maximum coordinate difference.
WIDE = [_draw.getrandbits(64) for _ in range(8)]


def fingerprint(text: str | None) -> int:
    """Bit by bit, whether more than half of the text's 3-word shingles have it set in their XXH64. No word: zero."""
    words = (text or "").encode().lower().split()  # lower() and split() of bytes touch A-Z and ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < 4:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-3])).tolist()
    stops = (ends[2:] - 1).tolist()
    digest, ones, n = xxhash.xxh64_digest, np.zeros(64, np.int64), len(stops)
    for at in range(0, n, _CHUNK):
        part = slice(at, at + _CHUNK)
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[part], stops[part], strict=True)])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with fp as a signed long, a row for each row of docs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks)], names=["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(each, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, fp long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(pivot))))


def _packed(parts: list[Column], bits: int) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(p.cast("long"), bits * i) for i, p in enumerate(parts)))


def pivot_table(distinct: DataFrame) -> DataFrame:
    """distinct (fp) with its coordinates: a signature per family, and the packed distances to the wide pivots."""
    fp = F.col("fp")
    origin = _distance(fp, ORIGIN)
    families = [_packed([_distance(fp, ORIGIN ^ m) - origin + 16 for m in masks], 6) for masks in FAMILIES]
    wide = _packed([_distance(fp, p) for p in WIDE], 7)
    return distinct.select("fp", wide.alias("wide"), *(s.alias(f"family{i}") for i, s in enumerate(families)))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): fingerprints of distinct (fp) that differ by RADIUS bits or fewer, enough of them to connect all such."""
    cells = [
        F.xxhash64(F.lit(i), *(F.col(f"family{j}") for j in chosen))
        for i, chosen in enumerate(combinations(range(SIX), SIX - RADIUS))
    ]
    members = pivot_table(distinct).select("fp", "wide", F.explode(F.array(*cells)).alias("cell"))
    shuffled = F.xxhash64("fp")
    local = members.groupBy("cell").agg(
        F.min("fp").alias("p0"),
        F.max("fp").alias("p1"),
        F.min_by("fp", shuffled).alias("p2"),
        F.max_by("fp", shuffled).alias("p3"),
    )
    pivots = [F.col(f"p{i}") for i in range(4)]
    near = [F.bit_count(F.col("fp").bitwiseXOR(p)) <= RADIUS for p in pivots]
    anchors = reduce(lambda a, b: a + b, (F.when(n, 1 << i).otherwise(0) for i, n in enumerate(near)))
    # Cells of one fingerprint end here: both ends of p0 and p1 are that one.
    crowd = members.join(local.where("p0 <> p1"), "cell").withColumn("anchors", anchors)
    crowd = settled(crowd.select("cell", "fp", "wide", "anchors", *pivots))
    stars = crowd.where("anchors <> 0").select(
        F.col("fp").alias("a"), F.explode(F.array(*(F.when(n, p) for n, p in zip(near, pivots, strict=True)))).alias("b")
    )
    stars = stars.where("b IS NOT NULL AND a <> b")
    one, two = (crowd.select("cell", *(F.col(c).alias(f"{c}_{s}") for c in ("fp", "wide", "anchors"))) for s in "ab")
    apart = [
        F.abs(_unpacked("wide_a", i) - _unpacked("wide_b", i)) <= RADIUS for i in range(len(WIDE))
    ]
    pairs = one.join(
        two,
        (one["cell"] == two["cell"])
        & (F.col("fp_a") < F.col("fp_b"))
        & (F.col("anchors_a").bitwiseAND(F.col("anchors_b")) == 0)
        & reduce(lambda a, b: a & b, apart)
        & (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= RADIUS),
    ).select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
    return stars.unionByName(pairs).distinct()


def _unpacked(name: str, place: int) -> Column:
    return F.shiftright(name, 7 * place).bitwiseAND(F.lit(127))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): for every row of docs its fingerprint and the smallest doc_id of its group.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows get a row each. A null doc_id
    takes part, but is the smallest of a group only where the group has no other. Other columns are not read, and an
    empty table gives an empty result.
    """
    marked = settled(fingerprints(docs, id_col, text_col))
    distinct = settled(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    grouped = components(links(distinct.select("fp")))
    rooted = distinct.join(grouped.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = settled(rooted.withColumn("component", F.coalesce("component", "fp")))
    least = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "component").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near copies, all columns as they are.

    Of each group the rows stay that have its smallest doc_id and, of texts with that id, the smallest hash: repeated rows of
    one document stay together. Null ids come after all others. Rows are told by id and text, so a row that only shares its
    id with one that goes is not touched.
    """
    told = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    told = told.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark")).alias("doc_id"), "text")
    gone = near_duplicates(told).where("doc_id <> component_id").select("doc_id").distinct()
    id_name, mark = fresh(docs.columns, "id", "mark")
    gone = gone.select(F.col("doc_id.id").alias(id_name), F.col("doc_id.mark").alias(mark))
    gone = broadcast_up_to(settled(gone), MOST_BROADCAST)
    same = F.col(id_col).eqNullSafe(F.col(id_name)) & (F.xxhash64(F.col(text_col)) == F.col(mark))
    return docs.join(gone, same, "left_anti")
