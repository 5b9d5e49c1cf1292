"""Compression of vectors into codes of 16 parts: codebooks by rounds of means over anchors-hierarchy metric trees.

Components become integers, floor(256 x), and vectors are cut into PARTS equal parts. The codebook of a part position
starts as that part of the vectors of the ENTRIES smallest ids; each round gives every part to the nearest entry (squared
Euclidean distance, ties to the lower index) and moves an entry to the floored mean of its parts. Entries without parts
stay where they are.

Vectors are dealt to blocks. For every block and part position a metric tree is built once, middle-out: about sqrt(n)
anchors are chosen one after another, each the point farthest from its anchor so far, and steal the points that lie nearer
to them; the anchors are joined pairwise, those of the smallest common ball first, up to the root, and split further in
the same way down to leaves. A ball keeps its centre, its radius, and the sum and count of its parts. A round goes down
the trees level by level with lists of candidate entries: a ball inherits its parent's list and strikes out every entry
whose bisector with the entry nearest to the centre leaves the whole ball on the other side. A ball left with one entry is
wholly owned, and its cached sum and count go to that entry at once. Only the points of leaves with several candidates are
compared with these, in exact integers.

The trees lie in the shared folder (a checkpoint), where all rounds read them. A round sends sums to the driver that are as
large as the codebooks, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.llm.common import broadcast_up_to, settled

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block; points of a leaf at most, unless they are all the same.
BLOCK, LEAF = 4_096, 24
#: What rounding may add to a distance in floating point, as a share of the distances compared.
_SLACK = 1e-9


@dataclass
class Forest:
    """The metric trees of the part positions of one block, their balls numbered together, parents before children.

    points: (vector, position, component). order: by position, the points so that each ball holds a run of them, from first
    to last. parent: -1 for roots. total: the sum of a ball's points; their count is last - first.
    """

    points: np.ndarray
    order: np.ndarray
    tree: np.ndarray
    parent: np.ndarray
    level: np.ndarray
    leaf: np.ndarray
    first: np.ndarray
    last: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    total: np.ndarray

    def runs(self, balls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The balls, each repeated for its points, and these points."""
        count = self.last[balls] - self.first[balls]
        each = np.repeat(balls, count)
        place = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + self.first[each]
        return each, self.order[self.tree[each], place]


def grow(points: np.ndarray) -> Forest:
    """The forest over integer points (vector, position, component)."""
    orders, balls = [], []
    for tree in range(points.shape[1]):
        own: list[np.ndarray] = []
        part = points[:, tree].astype(np.float64)
        _number(_middle_out(part, np.arange(len(part))), tree, -1, 0, 0, balls, own)
        orders.append(np.concatenate(own))
    tree, parent, level, leaf, first, last = (np.array(x) for x in zip(*balls, strict=True))
    inside = [points[orders[t][a:b], t] for t, a, b in zip(tree.tolist(), first.tolist(), last.tolist(), strict=True)]
    total = np.array([x.sum(axis=0) for x in inside])
    centre = total / (last - first)[:, None]
    radius = np.array([math.sqrt(((x - c) ** 2).sum(axis=1).max()) for x, c in zip(inside, centre, strict=True)])
    return Forest(points, np.array(orders), tree, parent, level, leaf, first, last, centre, radius, total)


def _middle_out(points: np.ndarray, places: np.ndarray) -> tuple:
    """A tree over the points at these places: (places,) for a leaf, else (left, right)."""
    mine = points[places]
    if len(places) <= LEAF or (mine == mine[0]).all():
        return (places,)
    anchor, away, pivots = np.zeros(len(places), np.int64), _distance(mine, mine[0]), [0]
    for k in range(1, math.isqrt(len(places)) + 1):
        pivot = int(away.argmax())
        if away[pivot] == 0:
            break
        # points that lie nearer to their anchor than half way to the new one cannot be stolen
        asked = np.flatnonzero(away * 2 >= _distance(mine[pivots], mine[pivot])[anchor])
        near = _distance(mine[asked], mine[pivot])
        stolen = near < away[asked]
        anchor[asked[stolen]], away[asked[stolen]] = k, near[stolen]
        pivots.append(pivot)
    groups = [g for g in (places[anchor == k] for k in range(len(pivots))) if len(g)]
    return _joined([_middle_out(points, g) for g in groups], [points[g] for g in groups])


def _distance(points: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - other) ** 2).sum(axis=-1))


def _joined(trees: list[tuple], members: list[np.ndarray]) -> tuple:
    """One tree out of several: the two with the smallest common ball become one, again and again."""
    centre = np.array([m.mean(axis=0) for m in members])
    radius = np.array([_distance(m, c).max() for m, c in zip(members, centre, strict=True)])
    count, gone = np.array([len(m) for m in members], np.float64), np.zeros(len(trees), bool)
    common = np.array([_common(centre, radius, i) for i in range(len(trees))])
    np.fill_diagonal(common, np.inf)
    top = 0
    for _ in range(len(trees) - 1):
        a, b = divmod(int(common.argmin()), len(trees))
        trees[a], radius[a] = (trees[a], trees[b]), common[a, b]
        centre[a] = (centre[a] * count[a] + centre[b] * count[b]) / (count[a] + count[b])
        count[a], gone[b], top = count[a] + count[b], True, a
        row = np.where(gone, np.inf, _common(centre, radius, a))
        row[a] = np.inf
        common[a] = common[:, a] = row
        common[b] = common[:, b] = np.inf
    return trees[top]


def _common(centre: np.ndarray, radius: np.ndarray, i: int) -> np.ndarray:
    """Radius of the smallest ball around ball i and each other one."""
    return np.maximum(np.maximum(radius, radius[i]), (_distance(centre, centre[i]) + radius + radius[i]) / 2)


def _number(node: tuple, tree: int, parent: int, level: int, first: int, balls: list, own: list[np.ndarray]) -> int:
    """Append the balls of a tree and its points in their order; where the run of points ends."""
    me, last = len(balls), first
    balls.append(())
    if len(node) == 1:
        own.append(node[0])
        last += len(node[0])
    else:
        for child in node:
            last = _number(child, tree, me, level + 1, last, balls, own)
    balls[me] = (tree, parent, level, len(node) == 1, first, last)
    return last


def owners(forest: Forest, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Balls that one entry owns wholly, with that entry; and (position, point, entry) for the points of all others.

    books: (position, entry, component), integers.
    """
    floats = books.astype(np.float64)
    apart = _distance(floats[:, :, None], floats[:, None])
    listed = np.ones((len(forest.tree), books.shape[1]), bool)
    decided = np.zeros(len(forest.tree), bool)
    owned, entries, open_leaves = [], [], []
    for level in range(forest.level.max() + 1):
        balls = np.flatnonzero(forest.level == level)
        if level:
            settled_above = decided[forest.parent[balls]]
            decided[balls[settled_above]] = True
            balls = balls[~settled_above]
            listed[balls] = listed[forest.parent[balls]]
        away = np.where(listed[balls], _distance(forest.centre[balls][:, None], floats[forest.tree[balls]]) ** 2, np.inf)
        first = away.argmin(axis=1)
        between = apart[forest.tree[balls], first]
        reach = away.min(axis=1)[:, None] + 2 * forest.radius[balls][:, None] * between
        listed[balls] &= away <= reach * (1 + _SLACK) + _SLACK
        one = listed[balls].sum(axis=1) == 1
        decided[balls[one]] = True
        owned.append(balls[one])
        entries.append(listed[balls[one]].argmax(axis=1))
        open_leaves.append(balls[~one & forest.leaf[balls]])
    each, point = forest.runs(np.concatenate(open_leaves))
    return np.concatenate(owned), np.concatenate(entries), _nearest(forest, books, listed, each, point)


def _nearest(forest: Forest, books: np.ndarray, listed: np.ndarray, ball: np.ndarray, point: np.ndarray) -> tuple:
    """(position, point, entry): the nearest listed entry, the lowest of equally near ones, in exact integers."""
    tree = forest.tree[ball]
    if not len(point):
        return tree, point, point
    row, entry = np.nonzero(listed[ball])
    away = ((forest.points[point[row], tree[row]] - books[tree[row], entry]) ** 2).sum(axis=1)
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(away, starts)
    hits = np.flatnonzero(away == least[row])
    firsts = hits[np.flatnonzero(np.diff(row[hits], prepend=-1))]
    return tree, point, entry[firsts]


def sums(forest: Forest, books: np.ndarray) -> np.ndarray:
    """(position, entry, component and then count): what the entries own."""
    out = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
    ball, owner, (tree, point, entry) = owners(forest, books)
    held = np.column_stack([forest.total[ball], forest.last[ball] - forest.first[ball]])
    np.add.at(out, (forest.tree[ball], owner), held)
    single = np.column_stack([forest.points[point, tree], np.ones(len(point), np.int64)])
    np.add.at(out, (tree, entry), single)
    return out


def codes(forest: Forest, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vector, position): the entry of each part, and its squared distance."""
    found = np.zeros(forest.points.shape[:2], np.int64)
    ball, owner, (tree, point, entry) = owners(forest, books)
    of = np.zeros(len(forest.tree), np.int64)
    of[ball] = owner
    each, inside = forest.runs(ball)
    found[inside, forest.tree[each]] = of[each]
    found[point, tree] = entry
    near = books[np.arange(books.shape[0])[None], found]
    return found, ((forest.points - near) ** 2).sum(axis=2)


@dataclass(frozen=True)
class Compressed:
    """codes: (vec_id, label, code, error), code an array of int; books: (position, entry, component), on the driver."""

    codes: DataFrame
    books: np.ndarray

    def books_sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> Compressed:
    """Codes and codebooks of a table of vectors (arrays of float or double).

    Rows without a vector, or with null or non-finite components, are dropped. So are vectors whose length is not that of the
    kept vector of the smallest id, or not a multiple of parts, and vectors with a component so large that squared distances
    may leave 64 bits (over 370,000 at 64 components). Null ids come after all others and equal ids are ordered by their
    vectors, when the first codebooks are taken; repeated rows are compressed each. With fewer vectors than entries the
    codebooks are shorter; with none the result is empty. Other columns are not read.
    """
    vector = F.col(vector_col).cast("array<double>").alias("vector")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), vector)
    # NaN counts as larger than any number, so a bound leaves it out as well
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = rows.where(F.col("vector").isNotNull() & finite & (F.size("vector") > 0) & (F.size("vector") % parts == 0))
    smallest = (F.col("vec_id").asc_nulls_last(), "vector")
    lead = rows.orderBy(*smallest).select(F.size("vector").alias("n")).first()
    size = lead["n"] if lead else parts
    most = math.isqrt(2**61 // size) // 2 // SCALE
    rows = rows.where((F.size("vector") == size) & F.forall("vector", lambda x: F.abs(x) < most))
    start = [r["vector"] for r in rows.orderBy(*smallest).limit(entries).select("vector").collect()]
    books = _scaled(np.array(start)).reshape(len(start), parts, size // parts).swapaxes(0, 1).copy()
    blocks = settled(_blocks(rows, parts))
    for _ in range(rounds if len(start) else 0):
        books = _moved(blocks, books)
    return Compressed(settled(_coded(blocks, books, rows)), books)


def _scaled(vectors: np.ndarray) -> np.ndarray:
    return np.floor(vectors * SCALE).astype(np.int64)


def _blocks(rows: DataFrame, parts: int) -> DataFrame:
    """(block): up to BLOCK vectors with their forest, ids and labels."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            while sum(b.num_rows for b in waiting) >= BLOCK:
                whole = pa.Table.from_batches(waiting)
                yield packed(whole.slice(0, BLOCK))
                waiting = whole.slice(BLOCK).to_batches()
        if sum(b.num_rows for b in waiting):
            yield packed(pa.Table.from_batches(waiting))

    def packed(part: pa.Table) -> pa.RecordBatch:
        vectors = np.array(part.column("vector").to_pylist())
        points = _scaled(vectors).reshape(len(vectors), parts, vectors.shape[1] // parts)
        data = pickle.dumps((vars(grow(points)), part.select(["vec_id", "label"]).combine_chunks()), protocol=5)
        return pa.RecordBatch.from_pydict({"block": pa.array([data], pa.binary())})

    return rows.mapInArrow(each, "block binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Forest, pa.Table]]:
    for batch in batches:
        for block in batch.column(0):
            arrays, names = pickle.loads(block.as_py())
            yield Forest(**arrays), names


def _moved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
        for forest, _ in _unpacked(batches):
            total += sums(forest, books)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"place": place, "held": total.ravel()[place]})

    held = blocks.mapInArrow(each, "place long, held long").groupBy("place").agg(F.sum("held").alias("held"))
    total = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
    for row in held.collect():  # as many as the codebooks have numbers, at most
        total.ravel()[row["place"]] = row["held"]
    count = total[..., -1:]
    return np.where(count > 0, total[..., :-1] // np.maximum(count, 1), books)


def _coded(blocks: DataFrame, books: np.ndarray, rows: DataFrame) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for forest, names in _unpacked(batches):
            code, error = codes(forest, books)
            for at in range(0, len(code), 1024):
                part = names.slice(at, 1024).combine_chunks()
                lists = pa.array(list(code[at : at + 1024].astype(np.int32)), pa.list_(pa.int32()))
                far = pa.array(error[at : at + 1024].sum(axis=1))
                columns = [part.column(0).combine_chunks(), part.column(1).combine_chunks(), lists, far]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    return blocks.mapInArrow(each, f"vec_id {kinds[0]}, label {kinds[1]}, code array<int>, error long")


def label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the sum of errors over equal labels, nulls together."""
    by = settled(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    return coded.join(broadcast_up_to(by, 100_000), F.col("label").eqNullSafe(F.col("of"))).drop("of")
