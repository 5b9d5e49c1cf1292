"""Benchmark decontamination with DataFrame functions only: SimHash of item-sized windows, verified exactly.

Words are what stands between blanks, in lower case. A document is contaminated by an item if one of its windows of as
many words as the item (the whole document, if it is shorter) has a weighted Jaccard similarity of SIMILARITY or more
to the item over five-word shingles, repeats counted; a text of fewer words is one shingle.

1. Anchors. Windows that share no shingle with any item have similarity zero, so windows are only laid where shingles of
   items occur. Each document's shingle hashes meet the items' distinct ones, broadcast if their count allows. Within a
   document, windows start at anchors, since moving a window right up to its first anchor loses no shared shingle, and
   only where they hold as many anchors as the similarity takes at least.
2. Fingerprints. Equal windows are one row from here on, so a passage in a third of all documents is one window. Its
   SimHash adds the bits of its shingle hashes in 22 sums, three counters of 21 bits each, and is compared with those of
   the items through a multi-index: the 64 bits are cut into RADIUS + 1 blocks, of which two fingerprints within RADIUS
   have at least one in common. The join on (size, block, value) thus meets every pair within the radius.
3. Verification. For each candidate the shingle texts are counted on both sides and compared exactly.

Over five-word shingles a similarity of 0.8 means about 0.15 of the bits differ, 9.6 +- 2.9 of 64. RADIUS = 20 is more
than three deviations away, and equal texts differ in no bit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.llm.common import BLANKS, broadcast_up_to, fresh, settled

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
#: Broadcast up to so many rows of 8 to 30 bytes; beyond, the join is a shuffle.
MOST_BROADCAST = 500_000

_LANES = 21
_MASK = 1 | 1 << _LANES | 1 << 2 * _LANES


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), f"{BLANKS}+"), lambda w: w != "")


def _starts(words: Column, gram: int = SHINGLE) -> Column:
    """The places where shingles start: one at least for any word, none without."""
    last = F.greatest(F.size(words) - gram, F.lit(0))
    return F.when(F.size(words) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _hashes(words: Column, gram: int = SHINGLE) -> Column:
    """A hash for each shingle of words; get() gives null beyond the end, which the hash skips."""
    return F.transform(_starts(words, gram), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(gram))))


def _texts(words: Column) -> Column:
    return F.transform(_starts(words), lambda i: F.array_join(F.slice(words, i + 1, SHINGLE), " "))


def _needed(size: Column, item: Column) -> Column:
    """Shingles that must be shared for the similarity: s = i / (size + item - i)."""
    return F.ceil(F.lit(SIMILARITY) * (size + item) / (1 + SIMILARITY) - F.lit(1e-9)).cast("int")


def _fingerprints(shingles: DataFrame, *key: str) -> DataFrame:
    """(key, fp) from rows (key, hash): bits set in more than half of a key's hashes."""
    sums = [F.sum(F.shiftrightunsigned("hash", k).bitwiseAND(F.lit(_MASK))).alias(f"s{k}") for k in range(_LANES + 1)]
    added = shingles.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *sums)
    fp = F.lit(0).cast("long")
    for bit in range(64):
        shift, lane = (bit % _LANES, bit // _LANES) if bit < 63 else (_LANES, 2)
        ones = F.shiftrightunsigned(f"s{shift}", lane * _LANES).bitwiseAND(F.lit((1 << _LANES) - 1))
        fp = fp.bitwiseOR(F.when(2 * ones > F.col("n"), F.lit(1 << bit if bit < 63 else -(1 << 63))).otherwise(F.lit(0)))
    return added.select(*key, fp.alias("fp"))


def _blocks(fp: Column) -> Column:
    """The blocks of a fingerprint as (block, value)."""
    edges = [round(64 * i / (RADIUS + 1)) for i in range(RADIUS + 2)]
    parts = [
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1)).alias("value"))
        for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False))
    ]
    return F.array(*parts)


def _windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc, start, size, window): the windows that can be similar to an item. window: its words, joined by blanks."""
    gram = F.least("size", F.lit(SHINGLE)).alias("gram")  # a shorter item is one shingle of its own length
    shingles = items.select("item", "size", "n_shingles", gram, F.explode(F.array_distinct("hashes")).alias("hash"))
    distinct = broadcast_up_to(settled(shingles.select("gram", "hash").distinct()), MOST_BROADCAST)
    grams = sorted(r["gram"] for r in distinct.select("gram").distinct().collect()) or [SHINGLE]  # five values at most
    whole = F.size("words").alias("n")
    parted = [docs.select("doc", whole, F.lit(n).alias("gram"), F.posexplode(_hashes(F.col("words"), n)).alias("at", "hash")) for n in grams]
    hits = settled(reduce(DataFrame.unionAll, parted).join(distinct, ["gram", "hash"], "left_semi"))
    # One list of anchors for each document and item. Its length is bounded by the document's.
    of_item = hits.join(broadcast_up_to(settled(shingles), MOST_BROADCAST), ["gram", "hash"])
    anchors = of_item.groupBy("doc", "n", "size", "n_shingles", "item").agg(F.array_sort(F.collect_set("at")).alias("at"))
    own = F.least(F.col("size"), F.col("n"))
    length = F.greatest(own - SHINGLE + 1, F.lit(1))  # shingles of a window
    need = _needed(length, F.col("n_shingles"))
    full = F.filter(
        F.transform("at", lambda a, i: F.when(F.get("at", i + need - 1) < a + length, a)), lambda a: a.isNotNull()
    )
    starts = F.array_distinct(F.transform(full, lambda a: F.greatest(F.least(a, F.col("n") - own), F.lit(0))))
    # Words join only where enough anchors stand together, and once for all items of a size.
    laid = settled(anchors.select("doc", "size", own.alias("own"), F.explode(starts).alias("start")).distinct())
    wanted = broadcast_up_to(settled(laid.select("doc").distinct()), MOST_BROADCAST)
    texts = docs.join(wanted, "doc", "left_semi").dropDuplicates(["doc"])
    laid = texts.join(laid, "doc")
    window = F.array_join(F.slice("words", F.col("start") + 1, F.col("own")), " ")
    return laid.select("doc", "start", "size", window.alias("window"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, start, n_windows): for every document and item with a similar window, the best one.

    start: the first word, from 0, of the first of the most similar windows, which start at shared shingles. Null and empty texts and items have no
    shingle and are similar to nothing. Rows of the same id and text are one document. Null ids keep their row. Other
    columns are not read; an empty table on either side gives an empty result.
    """
    found = _matches(docs, items, id_col, text_col, item_col, item_text_col)
    return found.select(F.col("doc.id").alias("doc_id"), "item_id", "similarity", "start", "n_windows")


def _matches(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc, item_id, similarity, start, n_windows), doc being the id and a hash of the text."""
    text = F.col(text_col)
    doc = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("text"))
    docs = docs.select(doc.alias("doc"), _words(text).alias("words"))
    words = _words(F.col(item_text_col))
    items = items.select(F.col(item_col).alias("item"), words.alias("words")).where(F.size("words") > 0).distinct()
    items = settled(
        items.select("item", F.size("words").alias("size"), "words", _hashes(F.col("words")).alias("hashes"))
        .withColumn("n_shingles", F.size("hashes"))
    )
    places = settled(_windows(docs, items))
    windows = places.select("size", "window").distinct()
    windows = windows.withColumn("words", F.split("window", " "))
    marks = _fingerprints(windows.select("size", "window", F.explode(_hashes(F.col("words"))).alias("hash")), "size", "window")
    item_marks = _fingerprints(items.select("item", "size", F.explode("hashes").alias("hash")), "item", "size")
    ours = marks.select("size", "window", "fp", F.explode(_blocks(F.col("fp"))).alias("part"))
    theirs = item_marks.select("item", "size", F.col("fp").alias("item_fp"), F.explode(_blocks(F.col("fp"))).alias("part"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS
    candidates = ours.join(theirs, ["size", "part"]).where(near).select("size", "window", "item").distinct()
    found = settled(_verified(candidates, items))
    matched = places.join(found, ["size", "window"])
    best = F.struct(F.col("similarity"), (-F.col("start")).alias("start"))
    return (
        matched.groupBy("doc", "item")
        .agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("n_windows"))
        .select(
            "doc",
            F.col("item").alias("item_id"),
            F.col("best.similarity").alias("similarity"),
            (-F.col("best.start")).alias("start"),
            "n_windows",
        )
    )


def _verified(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """(size, window, item, similarity) for the candidates (size, window, item) that are similar enough."""
    window = candidates.select("size", "window", "item", F.explode(_texts(F.split("window", " "))).alias("shingle"))
    window = window.groupBy("size", "window", "item", "shingle").agg(F.count(F.lit(1)).alias("n"))
    known = items.select("item", F.explode(_texts(F.col("words"))).alias("shingle")).groupBy("item", "shingle")
    known = known.agg(F.count(F.lit(1)).alias("m"))
    totals = items.select("item", "n_shingles")
    shared = (
        window.join(known, ["item", "shingle"], "left")
        .groupBy("size", "window", "item")
        .agg(F.sum("n").alias("n"), F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("both"))
        .join(totals, "item")
    )
    similarity = F.col("both") / (F.col("n") + F.col("n_shingles") - F.col("both"))
    return shared.select("size", "window", "item", similarity.alias("similarity")).where(F.col("similarity") >= SIMILARITY)


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that no item contaminates, all columns as they are.

    Rows are told by id and text, null ids included: a row that only shares its id with a contaminated one stays.
    """
    id_name, mark = fresh(docs.columns, "id", "mark")
    found = _matches(docs, items, id_col, text_col).select("doc").distinct()
    found = found.select(F.col("doc.id").alias(id_name), F.col("doc.text").alias(mark))
    found = broadcast_up_to(settled(found), MOST_BROADCAST)
    same = F.col(id_col).eqNullSafe(F.col(id_name)) & (F.xxhash64(F.col(text_col)) == F.col(mark))
    return docs.join(found, same, "left_anti")
