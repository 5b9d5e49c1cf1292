"""Line deduplication through a suffix array over line ids, with DataFrame functions only.

The texts are one long sequence of lines, by document and place. A run of consecutive lines with LEAST_WORDS words or
more in total that also occurs at an earlier place is a later copy, and its lines are deleted. Lines without a word are
no part of the sequence and stay.

Prefix doubling. Lines that occur once cannot be part of a repeated run and leave at once; what is left of a document
are stretches of repeated lines. A suffix starts at every line of a stretch. Its rank over 2^k lines orders it among all
suffixes by their first 2^k lines: the pairs (rank of the first half, rank of the second half) are counted with map-side
combine, pairs that occur once leave, and a range sort of the different pairs numbers them in order. Suffixes of equal
rank form an interval with a common prefix of 2^k lines or more; an interval for a length in between is named by two
overlapping ranks. Each has an earliest member, and the runs of the others are later copies.

Runs: every line opens the shortest run of LEAST_WORDS words that starts with it and the shortest one that ends with it.
A repeated run of enough words is the union of such runs inside it, so deleting those of them that occur earlier deletes
exactly the lines of all maximal repeated runs, and a run of LEAST_WORDS words has LEAST_WORDS lines at most: the
doubling ends after log2(LEAST_WORDS) rounds whatever the data.

A very common line is a hot key only in joins against tables with one row per key, which Spark splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covenant.llm.common import WORD, broadcast_up_to, fresh, n_words, settled

LEAST_WORDS = 50
#: Up to so many documents with deleted lines are broadcast to the texts; beyond, the texts are shuffled.
MOST_BROADCAST = 100_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _worded(lines: Column) -> Column:
    """The lines with a word."""
    return F.filter(lines, _has_word)


def _has_word(line: Column) -> Column:
    return line.rlike(WORD)


def _positions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, place, h1, h2, words): the lines with a word. doc: the id and a hash of the text."""
    text = F.col(text_col)
    doc = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("text"))
    # first the document, then its lines: the text would be hashed again for every one of them
    texts = docs.select(doc.alias("doc"), _worded(_lines(text)).alias("lines"))
    lines = texts.select("doc", F.posexplode("lines").alias("place", "line"))
    two = (F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    return lines.select("doc", "place", *two, n_words(F.col("line")).alias("words"))


def _ranked(counted: DataFrame, *key: str) -> DataFrame:
    """(key, rank): numbers, in the order of the keys, for the keys that occur twice or more."""
    ordered = counted.where("n > 1").select(*key).repartitionByRange(*key).sortWithinPartitions(*key)
    return settled(ordered.withColumn("rank", F.monotonically_increasing_id()))


def _runs(repeated: DataFrame, least_words: int) -> DataFrame:
    """(doc, lines, places, aheads, ranks): a document's repeated lines in order, each with the lengths of the runs from
    it (ahead) and up to it (back), or 0, and some of their fields as lists of their own.

    Stretches of fewer than least_words words in total are left out.
    """
    by_place = Window.partitionBy("doc").orderBy("place")
    stretch = Window.partitionBy("doc", "stretch").orderBy("place")
    whole = Window.partitionBy("doc", "stretch")
    rows = (
        repeated.withColumn("stretch", F.col("place") - F.row_number().over(by_place))
        .withColumn("after", F.sum("words").over(stretch))
        .withColumn("before", F.col("after") - F.col("words"))
        .withColumn("total", F.sum("words").over(whole))
        .withColumn("first", F.min("place").over(whole))
        .withColumn("last", F.max("place").over(whole))
        .where(F.col("total") >= least_words)
    )
    down = Window.partitionBy("doc", "stretch").orderBy(F.desc("before")).rangeBetween(Window.unboundedPreceding, -least_words)
    up = Window.partitionBy("doc", "stretch").orderBy("after").rangeBetween(Window.unboundedPreceding, -least_words)
    rows = rows.withColumn("next", F.min("place").over(down)).withColumn("prior", F.max("place").over(up))
    ends = F.coalesce("next", F.when(F.col("total") - F.col("before") >= least_words, F.col("last") + 1))
    starts = F.coalesce(F.col("prior") + 1, F.when(F.col("after") >= least_words, F.col("first")))
    rows = rows.select(
        "doc",
        F.struct(
            "place",
            "rank",
            F.coalesce(ends - F.col("place"), F.lit(0)).alias("ahead"),
            F.coalesce(F.col("place") + 1 - starts, F.lit(0)).alias("back"),
        ).alias("line"),
    )
    rows = rows.groupBy("doc").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    # ranks[i] belongs to lines[i]; null once the suffix has no other one with the same prefix
    return rows.select("doc", "lines", *(F.col(f"lines.{c}").alias(f"{c}s") for c in ("place", "ahead", "rank")))


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc, start, length, source): the runs of lines that occur earlier, and the place of the earliest one.

    doc and source.doc are (id, hash of the text); start and length count lines with a word. Rows with the same id and
    text are one document. Where ids are equal, the hash of the text decides which is earlier; null ids come first.
    """
    lines = _positions(docs, id_col, text_col)
    ranks = _ranked(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")), "h1", "h2")
    held = settled(_runs(lines.join(ranks, ["h1", "h2"]), least_words))
    found, k = [], 0
    while True:
        found.append(_intervals(held, k))
        k += 1
        if 1 << k > least_words:
            break
        held = settled(_doubled(held, 1 << (k - 1)))
        if held.isEmpty():
            break
    runs = settled(reduce(DataFrame.unionByName, found))
    key = ["length", "first_rank", "last_rank"]
    place = F.struct("doc", "start")
    first = runs.groupBy(*key).agg(F.min(place).alias("source"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # settled, so that the join gets both sides straight out of shuffles and the rows of a hot passage can be split
    copies = runs.join(settled(first), key).where(F.col("source") < place)
    return copies.select("doc", "start", "length", "source")


def _intervals(held: DataFrame, k: int) -> DataFrame:
    """(doc, start, length, first_rank, last_rank): the runs of 2^k up to 2^(k+1) - 1 lines, named by their ranks."""
    size = 1 << k

    def run(start: Column, place: Column, length: Column) -> Column:
        return F.struct(
            place.cast("int").alias("place"),
            length.alias("length"),
            F.get("ranks", start).alias("first_rank"),
            F.get("ranks", start + length - size).alias("last_rank"),
        )

    ahead = F.transform("lines", lambda line, i: run(i, line["place"], line["ahead"]))
    # the lines of a run follow one another, so its first place is known from its last; a run that is also the run from its
    # first line is there already
    back = F.transform(
        "lines",
        lambda line, i: F.when(
            F.get("aheads", i + 1 - line["back"]) != line["back"],
            run(i + 1 - line["back"], line["place"] + 1 - line["back"], line["back"]),
        ),
    )
    fits = F.filter(
        F.concat(ahead, back),
        lambda r: (r["length"] >= size) & (r["length"] < 2 * size) & r["first_rank"].isNotNull() & r["last_rank"].isNotNull(),
    )
    rows = held.select("doc", F.explode(fits).alias("run"))
    return rows.select("doc", F.col("run.place").alias("start"), "run.length", "run.first_rank", "run.last_rank")


def _doubled(held: DataFrame, size: int) -> DataFrame:
    """held with the ranks over 2 * size lines, from those over size lines. Documents whose suffixes all left go too."""
    pairs = F.transform(
        "lines",
        lambda line, i: F.when(
            F.get("places", i + size) == line["place"] + size,
            F.struct(i.alias("at"), F.get("ranks", i).alias("one"), F.get("ranks", i + size).alias("two")),
        ),
    )
    rows = held.select("doc", F.explode(pairs).alias("pair")).select("doc", "pair.at", "pair.one", "pair.two")
    rows = settled(rows.where("one IS NOT NULL AND two IS NOT NULL"))
    ranks = _ranked(rows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")), "one", "two")
    new = rows.join(ranks, ["one", "two"]).groupBy("doc").agg(F.collect_set(F.struct("at", "rank")).alias("new"))
    held = held.join(new, "doc")
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    without = F.transform(F.array_except(every, F.transform("new", lambda n: n["at"])), lambda at: F.struct(at.alias("at"), F.lit(None).cast("long").alias("rank")))
    dense = F.transform(F.array_sort(F.concat("new", without)), lambda n: n["rank"])
    return held.select("doc", "lines", "places", "aheads", dense.alias("ranks"))


def _deleted(copies: DataFrame) -> DataFrame:
    """(doc, gone): the numbers of the deleted lines among the lines with a word."""
    places = F.array_distinct(F.flatten(F.collect_list(F.sequence("start", F.col("start") + F.col("length") - 1))))
    return copies.groupBy("doc").agg(F.array_sort(places).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with the later copies of repeated runs taken out of the texts, all other columns as they are.

    A text that loses all its lines with a word becomes empty. Null texts stay null and have no lines, an empty table
    stays empty. Rows with the same id and text are one document, so a repeated row is no copy of itself.
    """
    gone, kept = fresh(docs.columns, "gone", "kept")
    texts = _cleaned(docs, id_col, text_col, least_words, gone, kept)
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return texts.select(*(text.alias(c) if c == text_col else F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_deleted, text): for every row of docs its lines, how many were deleted, and what is left."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts = _cleaned(docs, "doc_id", "text", least_words, "gone", "kept")
    deleted = F.coalesce(F.size("gone"), F.lit(0))
    n = F.coalesce(F.size("kept") + deleted, F.size(_lines(F.col("text"))), F.lit(0))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    return texts.select("doc_id", n.alias("n_lines"), deleted.alias("n_deleted"), text.alias("text"))


def _cleaned(docs: DataFrame, id_col: str, text_col: str, least_words: int, gone: str, kept: str) -> DataFrame:
    """docs with gone, the numbers of a text's deleted lines among those with a word, and kept, its other lines.

    Both are null where nothing is deleted. Each list is made in a generator's row: a projection might be merged with
    the one above it, and its value then be computed again for every element that is looked up in it.
    """
    id_name, text_name, lines, worded, left = fresh([*docs.columns, gone, kept], "id", "hash", "lines", "worded", "left")
    found = _deleted(later_copies(docs, id_col, text_col, least_words))
    found = found.select(F.col("doc.id").alias(id_name), F.col("doc.text").alias(text_name), F.col("gone").alias(gone))
    found = broadcast_up_to(settled(found), MOST_BROADCAST)
    text = F.col(text_col)
    joined = docs.join(found, F.col(id_col).eqNullSafe(F.col(id_name)) & (F.xxhash64(text) == F.col(text_name)), "left")

    def made(df: DataFrame, column: Column, name: str) -> DataFrame:
        return df.select("*", F.explode(F.array(F.when(F.col(gone).isNotNull(), column))).alias(name))

    rows = made(joined, _lines(text), lines)
    places = F.filter(F.transform(lines, lambda line, i: F.when(_has_word(line), i)), lambda i: i.isNotNull())
    rows = made(rows, places, worded)
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    rows = made(rows, F.array_except(every, F.transform(gone, lambda i: F.get(worded, i))), left)
    return rows.withColumn(kept, F.transform(left, lambda i: F.get(lines, i)))
