"""Spelling variants: pairs of vocabulary words one edit apart, by composing acceptors with a one-edit transducer.

The vocabulary is an acceptor A; accepted by A o E o A, with E the transducer of exactly one inserted, deleted or replaced
letter, are the pairs wanted. E is made unambiguous (the edit comes where the two words first differ), so every pair is
accepted once. The composition is enumerated by initial states: words of l letters, and words of l + 1 that one insertion
makes of them, form class l; a class falls apart by the span of letters [from, to) in which the edit lies, and by the
letters before and after the span, which both words have in common. One such cell is what can be reached from one initial
state of the composition, and its words only differ in the letters of the span. Cells are dealt over the tasks; a task
minimises the acceptors of a cell's spans (one register of states for all its cells) and enumerates what the composition
accepts.

A class starts with two spans, longer words with spans of SPAN letters. Cells of more than CELL words are split into the
two halves of their span until they are small; a span of one letter holds no more words than the alphabet has letters, or
pairs of them. No link is lost: for every pair one span holds the edit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.llm.common import settled

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS, TIMES, FACTOR, SLIP = 5, 3, 2, 97
#: Letters of a span at most, and words of a cell before it is split.
SPAN, CELL = 32, 20_000
#: Words of classes above this go by their hash through the enumeration and are looked up afterwards.
_NAMED = 64
#: States and remembered intersections of a task before it starts anew.
_STATES = 300_000


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of at least LETTERS letters that occur TIMES times or more.

    A run of letters counts in lower case (A-Z only). If SLIP divides the crc32 of "<doc_id>:<run>", h, the run loses its
    letter h % length. A null text has no runs, a null id is an empty one. Other columns are not read.
    """
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(text_col, F.lit(RUN), F.lit(0))).alias("run"),
    )
    low = runs.where(F.length("run") >= LETTERS).select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = low.select("run", F.crc32(F.concat_ws(":", "doc", "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    slipped = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = hashed.select(F.when(F.pmod("h", F.lit(SLIP)) == 0, slipped).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= TIMES)


def _cells(words: DataFrame, longest: int | None, cell: int, span: int) -> DataFrame:
    """(key, size, open, name, n, part): every word in the cells it may have a partner in.

    part: its letters in the span; size: how many of them a word of l letters has; open: whether an insertion may come after
    the last of them, where the word ends.
    """
    length = F.length("word")
    classes = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("l")).where(F.col("l") >= 1)
    classes = classes.where(F.col("l") <= longest if longest else F.col("l") > _NAMED)
    step = F.least(F.ceil(F.col("l") / 2), F.lit(span)).cast("int")
    starts = F.explode(F.sequence(F.lit(0), F.col("l") - 1, step)).alias("from")
    spans = classes.select("word", "n", "l", starts, step.alias("step"))
    size = F.least(F.col("step"), F.col("l") - F.col("from"))
    after = F.col("l") - F.col("from") - F.col("size")
    rows = spans.withColumn("size", size).withColumn("after", after)
    before = F.substr("word", F.lit(1), F.col("from"))
    behind = F.substr("word", F.length("word") - F.col("after") + 1)
    middle = F.substr("word", F.col("from") + 1, F.length("word") - F.col("from") - F.col("after"))
    key = F.md5(F.concat_ws("|", F.col("l"), F.col("from"), before, behind).cast("binary"))
    name = F.col("word") if longest else F.sha2("word", 256)
    return _small(rows.select(key.alias("key"), "size", (F.col("after") == 0).alias("open"), name.alias("name"), "n", middle.alias("part")), cell)


def _small(rows: DataFrame, cell: int) -> DataFrame:
    """The rows with cells of more than so many words split into halves of their spans, as far as they go."""
    done: DataFrame | None = None
    while True:
        rows = settled(rows)
        full = rows.where("size > 1").groupBy("key").count().where(F.col("count") > cell)
        full = settled(full.select("key"))
        if full.isEmpty():
            return rows if done is None else done.unionByName(rows)
        kept = rows.join(full, "key", "left_anti")
        done = kept if done is None else done.unionByName(kept)
        left = F.floor(F.col("size") / 2).cast("int")
        right = F.col("size") - left
        longer = F.length("part") - F.col("size")
        halves = F.explode(F.array(F.lit(0), F.lit(1))).alias("half")
        split = rows.join(full, "key", "left_semi").select("*", halves)
        first = F.col("half") == 0
        common = F.when(first, F.substr("part", left + longer + 1)).otherwise(F.substr("part", F.lit(1), left))
        part = F.when(first, F.substr("part", F.lit(1), left + longer)).otherwise(F.substr("part", left + 1))
        rows = split.select(
            F.md5(F.concat_ws("|", "key", "half", common).cast("binary")).alias("key"),
            F.when(first, left).otherwise(right).alias("size"),
            (F.col("open") & ~first).alias("open"),
            "name",
            "n",
            part.alias("part"),
        )


class Acceptors:
    """Minimal acyclic acceptors that share one register of states. A state is (final, arcs), arcs by letter."""

    def __init__(self) -> None:
        self.states: list[tuple[bool, dict[str, int]]] = []
        self.register: dict[tuple, int] = {}
        self.shared: dict[tuple[int, int], list[str]] = {}

    def of(self, words: list[str], at: int = 0) -> int:
        """The initial state of an acceptor of these words: sorted, different, equal in their first at letters."""
        final = len(words[0]) == at
        arcs: dict[str, int] = {}
        start = int(final)
        while start < len(words):
            letter, end = words[start][at], start + 1
            while end < len(words) and words[end][at] == letter:
                end += 1
            arcs[letter] = self.of(words[start:end], at + 1)
            start = end
        made = (final, *arcs.items())
        state = self.register.setdefault(made, len(self.states))
        if state == len(self.states):
            self.states.append((final, arcs))
        return state

    def both(self, p: int, q: int) -> list[str]:
        """What is accepted from either state."""
        pair = (p, q) if p <= q else (q, p)
        found = self.shared.get(pair)
        if found is None:
            (final, arcs), (other_final, others) = self.states[p], self.states[q]
            found = [""] if final and other_final else []
            for letter, state in arcs.items():
                if letter in others:
                    found += [letter + rest for rest in self.both(state, others[letter])]
            self.shared[pair] = found
        return found

    def replaced(self, p: int) -> list[tuple[str, str]]:
        """Accepted pairs with one letter replaced, the smaller word first."""
        out = []
        work = [(p, "")]
        while work:
            state, before = work.pop()
            arcs = list(self.states[state][1].items())
            for i, (letter, to) in enumerate(arcs):
                for other, there in arcs[i + 1 :]:
                    out += [(before + letter + rest, before + other + rest) for rest in self.both(to, there)]
                work.append((to, before + letter))
        return out

    def inserted(self, p: int, q: int, ends: bool) -> list[tuple[str, str]]:
        """(word, longer word): the second is accepted from q and has one more letter than the first, accepted from p.

        The letter comes where the two first differ; at the end of the first only if it ends there.
        """
        out = []
        work = [(p, q, "")]
        while work:
            state, longer, before = work.pop()
            arcs, others = self.states[state][1], self.states[longer][1]
            for letter, to in others.items():
                for rest in self.both(state, to):
                    if rest[:1] != letter if rest else ends:
                        out.append((before + rest, before + letter + rest))
            work += [(to, others[letter], before + letter) for letter, to in arcs.items() if letter in others]
        return out


def links(cells: DataFrame) -> DataFrame:
    """(name, n, near, near_n): every pair of words that are one edit apart, once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, found = Acceptors(), []
        for size, ends, words in _by_cell(batches):
            if len(machine.states) + len(machine.shared) > _STATES:
                machine = Acceptors()
            plain = sorted(part for part in words if len(part) == size)
            longer = sorted(part for part in words if len(part) > size)
            if not plain or len(words) == 1:
                continue
            start = machine.of(plain)
            pairs = machine.replaced(start)
            if longer:
                pairs += machine.inserted(start, machine.of(longer), ends)
            found += [(*words[a], *words[b]) for a, b in pairs]
            if len(found) >= 10_000:
                yield batch_of(found)
                found = []
        yield batch_of(found)

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        schema = pa.schema({"name": pa.string(), "n": pa.int64(), "near": pa.string(), "near_n": pa.int64()})
        columns = zip(*found, strict=True) if found else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    dealt = cells.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(each, "name string, n long, near string, near_n long")


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, dict[str, tuple[str, int]]]]:
    """Size, openness and words by part of each cell, from rows in order of their keys."""
    now, size, ends, words = None, 0, False, {}
    for batch in batches:
        for key, length, is_open, name, n, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now:
                if words:
                    yield size, ends, words
                now, size, ends, words = key, length, is_open, {}
            words[part] = (name, n)
    if words:
        yield size, ends, words


def near_words(words: DataFrame, cell: int = CELL, span: int = SPAN) -> DataFrame:
    """(name, n, near, near_n): every pair of words (word, n) that are one edit apart, once."""
    short = links(_cells(words.where(F.length("word") <= _NAMED + 1), _NAMED, cell, span))
    long = settled(words.where(F.length("word") > _NAMED).withColumn("key", F.sha2("word", 256)))
    if long.isEmpty():
        return short
    pairs = links(_cells(long.select("word", "n"), None, cell, span)).select(F.col("name").alias("key"), F.col("near").alias("other"))
    named = long.select("key", F.col("word").alias("name"), "n")
    others = long.select(F.col("key").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return short.unionByName(pairs.join(named, "key").join(others, "other").select("name", "n", "near", "near_n"))


def variants(words: DataFrame, cell: int = CELL, span: int = SPAN) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of a vocabulary (word, n), words being different.

    n_near: the words one edit away. form: of these the one of largest n (of equal ones the smallest in code-point order),
    if it has FACTOR times the word's n or more, else null. root: where forms lead, the word itself if it has none.
    """
    words = settled(words.select("word", "n"))
    once = settled(near_words(words, cell, span))
    turned = once.select(F.col("near").alias("name"), F.col("near_n").alias("n"), F.col("name").alias("near"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("form"))).alias("best")
    by_word = once.unionByName(turned).groupBy(F.col("name").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best)
    told = words.join(by_word, "word", "left")
    formed = -F.col("best.rank") >= FACTOR * F.col("n")
    told = settled(
        told.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(formed, F.col("best.form")).alias("form"),
            F.when(formed, -F.col("best.rank")).alias("form_n"),
        )
    )
    roots = _roots(told.where("form is not null").select("word", F.col("form").alias("root")))
    return told.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def _roots(steps: DataFrame) -> DataFrame:
    """steps (word, root) with each root followed to the last, by doubling: n grows along the steps, so they end."""
    while True:
        steps = settled(steps)
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = settled(steps.join(further, "root", "left"))
        if joined.where("further is not null").isEmpty():
            return steps
        steps = joined.select("word", F.coalesce("further", "root").alias("root"))
