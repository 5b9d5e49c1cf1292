"""License scan with DataFrame functions only: ordered signature rules, a keyword prefilter, and interval suppression.

Texts are lower-cased (A-Z), words are what ASCII letters, digits and characters beyond ASCII make up, and everything
between words becomes one blank. One pattern over all keywords sees off the texts without any; in the others, the rules
(license_rules.py) are tried of whose keywords one begins a word. A match is marked in the text by two control characters, which no normalised text has, so that
splitting at blanks gives the word interval of every match in one pass.

A detection is suppressed if its interval lies in that of another one of the same or a higher priority; of equal
intervals the higher priority stays, then the rule that comes first. Base detections always stay.

Texts are scanned once and not shuffled; what is shuffled are the detections, spread by document.
"""

from __future__ import annotations

import json
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covenant.llm.common import settled
from covenant.llm.license_rules import RULES

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_OPEN, _CLOSE = "\x01", "\x02"
_KEYWORDS = sorted({keyword for rule in RULES for keyword in rule.keywords})
#: Any keyword at the start of a word, with first letters taken out so that most words fail at their first letter.
_ANY = " (?:" + "|".join(f"{first}(?:{'|'.join(k[1:] for k in some)})" for first, some in groupby(_KEYWORDS, lambda k: k[0])) + ")"
_HIT = "array<struct<rule: int, first: int, last: int>>"


def normalised(text: Column) -> Column:
    # lower() also touches letters beyond ASCII, but makes no blank of a letter, and no letter of a base phrase
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _BETWEEN, " "))


def _intervals(padded: Column, pattern: Column) -> Column:
    """(first, last) word of each match in padded, a normalised text between two blanks."""
    bounded = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    marked = F.call_function("regexp_replace", padded, bounded, F.lit(f"{_OPEN}$0{_CLOSE}"))
    words = F.split(F.trim(marked), " ")
    numbered = F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    starts = F.filter(numbered, lambda w: w["word"].startswith(_OPEN))
    ends = F.filter(numbered, lambda w: w["word"].endswith(_CLOSE))
    return F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda z: F.struct(z["s"]["at"].alias("first"), z["e"]["at"].alias("last")))


def _hits(text: Column) -> Column:
    """All matches of all rules in a normalised text."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    words = lambda keywords: F.array(*(F.lit(f" {k}") for k in keywords))
    rules = F.array(
        *(F.struct(F.lit(i).alias("rule"), words(r.keywords).alias("keywords"), F.lit(r.pattern).alias("pattern")) for i, r in enumerate(RULES))
    )
    there = F.filter(words(_KEYWORDS), lambda k: F.contains(padded, k))
    # held in an array of one, so that it is made once and not for every rule
    gated = F.flatten(F.transform(F.array(there), lambda some: F.filter(rules, lambda r: F.arrays_overlap(r["keywords"], some))))
    tried = F.filter(gated, lambda r: F.call_function("rlike", padded, F.concat(F.lit(" (?:"), r["pattern"], F.lit(") "))))
    found = F.flatten(
        F.transform(
            tried,
            lambda r: F.transform(_intervals(padded, r["pattern"]), lambda m: F.struct(r["rule"].alias("rule"), m["first"].alias("first"), m["last"].alias("last"))),
        )
    )
    return F.when(padded.rlike(_ANY), found).otherwise(F.array().cast(_HIT)).cast(_HIT)


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_words, hits) for each row: the key (id, hash of the text), and every match as (rule, first, last)."""
    doc = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    plain = docs.select(doc.alias("doc"), normalised(F.col(text_col)).alias("plain"))
    words = F.when(F.col("plain") == "", 0).otherwise(F.length("plain") - F.length(F.replace("plain", F.lit(" "))) + 1)
    return plain.select("doc", words.cast("long").alias("n_words"), _hits(F.col("plain")).alias("hits"))


def surviving(found: DataFrame) -> DataFrame:
    """(doc, rule, label, score, base, first, last): the detections of found (doc, hits) that no other one suppresses."""
    told = [{"rule": i, "label": r.label, "priority": r.priority, "score": r.score, "base": r.base} for i, r in enumerate(RULES)]
    kind = "array<struct<rule: int, label: string, priority: int, score: double, base: boolean>>"
    rules = found.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(told)), kind)))
    rows = found.select("doc", F.explode("hits").alias("hit")).select("doc", "hit.*").distinct()
    rows = rows.join(F.broadcast(rules), "rule")  # a constant of a few hundred rows
    order = Window.partitionBy("doc").orderBy("first", F.desc("last"), F.desc("priority"), "rule")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(*(F.when(F.col("priority") == p, F.max(F.when(F.col("priority") >= p, F.col("last"))).over(before)) for p in (1, 2, 3)))
    return rows.withColumn("reach", reach).where("base OR reach IS NULL OR reach < last").drop("reach", "priority")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs.

    n_base, first_word and last_word are of the base phrases: how many places, their smallest and largest start. score:
    the largest of the surviving detections, 0 without any. Null and empty texts have no words and no detection;
    repeated rows get a row each; null ids keep theirs. Other columns are not read.
    """
    found = settled(detections(docs, id_col, text_col))
    base = F.col("base")
    labels = lambda which: F.array_join(F.array_sort(F.collect_set(which)), ",")
    rows = surviving(found.where(F.size("hits") > 0)).groupBy(F.col("doc").alias("of"))
    told = rows.agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        labels(F.when(base, F.col("label"))).alias("base_labels"),
        labels(F.col("label")).alias("labels"),
        F.max("score").alias("score"),
    )
    joined = found.join(told, found["doc"].eqNullSafe(told["of"]), "left")
    return joined.select(
        F.col("doc.id").alias("doc_id"),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
