"""Rows that operators must not stumble over, and words and shingles in plain Python."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession

LONG = " ".join(f"word{i % 7919} of{i}" for i in range(30_000))
#: Nulls in every column, empty and very long texts, ties, repeated rows.
ODD = [
    (None, "no id here, but a text of its own", None),
    (1, None, "a"),
    (2, "", None),
    (3, " \n\t\n ", "b"),
    (4, LONG, "c"),
    (5, "the same text twice\nand a second line", "d"),
    (6, "the same text twice\nand a second line", "d"),
    (6, "the same text twice\nand a second line", "d"),
    (6, "another text of the same id", "d"),
    (7, "é" * 70_000 + " \U0001f600 end", "e"),
]
#: Columns whose names operators use inside.
CLASHES = ("rank", "fp", "doc", "words", "place", "start", "length", "hash", "n", "label", "kept", "text_", "offset", "lines")
#: Names that helper columns would have.
CLASHES += ("gone", "__gone", "__id", "__hash", "__text", "id", "worded", "left", "mark", "component_id", "__group")


def odd(spark: SparkSession) -> DataFrame:
    names = ["doc_id long", "text string", "source string", *(f"`{c}` string" for c in CLASHES)]
    return spark.createDataFrame([(*row, *CLASHES) for row in ODD], ", ".join(names))


def words(text: str | None) -> list[str]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles(found: list[str], n: int) -> Counter:
    return Counter(tuple(found[i : i + n]) for i in range(max(len(found) - n + 1, min(len(found), 1))))
