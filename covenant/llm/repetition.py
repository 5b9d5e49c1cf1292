"""Quality rules: how much of a text lies inside repeated word n-grams and repeated lines.

Words become numbers in order of first use. A window of three words is packed exactly into one integer; for longer
windows a 64-bit rolling hash over mixed word numbers grows by one word at a time, all in numpy. A window length is only
looked at while the shorter one still repeats, since a repeated window contains repeated shorter ones.

Nothing is shuffled: each row is measured on its own, so hot sources and copies make no difference. Memory per task is
one Arrow batch plus the arrays of one text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of a text's word characters that may lie inside n-grams of so many words that the text holds twice or more:
#: a little above the highest of the labelled good documents of sf0.1, which are 0.276, 0.276 and 0.177.
NGRAM_LIMITS = {5: 0.30, 7: 0.28, 10: 0.20}
#: The same for the characters of lines equal to an earlier line.
LINE_LIMIT = 0.30
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\v\f\r"
_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "line_coverage double, ngram_coverage array<double>, base_failed boolean, kept boolean"
)


def measure(text: str | None) -> tuple:
    """The values of MEASURES for one text; a null text has no words."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # bytes split at exactly the six blanks of ASCII
    n = len(words)
    word_chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    dup_lines, dup_line_chars = _lines(text)
    numbers = _numbers(words)
    repeated = _repeated(_triples(numbers)) if n > 2 else None
    repeat_words, coverage = 0, [0.0] * len(NGRAM_LIMITS)
    if repeated is not None:
        repeat_words = int(_cover(repeated, 3).sum())
        coverage = _coverage(raw, numbers, word_chars)
    line_coverage = dup_line_chars / word_chars if word_chars else 0.0
    failed = n < LEAST_WORDS or 100 * repeat_words > MOST_REPEATED_PERCENT * n
    kept = not failed and line_coverage <= LINE_LIMIT
    kept = kept and all(c <= most for c, most in zip(coverage, NGRAM_LIMITS.values(), strict=True))
    return n, word_chars, symbols, dup_lines, repeat_words, line_coverage, coverage, failed, kept


def _lines(text: str) -> tuple[int, int]:
    """How many lines with a word equal an earlier one, and their word characters."""
    seen: set[str] = set()
    lines = chars = 0
    for line in text.split("\n"):
        if not line.strip(_SPACES):
            continue
        if line in seen:
            lines += 1
            chars += len(line) - sum(map(line.count, _SPACES))
        seen.add(line)
    return lines, chars


def _numbers(words: list[bytes]) -> np.ndarray:
    seen: defaultdict[bytes, int] = defaultdict(count().__next__)
    return np.fromiter(map(seen.__getitem__, words), dtype=np.int64, count=len(words))


def _triples(numbers: np.ndarray) -> np.ndarray:
    """One integer for each window of three words, equal exactly where the windows are."""
    a, b, c = numbers[:-2], numbers[1:-1], numbers[2:]
    if numbers.max() >= 1 << 21:  # three numbers of more than 21 bits do not fit in one integer
        pair = np.unique((a << 31) | b, return_inverse=True)[1]
        return (pair << 31) | c
    return (a << 42) | (b << 21) | c


def _repeated(codes: np.ndarray) -> np.ndarray | None:
    """True for codes that occur twice or more; None if there are none."""
    ordered = np.sort(codes)
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return None
    twice = np.unique(ordered[1:][same])
    return twice[np.minimum(np.searchsorted(twice, codes), len(twice) - 1)] == codes


def _cover(starts: np.ndarray, n: int) -> np.ndarray:
    """True for each word inside one of the windows of n words that begin where starts is true."""
    steps = np.zeros(len(starts) + n, dtype=np.int64)
    steps[: len(starts)] += starts
    steps[n : n + len(starts)] -= starts
    return np.cumsum(steps)[: len(starts) + n - 1] > 0


def _coverage(raw: bytes, numbers: np.ndarray, word_chars: int) -> list[float]:
    data = np.frombuffer(raw, dtype=np.uint8)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = inside & ~np.concatenate(([False], inside[:-1]))
    chars = np.add.reduceat((inside & ((data & 0xC0) != 0x80)).astype(np.int64), np.flatnonzero(first))
    value = (numbers.astype(np.uint64) + np.uint64(1)) * _MIX
    value ^= value >> np.uint64(29)
    rolling, found = value.copy(), []
    lengths = list(NGRAM_LIMITS)
    for n in range(2, lengths[-1] + 1):
        if len(value) < n:
            break
        rolling = rolling[:-1] * _BASE + value[n - 1 :]
        if n in NGRAM_LIMITS:
            repeated = _repeated(rolling)
            if repeated is None:
                break
            found.append(float(chars[_cover(repeated, n)].sum() / word_chars))
    return found + [0.0] * (len(lengths) - len(found))


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, and the columns of MEASURES) for every row of docs.

    Null and empty texts have no words and fail the base rule; repeated rows are measured each; other columns, whatever
    their names, are not read. An empty table gives an empty result.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in MEASURES.split(", ")]
        for batch in batches:
            rows = [measure(text.as_py()) for text in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            kinds = [pa.int64()] * 5 + [pa.float64(), pa.list_(pa.float64()), pa.bool_(), pa.bool_()]
            arrays = [pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *names])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(each, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, {MEASURES}")


def keep_unrepetitive(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, all columns as they are."""
    place = docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([measure(text.as_py())[-1] for text in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(each, docs.schema)
