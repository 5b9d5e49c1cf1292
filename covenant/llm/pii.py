"""Personal data: patterns with checks, and what a linear-chain conditional random field adds from word shapes.

The four base kinds are found by their patterns in every whole text, in time linear in its length. The field reads the
same text as lines of words. A word is known by its shape alone: length, digits, letters, dots, signs, first and last
character, put into a few classes each; its own shape and those of its neighbours score its states. It is trained from
a small labelled table (pii_lines.py), once a process, and decoded by Viterbi in numpy batches of lines. Lines in
which every word prefers the outside state by more than any transition could win back are outside throughout, which is
exact, and are not walked.

Runs of words in one state make a span, without brackets, quotes and punctuation around it; spans that touch a
base one are left out. Rows are independent: nothing is shuffled, memory is a few megabytes of text per task, or one
text if that is longer.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.llm.crf import Chain, Sequences, margin, neighbours, train, viterbi

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "iban", "national_id")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIM = "\"'`.,;:!?()[]{}<>*#%&$=|"
_CHUNK = 2_000_000


def _emails(text: str) -> list[Span]:
    found, at, floor = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        floor = domain.end() if domain else at + 1
        if domain:
            found.append(("email", start, floor))
        at = text.find("@", floor)
    return found


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base kinds by kind, then start: leftmost matches that do not overlap, without those that fail their check."""
    found = _emails(text) if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return found


#: Classes of characters, by code point up to 127; letters beyond ASCII count as lower case.
_OTHER, _SPACE, _LOWER, _UPPER, _NUMBER, _DOT, _AT, _DASH, _PLUS, _OPEN, _QUOTE, _EQUAL, _SIGN = range(13)
_CLASS = np.full(128, _SIGN, np.int8)
_CLASS[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = _SPACE
for _c, _chars in ((_LOWER, "abcdefghijklmnopqrstuvwxyz"), (_UPPER, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (_NUMBER, "0123456789"), (_DOT, "."), (_AT, "@"), (_DASH, "-_/"), (_PLUS, "+"), (_OPEN, "()"), (_QUOTE, "\"'`"), (_EQUAL, "=:")):
    _CLASS[[ord(c) for c in _chars]] = _c

#: What a shape is made of: the upper bounds of the buckets of each count.
_BUCKETS = {
    "length": [1, 2, 3, 5, 8, 12, 15, 19, 24, 31], "digits": [0, 1, 2, 3, 4, 6, 8, 11, 15, 19], "letters": [0, 1, 2, 4, 8],
    "upper": [0, 1, 3], "dots": [0, 1, 2, 3], "dashes": [0, 1, 2, 4], "ats": [0, 1], "signs": [0, 1, 3], "turns": [0, 1, 3, 6],
}
_SIZES = [len(b) + 1 for b in _BUCKETS.values()] + [13, 13]
_OFFSETS = np.concatenate(([1], 1 + np.cumsum(_SIZES)[:-1]))
N_FEATURES = 1 + sum(_SIZES)


def _tokens(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, shape) of each word of a text as code points; shape packs the class of every part."""
    kind = np.where(codes < 128, _CLASS[np.minimum(codes, 127)], _LOWER)
    solid = kind != _SPACE
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, end, np.zeros(0, np.int64)

    def counted(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int32)))
        return total[end] - total[start]

    digit, upper = kind == _NUMBER, kind == _UPPER
    letter = upper | (kind == _LOWER)
    turn = np.concatenate(([False], (digit[1:] & letter[:-1]) | (letter[1:] & digit[:-1])))
    counts = {
        "length": end - start, "digits": counted(digit), "letters": counted(letter), "upper": counted(upper),
        "dots": counted(kind == _DOT), "dashes": counted(kind == _DASH), "ats": counted(kind == _AT),
        "signs": counted(kind >= _PLUS), "turns": counted(turn),
    }
    shape = np.zeros(len(start), np.int64)
    for name, limits in _BUCKETS.items():
        shape = shape * (len(limits) + 1) + np.searchsorted(limits, counts[name])
    for place in (start, end - 1):
        shape = shape * 13 + kind[place]
    return start, end, shape


def _rows(shapes: np.ndarray) -> np.ndarray:
    """(shapes, parts): the numbers of the features of packed shapes."""
    parts = np.zeros((len(shapes), len(_SIZES)), np.int64)
    for i in range(len(_SIZES) - 1, -1, -1):
        shapes, parts[:, i] = np.divmod(shapes, _SIZES[i])
    return parts + _OFFSETS


def _lines_of(codes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The first word of each line that has words."""
    line = np.searchsorted(np.flatnonzero(codes == 10), start)
    return np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(start) else np.zeros(0, np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@cache
def trained() -> Chain:
    """The field, fitted once a process to the labelled lines."""
    from covenant.llm.pii_lines import labelled_lines

    shapes, labels, starts, n = [], [], [], 0
    for text, spans in labelled_lines():
        start, end, shape = _tokens(_codes(text))
        label = np.zeros(len(start), np.int64)
        for kind, a, b in spans:
            label[(start < b) & (end > a)] = 1 + KINDS.index(kind)
        starts.append(n)
        n += len(start)
        shapes.append(shape), labels.append(label)
    return train(_rows(np.concatenate(shapes)), np.concatenate(labels), np.array(starts), N_FEATURES, 1 + len(KINDS))


def added_spans(texts: list[str], chain: Chain) -> list[list[Span]]:
    """What the field finds in each text, in one batch."""
    found: list[list[Span]] = [[] for _ in texts]
    whole = "\n".join(texts)
    codes = _codes(whole)
    start, end, shape = _tokens(codes)
    if not len(start):
        return found
    first = _lines_of(codes, start)
    different, place = np.unique(shape, return_inverse=True)
    rows = _rows(different)
    own, before, after = (w[rows].sum(axis=1) for w in (chain.own, chain.before, chain.after))
    scores = own[place]
    last_word = np.zeros(len(start), bool)
    last_word[np.append(first[1:], len(start)) - 1] = True
    inner = np.ones(len(start), bool)
    inner[first] = False
    scores[1:][inner[1:]] += before[place[:-1][inner[1:]]]
    scores[:-1][~last_word[:-1]] += after[place[1:][~last_word[:-1]]]
    length = np.diff(np.append(first, len(start)))
    lead = scores[:, 0] - scores[:, 1:].max(axis=1)
    walk = np.minimum.reduceat(lead, first) <= margin(chain)
    if not walk.any():
        return found
    states = viterbi(scores, chain, Sequences.of(first[walk], length[walk]))
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    marked = np.flatnonzero(states)
    if not len(marked):
        return found
    line = np.searchsorted(first, marked, side="right")
    new = np.concatenate(([True], (np.diff(marked) > 1) | (np.diff(states[marked]) != 0) | (np.diff(line) != 0)))
    heads = np.flatnonzero(new)
    for head, tail in zip(heads, np.append(heads[1:], len(marked)), strict=True):
        a, b = int(start[marked[head]]), int(end[marked[tail - 1]])
        while a < b and whole[a] in _TRIM:
            a += 1
        while b > a and whole[b - 1] in _TRIM:
            b -= 1
        if a < b:
            doc = int(np.searchsorted(bounds, a, side="right")) - 1
            found[doc].append((KINDS[states[marked[head]] - 1], a - int(bounds[doc]), b - int(bounds[doc])))
    return found


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _row(base: list[Span], added: list[Span]) -> tuple:
    """The counts and digests of one text."""
    taken = sorted((a, b) for _, a, b in base)
    new = [s for s in added if not any(s[1] < b and a < s[2] for a, b in taken)]
    spans = sorted([*base, *new], key=lambda s: (KINDS.index(s[0]), s[1]))
    counts = [sum(kind == k for k, _, _ in base) for kind in BASE]
    return (*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of docs.

    Null texts are empty and have no spans. Repeated rows are read each, ids may be null or repeat, and other columns
    are not read. Offsets count code points. An empty table gives an empty result.
    """
    chain = trained()
    names = [*(f"n_{kind}" for kind in BASE), "base_sha256", "spans"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows, at = [], 0
            while at < len(texts):
                stop, chars = at, 0
                while stop < len(texts) and (stop == at or chars + len(texts[stop]) <= _CHUNK):
                    chars += len(texts[stop])
                    stop += 1
                part = texts[at:stop]
                rows += [_row(base_spans(t), added) for t, added in zip(part, added_spans(part, chain), strict=True)]
                at = stop
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *names])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in BASE)
    return narrow.mapInArrow(each, f"doc_id {kind}, {counts}, base_sha256 string, spans string")
