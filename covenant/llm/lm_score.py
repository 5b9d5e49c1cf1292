"""Language-model scores by masked pseudo-likelihood: a network over a two-sided window predicts every word.

A text's score is the sum of log P(word | REACH words on either side) over its words, with A-Z lowered.

* Vocabulary: all words of all documents are counted. A word with least(total words) occurrences or more has a number of
  its own; all others are one number to predict, with P(word | window) = P(other | window) P(word | other), and BUCKETS
  numbers by a hash as neighbours. Other words with listed(total words) occurrences or more have their share of them all as
  P(word | other); the rest is spelled, byte by byte after the two before, with chances from the counts of all such words.
  So every word has a chance of its own, also one never seen.
* Network: the neighbours' embeddings, by place, add up to a hidden layer, which predicts the class of the number and
  then the number within its class, two small softmaxes in place of a large one.
* Training in numpy over all documents, every word predicted once: trainers(total words) copies train on pieces dealt out
  anew, so that their steps follow the number of words and not how the input is split. A word's place modulo ROUNDS says
  in which round it is masked; after each, copies and their gradients' squares are averaged by the number of words, in
  slices, in a shuffle, and all go on from there.
* What reaches the driver and each task: with r the cube root of the number of words, at most 32 r words with numbers
  and one model over these, at most 1024 r further words, and 2^20 chances of letters. Shuffled are the counts of words,
  the numbers once, and the copies.

Scoring is a map over pieces; memory per task is the model and one piece of words.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.llm.common import settled

REACH = 2
#: Numbers that neighbours without one of their own share.
BUCKETS = 512
WIDTH, HIDDEN = 16, 24
#: Contexts of a byte, and how many seen bytes the byte's chance after the last byte alone counts for.
CONTEXTS, PRIOR = 1 << 12, 4
ROUNDS = 8
RATE = 0.2
#: Words of a step: so many that a copy takes STEPS a round, within these bounds.
BATCHES, STEPS = (512, 8192), 64
#: Words that are counted together, and words of a piece that is read at once.
_BLOCK, _PIECE = 1 << 21, 1 << 16
#: Words that are scored at once.
_PART = 1 << 13
#: Weights that are averaged in one row.
_SLICE = 1 << 14

Model = dict[str, np.ndarray]


def least(total: int) -> int:
    """From so many occurrences on, a word has a number of its own."""
    return max(1, int(total ** (2 / 3)) // 32)


def listed(total: int) -> int:
    """From so many occurrences on, a word's share of the words without numbers is listed."""
    return max(1, int(total ** (2 / 3)) // 1024)


def trainers(total: int) -> int:
    """How many copies train: with the root of the number of words, so that both copies and the steps of each grow."""
    return max(1, math.isqrt(total >> 18))


def batch_size(total: int) -> int:
    low, high = BATCHES
    return min(high, max(low, total // trainers(total) // ROUNDS // STEPS))


def shapes(own: int) -> dict[str, tuple[int, ...]]:
    """The model's arrays for so many words with numbers, one after another in a flat list of floats."""
    side = math.isqrt(own) + 1  # side * side numbers to predict: the words, the others, and some that stay unused
    return {
        "embedding": (own + BUCKETS + 1, WIDTH), "places": (2 * REACH, WIDTH, HIDDEN), "bias": (HIDDEN,),
        "classes": (HIDDEN, side), "class_bias": (side,), "words": (side, HIDDEN, side), "word_bias": (side, side),
    }


def _shaped(flat: np.ndarray, own: int) -> Model:
    model, at = {}, 0
    for name, shape in shapes(own).items():
        end = at + int(np.prod(shape))
        model[name] = flat[at:end].reshape(shape)
        at = end
    return model


def start(own: int) -> np.ndarray:
    """The weights that every copy starts from."""
    draw = np.random.default_rng(5)
    return np.concatenate([draw.normal(0, 0.1, int(np.prod(s))).astype(np.float32) for s in shapes(own).values()])


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_total(docs: DataFrame) -> int:
    """How many words all rows of docs (text) have."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(len((text.as_py() or "").encode().split()) for batch in batches for text in batch.column(0))
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return docs.select("text").mapInArrow(each, "n long").agg(F.sum("n")).first()[0] or 0


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all rows of docs (text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        held = 0
        for batch in batches:
            for text in batch.column(0):
                words = _words(text.as_py())
                seen.update(words)
                held += len(words)
                if held >= _BLOCK:
                    yield from told(seen)
                    seen.clear()
                    held = 0
        yield from told(seen)

    def told(seen: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        table = pa.table({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})
        yield from table.to_batches(max_chunksize=1 << 16)

    return docs.select("text").mapInArrow(each, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """own: the words with numbers, by falling count. shares: log P(word | other) of the further words that are listed.

    letters: log P(byte | context) in all words that are not listed, as far as bytes follow a context, which _contexts
    tells. rest: log P(not listed | other).
    """

    own: list[bytes]
    shares: dict[bytes, float]
    letters: np.ndarray
    rest: float


def vocabulary(counts: DataFrame, total: int) -> Vocabulary:
    known = listed(total)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, after = np.zeros(1 << 16, np.int64), np.zeros(CONTEXTS << 8, np.int64)
        rest = 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            often = n >= known
            yield pa.RecordBatch.from_pydict({"word": batch.column(0).filter(pa.array(often)), "place": np.full(often.sum(), -1), "n": n[often]})
            others = batch.column(0).filter(pa.array(~often)).to_pylist()
            if others:
                codes, lengths = _joined(others)
                # times a letter was seen; exact, since counts are below 2^53
                times = np.repeat(n[~often], lengths + 1).astype(np.float64)
                pairs += np.bincount(_pairs(codes), times, len(pairs)).astype(np.int64)
                after += np.bincount(_contexts(codes), times, len(after)).astype(np.int64)
                rest += int(n[~often].sum())
        seen = np.concatenate([pairs, after, [rest]])
        place = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"word": pa.nulls(len(place), pa.binary()), "place": place, "n": seen[place]})

    rows = settled(counts.mapInArrow(each, "word binary, place long, n long"))
    words = rows.where("place < 0").select("word", "n").orderBy(F.desc("n"), "word").toArrow()
    seen = np.zeros((1 << 16) + (CONTEXTS << 8) + 1)
    held = rows.where("place >= 0").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    seen[held["place"].to_numpy()] = held["n"].to_numpy()
    pairs, after = seen[: 1 << 16].reshape(256, 256) + 1, seen[1 << 16 : -1].reshape(CONTEXTS, 256)
    pairs /= pairs.sum(axis=1, keepdims=True)
    # what a context leaves open follows its last byte
    after = after + PRIOR * pairs[np.arange(CONTEXTS) & 255]
    letters = np.log(after / after.sum(axis=1, keepdims=True)).astype(np.float32)
    n = words["n"].to_numpy()
    names, own = words["word"].to_pylist(), int((n >= least(total)).sum())
    others = float(n[own:].sum() + seen[-1])
    shares = {word: math.log(k / others) for word, k in zip(names[own:], n[own:].tolist(), strict=True)}
    return Vocabulary(names[:own], shares, letters.ravel(), math.log(max(seen[-1], 1) / max(others, 1)))


def _joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words with blanks around each, and their lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8), lengths


def _pairs(codes: np.ndarray) -> np.ndarray:
    return codes[:-1].astype(np.int32) * 256 + codes[1:]


def _contexts(codes: np.ndarray) -> np.ndarray:
    """For each byte after the first: 256 times its context, and the byte.

    A context is the byte before, in the low eight bits, and a hash of the one before that inside the word.
    """
    last, earlier = codes[:-1].astype(np.int32), np.concatenate(([32], codes[:-2])).astype(np.int32)
    earlier[last == 32] = 32
    mixed = (earlier * 40_503 >> 3) % (CONTEXTS >> 8)
    return ((mixed << 8 | last) << 8) + codes[1:]


def _lists(values: pa.Array, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)


def numbered(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """(ids, lengths, shares, numbers) in pieces of whole texts of docs (doc_id, text).

    numbers: those of their words, as neighbours; shares: per text, the sum of log P(word | other) of its other words.
    """
    own, shares, letters, rest = known.own, known.shares, known.letters, known.rest

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {word: place for place, word in enumerate([*own, *shares])}
        hashed = [len(own) + zlib.crc32(word) % BUCKETS for word in shares]
        number_of = np.array([*range(len(own)), *hashed, 0], np.int32)
        share_of = np.array([0.0] * len(own) + [*shares.values(), rest])  # the last is for words without a place
        for batch in batches:
            first, held, texts = 0, 0, []
            for row, text in enumerate(batch.column(1)):
                texts.append(_words(text.as_py()))
                held += len(texts[-1])
                if held >= _PIECE or row + 1 == batch.num_rows:
                    yield piece(batch.column(0)[first : row + 1], texts, of, number_of, share_of)
                    first, held, texts = row + 1, 0, []

    def piece(ids: pa.Array, texts: list[list[bytes]], of: dict[bytes, int], number_of: np.ndarray, share_of: np.ndarray) -> pa.RecordBatch:
        words = list(chain.from_iterable(texts))
        place = np.fromiter(map(of.get, words, repeat(-1)), np.int32, len(words))
        numbers, chance = number_of[place], share_of[place]
        spelled = np.flatnonzero(place < 0)
        if len(spelled):
            found = [words[i] for i in spelled.tolist()]
            numbers[spelled] = len(own) + np.fromiter(map(zlib.crc32, found), np.int64, len(found)) % BUCKETS
            codes, lengths = _joined(found)
            starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
            chance[spelled] += np.add.reduceat(letters[_contexts(codes)], starts, dtype=np.float64)
        length = np.fromiter(map(len, texts), np.int32, len(texts))
        ends, total = np.cumsum(length, dtype=np.int64), np.concatenate(([0.0], np.cumsum(chance)))
        one = np.array([0, len(texts)])
        columns = [_lists(ids, one), _lists(pa.array(length), one), _lists(pa.array(total[ends] - total[ends - length]), one)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([zlib.compress(numbers.tobytes(), 1)])], names=["ids", "lengths", "shares", "numbers"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(each, f"ids array<{kind}>, lengths array<int>, shares array<double>, numbers binary")


def _windows(packed: pa.Scalar, lengths: pa.Scalar, own: int, turn: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(windows, targets) of a piece: the numbers around each word, and what is to be predicted; only of a turn's words.

    Between texts lies a number of none.
    """
    numbers, length = np.frombuffer(zlib.decompress(packed.as_py()), np.int32), lengths.values.to_numpy()
    flat = np.full(len(numbers) + REACH * (len(length) + 1), own + BUCKETS, np.int32)
    centres = np.arange(len(numbers)) + REACH * (np.repeat(np.arange(len(length)), length) + 1)
    flat[centres] = numbers
    chosen = slice(turn, None, ROUNDS) if turn is not None else slice(None)
    around = np.array([o for o in range(-REACH, REACH + 1) if o])
    return flat[centres[chosen][None] + around[:, None]], np.minimum(numbers[chosen], own)


def _softmax(values: np.ndarray) -> np.ndarray:
    """Softmax by row, in place: large arrays of their own would cost more than the arithmetic."""
    values -= values.max(axis=1, keepdims=True)
    np.exp(values, out=values)
    values /= _row_sums(values)[:, None]
    return values


def _row_sums(values: np.ndarray) -> np.ndarray:
    return values @ np.ones(values.shape[1], values.dtype)


def step(model: Model, squares: Model, windows: np.ndarray, targets: np.ndarray) -> float:
    """One step of Adagrad on a batch; the batch's mean log-probability before it."""
    n, side = len(targets), len(model["words"])
    order = np.argsort(targets % side, kind="stable")  # by class
    windows, targets = windows[:, order], targets[order]
    kind, place, every = targets % side, targets // side, np.arange(n)
    near = model["embedding"][windows.T].reshape(n, -1)  # (n, places x width)
    places = model["places"].reshape(-1, HIDDEN)
    hidden = near @ places
    hidden += model["bias"]
    np.tanh(hidden, out=hidden)
    logits = hidden @ model["classes"]
    logits += model["class_bias"]
    off_class = _softmax(logits)
    score = np.log(off_class[every, kind]).sum()
    off_class[every, kind] -= 1
    back = off_class @ model["classes"].T
    edges = np.searchsorted(kind, np.arange(side + 1)).tolist()
    for c, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if b > a:
            mine, weights, at = hidden[a:b], model["words"][c], place[a:b]
            logits = mine @ weights
            logits += model["word_bias"][c]
            off = _softmax(logits)
            score += np.log(off[every[: b - a], at]).sum()
            off[every[: b - a], at] -= 1
            back[a:b] += off @ weights.T
            _learn(weights, squares["words"][c], mine.T @ off, n)
            _learn(model["word_bias"][c], squares["word_bias"][c], off.sum(axis=0), n)
    back *= 1 - hidden**2
    below = (back @ places.T).reshape(-1, WIDTH)  # one row for each neighbour
    _learn(model["classes"], squares["classes"], hidden.T @ off_class, n)
    _learn(model["class_bias"], squares["class_bias"], off_class.sum(axis=0), n)
    _learn(model["bias"], squares["bias"], back.sum(axis=0), n)
    _learn(model["places"], squares["places"], (near.T @ back).reshape(model["places"].shape), n)
    neighbours = windows.T.ravel()
    order = np.argsort(neighbours, kind="stable")
    neighbours = neighbours[order]
    first = np.flatnonzero(np.concatenate(([True], neighbours[1:] != neighbours[:-1])))
    rows, slope = neighbours[first], np.add.reduceat(below[order], first, axis=0) / n
    held = squares["embedding"][rows] + slope * slope
    squares["embedding"][rows] = held
    model["embedding"][rows] -= RATE * slope / (np.sqrt(held) + 1e-6)
    return float(score) / n


def _learn(weights: np.ndarray, squares: np.ndarray, slope: np.ndarray, n: int) -> None:
    slope /= n
    squares += slope * slope
    weights -= RATE * slope / (np.sqrt(squares) + 1e-6)


def log_chances(model: Model, windows: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """log P(target | window) for each word, in parts whose arrays stay small."""
    tables = [model["embedding"] @ model["places"][k] for k in range(2 * REACH)]
    # hidden lies within -1 and 1: with small weights no exponential overflows, and no maximum needs to be taken out
    most = max(float(np.abs(model["classes"]).sum(axis=0).max()), float(np.abs(model["words"]).sum(axis=1).max()))
    log_total = _log_total if most + max(map(float, (np.abs(model[b]).max() for b in ("class_bias", "word_bias")))) > 60 else _log_small
    parts = [slice(at, at + _PART) for at in range(0, len(targets), _PART)]
    return np.concatenate([np.zeros(0, np.float32), *(_part_chances(model, tables, windows[:, p], targets[p], log_total) for p in parts)])


def _part_chances(model: Model, tables: list[np.ndarray], windows: np.ndarray, targets: np.ndarray, log_total: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    hidden = tables[0][windows[0]]
    hidden += model["bias"]
    for table, numbers in zip(tables[1:], windows[1:], strict=True):
        hidden += table[numbers]
    np.tanh(hidden, out=hidden)
    side = len(model["words"])
    kind, place, every = targets % side, targets // side, np.arange(len(targets))
    logits = hidden @ model["classes"]
    logits += model["class_bias"]
    out = logits[every, kind]
    out -= log_total(logits)
    order = np.argsort(kind, kind="stable")
    edges = np.searchsorted(kind[order], np.arange(side + 1))
    for c, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if b > a:
            mine = order[a:b]
            logits = hidden[mine] @ model["words"][c]
            logits += model["word_bias"][c]
            out[mine] += logits[np.arange(b - a), place[mine]]
            out[mine] -= log_total(logits)
    return out


def _log_total(logits: np.ndarray) -> np.ndarray:
    top = logits.max(axis=1)
    logits -= top[:, None]
    return top + np.log(_row_sums(np.exp(logits, out=logits)))


def _log_small(logits: np.ndarray) -> np.ndarray:
    return np.log(_row_sums(np.exp(logits, out=logits)))


def train(pieces: DataFrame, own: int, total: int) -> np.ndarray:
    """What the partitions of pieces learn from every word, in ROUNDS rounds from their average on."""
    both = np.concatenate((start(own), np.full(len(start(own)), 1e-3, np.float32)))
    half, size = len(both) // 2, batch_size(total)

    def one(turn: int, both: np.ndarray) -> np.ndarray:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine, seen = both.copy(), 0
            model, squares = _shaped(mine[:half], own), _shaped(mine[half:], own)
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def learn() -> None:
                windows, targets = (np.concatenate(x, axis=-1) for x in zip(*held, strict=True))
                held.clear()
                shuffled = np.random.default_rng(len(targets)).permutation(len(targets))
                for part in np.array_split(shuffled, max(1, round(len(shuffled) / size))):
                    if len(part):
                        step(model, squares, windows[:, part], targets[part])

            for batch in batches:
                for lengths, numbers in zip(*batch.columns, strict=True):
                    held.append(_windows(numbers, lengths, own, turn))
                    seen += len(held[-1][1])
                    if sum(len(t) for _, t in held) >= 4 * size:  # small pieces learn together, in whole batches
                        learn()
            if held:
                learn()
            if seen:
                places = list(range(0, len(mine), _SLICE))
                slices = pa.array([mine[p : p + _SLICE].tobytes() for p in places], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array([seen] * len(places), pa.int64()), slices], names=["place", "n", "weights"])

        def mean(key: tuple[pa.Scalar, ...], copies: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = 0.0, 0
            for batch in copies:
                for weights, seen in zip(batch["weights"], batch["n"], strict=True):
                    total, n = total + np.frombuffer(weights.as_py(), np.float32).astype(np.float64) * seen.as_py(), n + seen.as_py()
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([(total / n).astype(np.float32).tobytes()])], names=["place", "weights"])

        learnt = pieces.select("lengths", "numbers").mapInArrow(each, "place long, n long, weights binary")
        rows = learnt.groupBy("place").applyInArrow(mean, "place long, weights binary").collect()  # one model
        return np.concatenate([np.frombuffer(r["weights"], np.float32) for r in sorted(rows)]) if rows else both

    for turn in range(ROUNDS):
        both = one(turn, both)
    return both[:half]


def scored(pieces: DataFrame, own: int, flat: np.ndarray) -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean_log_likelihood) of the texts in pieces, by a model's weights."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _shaped(flat, own)
        for batch in batches:
            sums = [np.zeros(0)]
            for lengths, numbers in zip(batch.column(1), batch.column(3), strict=True):
                windows, targets = _windows(numbers, lengths, own)
                chances = np.concatenate(([0.0], np.cumsum(log_chances(model, windows, targets), dtype=np.float64))) if len(targets) else np.zeros(1)
                length = lengths.values.to_numpy()
                ends = np.cumsum(length)
                sums.append(chances[ends] - chances[ends - length])
            n, total = batch.column(1).flatten().to_numpy(), np.concatenate(sums) + batch.column(2).flatten().to_numpy()
            mean = pa.array(np.where(n > 0, total / np.maximum(n, 1), 0.0), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).flatten(), pa.array(n.astype(np.int64)), pa.array(total), mean], names=["doc_id", "n_words", "log_likelihood", "mean_log_likelihood"])

    kind = pieces.schema["ids"].dataType.elementType.simpleString()
    return pieces.mapInArrow(each, f"doc_id {kind}, n_words long, log_likelihood double, mean_log_likelihood double")


def fitted(docs: DataFrame) -> tuple[DataFrame, Vocabulary, np.ndarray]:
    """(pieces, vocabulary, weights) from all rows of docs (doc_id, text)."""
    total = word_total(docs)
    known = vocabulary(word_counts(docs), total)
    pieces = settled(numbered(docs, known).repartition(trainers(total)))
    return pieces, known, train(pieces, len(known.own), total)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean_log_likelihood) for every row of docs, by a model trained on all of them.

    Null and empty texts have no words, a sum of 0 and a null mean. Repeated rows count and are scored each; other
    columns are not read. An empty table gives an empty result.
    """
    pieces, known, flat = fitted(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return scored(pieces, len(known.own), flat)
