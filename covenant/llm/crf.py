"""A linear-chain conditional random field in numpy: training by forward-backward, decoding by Viterbi in batches.

Sequences lie one after another in flat arrays. A step works on all sequences that still have a token there: sorted by
length, these are a prefix, and no padding is needed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Chain:
    """Weights: of features for a token itself, the one before and the one after, (features, states) each, of
    transitions, (states, states), and of first states. State 0 is the one outside of anything."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    steps: np.ndarray
    first: np.ndarray


@dataclass(frozen=True)
class Sequences:
    """Where sequences start in flat arrays, by falling length, and how many have a token at each step."""

    start: np.ndarray
    length: np.ndarray
    active: np.ndarray

    @staticmethod
    def of(start: np.ndarray, length: np.ndarray) -> Sequences:
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        most = int(length[0]) if len(length) else 0
        return Sequences(start, length, np.searchsorted(-length, -np.arange(most), side="left"))


def neighbours(values: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values shifted by one token to either side, zero beyond the ends of sequences."""
    before, after = np.zeros_like(values), np.zeros_like(values)
    before[1:], after[:-1] = values[:-1], values[1:]
    before[start] = 0
    after[start[start > 0] - 1] = 0
    return before, after


def viterbi(scores: np.ndarray, chain: Chain, sequences: Sequences) -> np.ndarray:
    """The likeliest state of every token; scores: (tokens, states)."""
    back = np.zeros(scores.shape, np.int8)
    start, length = sequences.start, sequences.length
    best = np.zeros((len(start), scores.shape[1]), scores.dtype)
    for t, n in enumerate(sequences.active):
        here = start[:n] + t
        if t == 0:
            best[:n] = scores[here] + chain.first
            continue
        options = best[:n, :, None] + chain.steps
        chosen = options.argmax(axis=1)
        back[here] = chosen
        best[:n] = np.take_along_axis(options, chosen[:, None, :], 1)[:, 0] + scores[here]
    states = np.zeros(len(scores), np.int64)
    at = best.argmax(axis=1)
    for t in range(len(sequences.active) - 1, -1, -1):
        n = sequences.active[t]
        here = start[:n] + t
        last = length[:n] - 1 == t
        at[:n] = np.where(last, best[:n].argmax(axis=1), at[:n])
        states[here] = at[:n]
        at[:n] = back[here, at[:n]]
    return states


def margin(chain: Chain) -> float:
    """How much a token outside loses at most by its transitions: if every token of a sequence prefers state 0 by more
    than this, the likeliest path is state 0 throughout, since each token of another path costs more than it gains."""
    gain = max(float(chain.steps.max() - chain.steps[0, 0]), float(chain.first.max() - chain.first[0]), 0.0)
    return 2 * gain


def train(rows: np.ndarray, labels: np.ndarray, starts: np.ndarray, n_features: int, n_states: int, rounds: int = 150, decay: float = 1e-3) -> Chain:
    """Maximum likelihood with decay of weights, by Adam. rows: (tokens, groups) of feature numbers; 0 is no feature."""
    length = np.diff(np.append(starts, len(labels)))
    sequences = Sequences.of(starts, length)
    hot = np.zeros((len(rows), n_features))
    hot[np.arange(len(rows))[:, None], rows] = 1
    hot[:, 0] = 0
    sides = (hot, *neighbours(hot, starts))
    seen = np.zeros((len(labels), n_states))
    seen[np.arange(len(labels)), labels] = 1
    inner = np.ones(len(labels), bool)
    inner[starts] = False
    seen_steps = np.zeros((n_states, n_states))
    np.add.at(seen_steps, (labels[:-1][inner[1:]], labels[1:][inner[1:]]), 1)
    shapes = [(n_features, n_states)] * 3 + [(n_states, n_states), (n_states,)]
    weights = [np.zeros(s) for s in shapes]
    mean, square = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    for i in range(1, rounds + 1):
        own, before, after, steps, first = weights
        scores = sides[0] @ own + sides[1] @ before + sides[2] @ after
        chances, pairs = _chances(scores, steps, first, sequences)
        off = seen - chances
        slopes = [s.T @ off for s in sides] + [seen_steps - pairs, off[starts].sum(axis=0)]
        for w, g, m, v in zip(weights, slopes, mean, square, strict=True):
            g = g / len(starts) - decay * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += 0.15 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return Chain(*(w.astype(np.float32) for w in weights))


def _chances(scores: np.ndarray, steps: np.ndarray, first: np.ndarray, sequences: Sequences) -> tuple[np.ndarray, np.ndarray]:
    """The probability of each state of each token, and the expected number of each transition."""
    start, active, states = sequences.start, sequences.active, scores.shape[1]
    ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
    for t, n in enumerate(active):
        here = start[:n] + t
        ahead[here] = scores[here] + (first if t == 0 else _logsum(ahead[here - 1][:, :, None] + steps, 1))
    for t in range(len(active) - 1, 0, -1):
        here = start[: active[t]] + t
        behind[here - 1] = _logsum(steps + (scores[here] + behind[here])[:, None, :], 2)
    total = np.zeros(len(scores))
    for t, n in enumerate(active):
        total[start[:n] + t] = _logsum(ahead[start[:n]] + behind[start[:n]], 1)
    pairs = np.zeros((states, states))
    for t in range(1, len(active)):
        here = start[: active[t]] + t
        both = ahead[here - 1][:, :, None] + steps + (scores[here] + behind[here])[:, None, :]
        pairs += np.exp(both - total[here][:, None, None]).sum(axis=0)
    return np.exp(ahead + behind - total[:, None]), pairs


def _logsum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.log(np.exp(values - top).sum(axis=axis)) + np.squeeze(top, axis)
