"""Gradient-boosted regression trees on the logistic loss, in numpy. Every tree has the same depth, so that a batch of
rows walks all trees with a few array operations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """feature and cut of the inner nodes, (trees, 2^depth - 1), in heap order; value of the leaves, (trees, 2^depth)."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    bias: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The log-odds of each row."""
        total = np.full(len(rows), self.bias)
        depth, inner, every = self.value.shape[1].bit_length() - 1, self.feature.shape[1], np.arange(len(rows))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (rows[every, feature[node]] > cut[node])
            total += value[node - inner]
        return total


def fit(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.25) -> Trees:
    """Greedy trees over at most 32 cuts a feature, each fitted to the gradient of what the ones before leave."""
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, 33)[1:-1])) for column in rows.T]
    places = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, rows.T, strict=True)])
    share = np.average(labels, weights=weights)
    bias = float(np.log(share / (1 - share)))
    score = np.full(len(rows), bias)
    inner, features, limits, values = (1 << depth) - 1, [], [], []
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-score))
        slope, curve = weights * (labels - chance), weights * chance * (1 - chance)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(rows), np.int64)
        for at in range(inner):
            here = np.flatnonzero(node == at)
            if len(here):
                feature[at], cut[at] = _best(places[:, here], cuts, slope[here], curve[here])
            node[here] = 2 * at + 1 + (rows[here, feature[at]] > cut[at])
        leaf = node - inner
        g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, curve, inner + 1)
        value = rate * g / (h + 1.0)
        score += value[leaf]
        features.append(feature), limits.append(cut), values.append(value)
    return Trees(np.array(features), np.array(limits), np.array(values), bias)


def _best(places: np.ndarray, cuts: list[np.ndarray], slope: np.ndarray, curve: np.ndarray) -> tuple[int, float]:
    """The feature and cut that gain most; a cut at infinity where none gains."""
    best, feature, cut = 1e-6, 0, np.inf
    g, h = slope.sum(), curve.sum()
    for f, limits in enumerate(cuts):
        if not len(limits):
            continue
        left = np.cumsum(np.bincount(places[f], slope, len(limits) + 1))[:-1]
        less = np.cumsum(np.bincount(places[f], curve, len(limits) + 1))[:-1]
        gain = left**2 / (less + 1) + (g - left) ** 2 / (h - less + 1) - g**2 / (h + 1)
        k = int(gain.argmax())
        if gain[k] > best:
            best, feature, cut = float(gain[k]), f, float(limits[k])
    return feature, cut
