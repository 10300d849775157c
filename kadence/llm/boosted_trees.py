"""Gradient-boosted trees for two classes, in numpy: binned features, second-order gains, level-wise growth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32
TREES, DEPTH, RATE = 60, 4, 0.2
#: Weight on the squared leaf values, and the least sum of second derivatives in a leaf.
RIDGE, LEAST = 1.0, 2.0


@dataclass(frozen=True)
class BoostedTrees:
    """Complete trees of equal depth: per tree the features and thresholds of inner nodes and the leaf values."""

    base: float
    features: np.ndarray  # trees x (2**depth - 1)
    thresholds: np.ndarray
    leaves: np.ndarray  # trees x 2**depth

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaves.shape[1])) if len(self.leaves) else 0
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - (2**depth - 1)]
        return total


def _gain(gs: np.ndarray, hs: np.ndarray, g: float, h: float) -> np.ndarray:
    """Gains of splits whose left sides sum up to ``gs`` and ``hs``; zero where a side is too light."""
    gain = gs**2 / (hs + RIDGE) + (g - gs) ** 2 / (h - hs + RIDGE) - g**2 / (h + RIDGE)
    return np.where((hs < LEAST) | (h - hs < LEAST), 0.0, gain)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> BoostedTrees:
    """Trees for labels 0/1. With one label only, the constant model."""
    share = float(np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    n, m = x.shape
    if n == 0 or y.min() == y.max():
        return BoostedTrees(base, np.zeros((0, 2**DEPTH - 1), int), np.zeros((0, 2**DEPTH - 1)), np.zeros((0, 2**DEPTH)))
    flags = np.array([bool(np.isin(x[:, j], (0, 1)).all()) for j in range(m)], bool)
    flag_at, number_at = np.flatnonzero(flags), np.flatnonzero(~flags)
    flagged = x[:, flag_at].astype(np.float32)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in number_at]
    binned = [np.searchsorted(e, x[:, j], "left") for e, j in zip(edges, number_at, strict=True)]
    rows = np.arange(n)
    margin = np.full(n, base)
    features, thresholds, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        both = np.stack([g, h], 1).astype(np.float32)
        at = np.zeros(n, np.int64)
        feature, threshold = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            inner = at - first
            totals = np.stack([np.bincount(inner, g, width), np.bincount(inner, h, width)], 1)
            for k in range(width):  # flags: what rows with the flag sum up to is one product
                inside = inner == k
                with_flag = flagged[inside].T @ both[inside]
                gain = _gain(totals[k, 0] - with_flag[:, 0], totals[k, 1] - with_flag[:, 1], totals[k, 0], totals[k, 1])
                if len(gain) and gain.max() > 1e-6:
                    feature[first + k], threshold[first + k] = flag_at[gain.argmax()], 0.5
                best = max(1e-6, gain.max()) if len(gain) else 1e-6
                for j, bins, edge in zip(number_at, binned, edges, strict=True):
                    if not len(edge):
                        continue
                    gs = np.bincount(bins[inside], g[inside], BINS).cumsum()
                    hs = np.bincount(bins[inside], h[inside], BINS).cumsum()
                    gain = _gain(gs, hs, totals[k, 0], totals[k, 1])[: len(edge)]
                    if gain.max() > best:
                        best = gain.max()
                        feature[first + k], threshold[first + k] = j, edge[gain.argmax()]
            at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
        leaf = at - (2**DEPTH - 1)
        values = -RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + RIDGE)
        margin = margin + values[leaf]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(values)
    return BoostedTrees(base, np.array(features), np.array(thresholds), np.array(leaves))
