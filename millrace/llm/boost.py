"""Gradient-boosted trees for a yes-or-no label, small enough to be fitted where a query is planned."""

from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    """Complete trees of one depth, over features compared with thresholds."""

    def __init__(self, depth: int, base: float):
        self.depth, self.base = depth, base
        self.feature: list[np.ndarray] = []
        self.threshold: list[np.ndarray] = []
        self.value: list[np.ndarray] = []

    def odds(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of yes for each row."""
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += value[at - (2**self.depth - 1)]
        return total


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, smooth: float = 1.0) -> Trees:
    """Trees that minimise the logistic loss by Newton steps; features are cut at quantiles.

    Deterministic: no rows or features are drawn at random, and ties go to the first feature.
    """
    x = np.asarray(x, np.float64)
    y = np.asarray(y, np.float64)
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)], 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(depth, float(np.log(share / (1 - share))))
    f = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            n, first = 2**level, 2**level - 1
            best, where = np.full(n, 1e-6), np.full((n, 2), -1)
            for j in range(x.shape[1]):
                if not len(cuts[j]):
                    continue
                cell = (at - first) * (BINS + 1) + binned[:, j]
                left_g = np.bincount(cell, g, n * (BINS + 1)).reshape(n, -1).cumsum(1)
                left_h = np.bincount(cell, h, n * (BINS + 1)).reshape(n, -1).cumsum(1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                gain = left_g**2 / (left_h + smooth) + (all_g - left_g) ** 2 / (all_h - left_h + smooth) - all_g**2 / (all_h + smooth)
                cut = gain[:, : len(cuts[j])].argmax(1)
                top = gain[np.arange(n), cut]
                better = top > best + 1e-9
                best[better] = top[better]
                where[better] = np.stack([np.full(n, j), cut], 1)[better]
            for k in range(n):
                if where[k, 0] >= 0:
                    feature[first + k] = where[k, 0]
                    threshold[first + k] = cuts[where[k, 0]][where[k, 1]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf = at - (2**depth - 1)
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + smooth)
        f += value[leaf]
        model.feature.append(feature)
        model.threshold.append(threshold)
        model.value.append(value)
    return model
