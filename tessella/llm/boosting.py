"""Gradient-boosted regression trees on binned features, for the logistic loss."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth: a feature and a threshold per inner node, a value per leaf."""

    features: np.ndarray
    thresholds: np.ndarray
    values: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        inner = self.features.shape[1]
        for f, t, v in zip(self.features, self.thresholds, self.values, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - inner]
        return total


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, penalty: float = 1.0) -> Trees:
    """Newton boosting: each split has the largest gain of the binned gradient statistics."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(d)], axis=1) + np.arange(d) * bins
    inner = 2**depth - 1
    features, thresholds, values = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    margin = np.zeros(n)
    for k in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), np.maximum(weight * p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            # All nodes of a level at once: their sums stand side by side.
            at = (binned + ((node - first) * d * bins)[:, None]).ravel()
            gs = np.bincount(at, np.repeat(g, d), width * d * bins).reshape(width, d, bins).cumsum(axis=2)
            hs = np.bincount(at, np.repeat(h, d), width * d * bins).reshape(width, d, bins).cumsum(axis=2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + penalty) + (gt - gs) ** 2 / (ht - hs + penalty) - gt**2 / (ht + penalty)
            gain[:, :, -1] = -1
            for i, best in enumerate(gain.reshape(width, -1).argmax(axis=1).tolist()):
                j, b = divmod(best, bins)
                if gain[i, j, b] > 1e-6 and b < len(cuts[j]):
                    features[k, first + i], thresholds[k, first + i] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), features[k, node]] > thresholds[k, node])
        leaf = node - inner
        values[k] = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + penalty)
        margin += values[k][leaf]
    return Trees(features, thresholds, values)
