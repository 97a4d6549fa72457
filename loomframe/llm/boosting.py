"""Gradient boosting of small regression trees on the logistic loss; plain arrays, trained on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 16


@dataclass
class BoostedTrees:
    """Complete trees of one depth: feature and border of each inner node, value of each leaf."""

    depth: int
    base: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    borders: list[np.ndarray] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, border, value in zip(self.features, self.borders, self.values, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > border[node])
            out += value[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> BoostedTrees:
    """Second-order boosting over quantile bins."""
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    model = BoostedTrees(depth, float(np.log(mean / (1 - mean))))
    if not len(y):
        return model
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)])
    score = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p) + 1e-6
        feature, border = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                at = np.flatnonzero(node == k)
                best = 1e-9
                for f, c in enumerate(cuts):
                    if not len(at) or not len(c):
                        continue
                    g = np.cumsum(np.bincount(binned[at, f], grad[at], len(c) + 1))
                    h = np.cumsum(np.bincount(binned[at, f], hess[at], len(c) + 1))
                    gain = g[:-1] ** 2 / (h[:-1] + ridge) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + ridge) - g[-1] ** 2 / (h[-1] + ridge)
                    if gain.max() > best:
                        best, feature[k], border[k] = gain.max(), f, c[int(gain.argmax())]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > border[node])
        leaf = node - (2**depth - 1)
        value = -rate * np.bincount(leaf, grad, 2**depth) / (np.bincount(leaf, hess, 2**depth) + ridge)
        model.features.append(feature), model.borders.append(border), model.values.append(value)
        score += value[leaf]
    return model
