"""Gradient-boosted regression trees for a binary label, on histograms, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, ``trees`` full binary trees of ``depth`` levels; features are cut at up to ``bins`` quantiles."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 2.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, d = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        code = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(d)], axis=1)
        mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = float(np.log(mean / (1 - mean)))
        margin = np.full(n, self.base)
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.feature = np.zeros((self.trees, inner), np.int64)
        self.cut = np.full((self.trees, inner), np.inf)
        self.leaf = np.zeros((self.trees, leaves))
        offset = np.arange(d) * self.bins
        for t in range(self.trees):
            p = 1.0 / (1.0 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                width = 2**level
                at = (node[:, None] * d * self.bins + offset + code).ravel()
                g = np.bincount(at, np.repeat(grad, d), width * d * self.bins).reshape(width, d, self.bins).cumsum(2)
                h = np.bincount(at, np.repeat(hess, d), width * d * self.bins).reshape(width, d, self.bins).cumsum(2)
                gt, ht = g[:, :, -1:], h[:, :, -1:]
                gain = g**2 / (h + self.ridge) + (gt - g) ** 2 / (ht - h + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(h < 0.5) | (ht - h < 0.5)] = 0
                best = gain.reshape(width, -1).argmax(1)
                for k in range(width):
                    j, b = divmod(int(best[k]), self.bins)
                    if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                        self.feature[t, width - 1 + k], self.cut[t, width - 1 + k] = j, cuts[j][b]
                here = width - 1 + node
                node = node * 2 + (x[np.arange(n), self.feature[t, here]] > self.cut[t, here])
            g, h = np.bincount(node, grad, leaves), np.bincount(node, hess, leaves)
            self.leaf[t] = self.rate * g / (h + self.ridge)
            margin += self.leaf[t, node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                here = 2**level - 1 + node
                node = node * 2 + (x[rows, self.feature[t, here]] > self.cut[t, here])
            out += self.leaf[t, node]
        return out
