"""Gradient-boosted trees for two classes in numpy: histograms, complete trees of fixed depth."""

from __future__ import annotations

import numpy as np

from .training import sigmoid

BINS = 32


class BoostedTrees:
    def __init__(self, count: int = 60, depth: int = 4, rate: float = 0.25):
        self.count, self.depth, self.rate = count, depth, rate
        self.features = np.zeros((count, 2**depth - 1), np.int64)
        self.thresholds = np.full((count, 2**depth - 1), np.inf, np.float32)
        self.leaves = np.zeros((count, 2**depth), np.float32)
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
        binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1)
        score = np.full(len(y), self.base)
        width = x.shape[1]
        for tree in range(self.count):
            p = sigmoid(score)
            gradient, curvature = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                nodes = 2**level
                cell = ((node[:, None] * width + np.arange(width)) * BINS + binned).ravel()
                sums = [
                    np.bincount(cell, np.repeat(v, width), nodes * width * BINS).reshape(nodes, width, BINS)
                    for v in (gradient, curvature)
                ]
                left = [s.cumsum(axis=2) for s in sums]
                total = [s[:, :, -1:] for s in left]
                gain = sum(g**2 / (h + 1.0) for g, h in ((left[0], left[1]), (total[0] - left[0], total[1] - left[1])))
                gain = gain - total[0] ** 2 / (total[1] + 1.0)
                best = gain[:, :, :-1].reshape(nodes, -1)
                at = best.argmax(axis=1)
                first = nodes - 1
                for n in range(nodes):
                    feature, place = divmod(int(at[n]), BINS - 1)
                    if best[n, at[n]] > 1e-6 and place < len(cuts[feature]):
                        self.features[tree, first + n] = feature
                        self.thresholds[tree, first + n] = cuts[feature][place]
                feature, threshold = self.features[tree, first + node], self.thresholds[tree, first + node]
                node = node * 2 + (x[np.arange(len(x)), feature] > threshold)
            sums = [np.bincount(node, v, 2**self.depth) for v in (gradient, curvature)]
            self.leaves[tree] = self.rate * sums[0] / (sums[1] + 1.0)
            score += self.leaves[tree][node]
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base, np.float32), np.arange(len(x))
        for features, thresholds, leaves in zip(self.features, self.thresholds, self.leaves):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = node * 2 + (x[rows, features[at]] > thresholds[at])
            score += leaves[node]
        return score
