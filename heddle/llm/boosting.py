"""Gradient-boosted regression trees for log loss, in numpy, over binned features."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of fixed depth as arrays; a node without a useful split sends all rows left."""

    def __init__(self, *, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 4.0, smooth: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.smooth = trees, depth, rate, bins, least, smooth

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        rows, columns = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="nearest")) for j in range(columns)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        rate = y.mean()
        self.start = float(np.log(rate / (1 - rate)))
        raw = np.full(rows, self.start)
        inner = 2**self.depth - 1
        self.feature = np.zeros((self.trees, inner), np.int64)
        self.cut = np.full((self.trees, inner), np.inf)
        self.leaf = np.zeros((self.trees, inner + 1))
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            gradient, weight = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(rows, np.int64)
            for level in range(self.depth):
                count, first = 2**level, 2**level - 1
                gains, wheres = np.full(count, 1e-9), [(0, np.inf)] * count
                total_g, total_w = np.bincount(node, gradient, count), np.bincount(node, weight, count)
                for j in range(columns):
                    if not len(edges[j]):
                        continue
                    key = node * (self.bins + 1) + binned[:, j]
                    g = np.cumsum(np.bincount(key, gradient, count * (self.bins + 1)).reshape(count, -1), 1)
                    w = np.cumsum(np.bincount(key, weight, count * (self.bins + 1)).reshape(count, -1), 1)
                    g, w = g[:, : len(edges[j])], w[:, : len(edges[j])]
                    rg, rw = total_g[:, None] - g, total_w[:, None] - w
                    gain = g**2 / (w + self.smooth) + rg**2 / (rw + self.smooth) - (total_g**2 / (total_w + self.smooth))[:, None]
                    gain[(w < self.least / 4) | (rw < self.least / 4)] = 0
                    best = gain.argmax(1)
                    for n in np.flatnonzero(gain[np.arange(count), best] > gains):
                        gains[n], wheres[n] = gain[n, best[n]], (j, edges[j][best[n]])
                for n, (j, cut) in enumerate(wheres):
                    self.feature[t, first + n], self.cut[t, first + n] = j, cut
                at = first + node
                node = node * 2 + (x[np.arange(rows), self.feature[t, at]] > self.cut[t, at])
            g, w = np.bincount(node, gradient, inner + 1), np.bincount(node, weight, inner + 1)
            self.leaf[t] = self.rate * g / (w + self.smooth)
            raw += self.leaf[t, node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = node * 2 + (x[rows, self.feature[t, at]] > self.cut[t, at])
            raw += self.leaf[t, node]
        return 1 / (1 + np.exp(-raw))
