"""Gradient boosted regression trees in NumPy (second-order, regularised; Chen and Guestrin 2016).

Exact splits on sorted columns, squared error, L2 weight 1 on leaves, row and column sampling per tree. Trees of one
model are stored level by level, so that a single row runs through all of them at once; that is what recursion needs.
"""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, depth: int = 3, rate: float = 0.05, trees: int = 200, rows: float = 0.8, columns: float = 0.8, ridge: float = 1.0, seed: int = 0):
        self.depth, self.rate, self.trees, self.rows, self.columns, self.ridge, self.seed = depth, rate, trees, rows, columns, ridge, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        random, (n, width) = np.random.default_rng(self.seed), x.shape
        self.base = float(y.mean())
        nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.zeros((self.trees, nodes), dtype=np.int64)
        self.cut = np.full((self.trees, nodes), np.inf)
        self.leaf = np.zeros((self.trees, nodes))
        self.gain = np.zeros(width)
        order, total = np.argsort(x, axis=0, kind="stable"), np.full(n, self.base)
        for t in range(self.trees):
            mine = np.zeros(n, dtype=bool)
            mine[random.permutation(n)[: max(1, round(self.rows * n))]] = True
            some = np.sort(random.permutation(width)[: max(1, round(self.columns * width))])
            g = total - y
            node = np.zeros(n, dtype=np.int64)
            for at in range(nodes):
                inside = mine & (node == at)
                count = int(inside.sum())
                if not count:
                    continue
                G = float(g[inside].sum())
                self.leaf[t, at] = -self.rate * G / (count + self.ridge)
                if 2 * at + 2 >= nodes or count < 2:
                    continue
                rank = order[:, some]
                keep = inside[rank]
                rank = rank.T[keep.T].reshape(len(some), count).T
                values, left = np.take_along_axis(x[:, some], rank, 0), np.cumsum(g[rank], axis=0)[:-1]
                sizes = np.arange(1, count)[:, None]
                gain = left**2 / (sizes + self.ridge) + (G - left) ** 2 / (count - sizes + self.ridge) - G**2 / (count + self.ridge)
                gain[values[1:] == values[:-1]] = -np.inf
                best = int(np.argmax(gain.T))
                column, row = divmod(best, count - 1)
                if gain[row, column] <= 1e-12:
                    continue
                f = int(some[column])
                self.gain[f] += gain[row, column]
                self.feature[t, at], self.cut[t, at] = f, (values[row, column] + values[row + 1, column]) / 2
                here = node == at
                node[here] = np.where(x[here, f] < self.cut[t, at], 2 * at + 1, 2 * at + 2)
            # Rows stop where a node was not split; leaves of the whole tree are found the same way as in prediction.
            total += self._one(t, x)
        return self

    def _one(self, t: int, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            split = np.isfinite(self.cut[t, at])
            at = np.where(split, np.where(x[np.arange(len(x)), self.feature[t, at]] < self.cut[t, at], 2 * at + 1, 2 * at + 2), at)
        return self.leaf[t, at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array([self.row(r) for r in x]) if len(x) < 8 else self.base + sum(self._one(t, x) for t in range(self.trees))

    def row(self, x: np.ndarray) -> float:
        at, every = np.zeros(self.trees, dtype=np.int64), np.arange(self.trees)
        for _ in range(self.depth):
            cut = self.cut[every, at]
            at = np.where(np.isfinite(cut), np.where(x[self.feature[every, at]] < cut, 2 * at + 1, 2 * at + 2), at)
        return self.base + float(self.leaf[every, at].sum())
