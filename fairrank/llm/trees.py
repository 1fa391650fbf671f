"""Gradient-boosted regression trees for 0/1 labels, on binned features."""

from __future__ import annotations

import numpy as np

TREES, DEPTH, STEP, BINS, RIDGE, MIN_ROWS = 40, 4, 0.25, 32, 1.0, 10


class BoostedTrees:
    """Complete binary trees stored as arrays: node k has children 2 k + 1 and 2 k + 2."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(x.shape[1])]
        bins = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1)
        rate = (y.sum() + 0.5) / (len(y) + 1.0)
        self.base = float(np.log(rate / (1 - rate)))
        f = np.full(len(y), self.base)
        inner = 2 ** DEPTH - 1
        self.feature = np.zeros((TREES, inner), np.int32)
        self.cut = np.full((TREES, inner), np.inf)  # x < cut goes left; an unsplit node sends all left
        self.leaf = np.zeros((TREES, 2 ** DEPTH))
        for t in range(TREES):
            p = 1.0 / (1.0 + np.exp(-f))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for k in range(inner):
                rows = np.flatnonzero(node == k)
                if len(rows) >= 2 * MIN_ROWS:
                    j, b = self._best(bins[rows], g[rows], h[rows], edges)
                    if j >= 0:
                        self.feature[t, k], self.cut[t, k] = j, edges[j][b]
                node[rows] = 2 * k + 1 + (x[rows, self.feature[t, k]] >= self.cut[t, k])
            at = node - inner
            self.leaf[t] = -STEP * np.bincount(at, g, 2 ** DEPTH) / (np.bincount(at, h, 2 ** DEPTH) + RIDGE)
            f += self.leaf[t][at]
        return self

    @staticmethod
    def _best(bins, g, h, edges):
        best, total_g, total_h = (1e-6, -1, 0), g.sum(), h.sum()
        for j, e in enumerate(edges):
            if not len(e):
                continue
            n = len(e) + 1
            cg, ch = np.cumsum(np.bincount(bins[:, j], g, n))[:-1], np.cumsum(np.bincount(bins[:, j], h, n))[:-1]
            cn = np.cumsum(np.bincount(bins[:, j], minlength=n))[:-1]
            gain = cg ** 2 / (ch + RIDGE) + (total_g - cg) ** 2 / (total_h - ch + RIDGE) - total_g ** 2 / (total_h + RIDGE)
            gain[(cn < MIN_ROWS) | (len(g) - cn < MIN_ROWS)] = 0.0
            b = int(np.argmax(gain))
            if gain[b] > best[0]:
                best = (float(gain[b]), j, b)
        return best[1], best[2]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] >= cut[node])
            f += leaf[node - len(feature)]
        return f
