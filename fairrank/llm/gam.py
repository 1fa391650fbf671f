"""A generalised additive model with pairwise interactions.

Features are cut into quantile bins.  Shallow trees are boosted in turn, one feature after the
other with a small step, so that no feature takes over; all trees of a feature add up to one
lookup table over its bins.  Then the pairs of features whose joint grid explains most of what
is left get tables of their own in the same way.  A score is a sum of table entries.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

BINS, GRID = 48, 12
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 60, 8
STEP, RIDGE, MIN_ROWS = 0.1, 1.0, 20


def _leaf(g, h):
    return -g / (h + RIDGE)


def _gain(g, h):
    return g * g / (h + RIDGE)


def _best_cut(g, h, n):
    """Where to cut a line of bins in two: (gain over no cut, bins on the left)."""
    cg, ch, cn = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    if not len(cg):
        return 0.0, 0
    total_g, total_h, total_n = g.sum(), h.sum(), n.sum()
    gain = _gain(cg, ch) + _gain(total_g - cg, total_h - ch) - _gain(total_g, total_h)
    gain[(cn < MIN_ROWS) | (total_n - cn < MIN_ROWS)] = 0.0
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g, h, n, leaves=3):
    """Values per bin of a tree with at most ``leaves`` leaves."""
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = max(((*_best_cut(g[a:z], h[a:z], n[a:z]), a) for a, z in zip(cuts, cuts[1:])), default=(0, 0, 0))
        if best[0] <= 1e-9:
            break
        cuts = sorted([*cuts, best[2] + best[1]])
    out = np.empty(len(g))
    for a, z in zip(cuts, cuts[1:]):
        out[a:z] = _leaf(g[a:z].sum(), h[a:z].sum())
    return out


def _grid_tree(g, h, n):
    """Values per cell: one cut along the first feature, then one along the second on each side;
    or the other way round, whichever gains more.  With the gain."""
    best = (0.0, None)
    for turned in (False, True):
        a, b, c = (g.T, h.T, n.T) if turned else (g, h, n)
        _, k = _best_cut(a.sum(1), b.sum(1), c.sum(1))
        out, gain = np.empty(a.shape), 0.0
        for part in ([slice(0, k), slice(k, None)] if k else [slice(0, None)]):
            pg, ph, pn = a[part].sum(0), b[part].sum(0), c[part].sum(0)
            more, j = _best_cut(pg, ph, pn)
            out[part, :j], out[part, j:] = _leaf(pg[:j].sum(), ph[:j].sum()), _leaf(pg[j:].sum(), ph[j:].sum())
            gain += _gain(pg.sum(), ph.sum()) + more
        if gain > best[0]:
            best = (gain, out.T if turned else out)
    return best


class GAM:
    """``fit`` on a matrix and 0/1 labels; ``score`` gives probabilities of label 1."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> GAM:
        rate = (y.sum() + 0.5) / (len(y) + 1.0)
        self.base = float(np.log(rate / (1 - rate)))
        width = x.shape[1]
        self.edges = [self._quantiles(x[:, j], BINS) for j in range(width)]
        self.coarse = [self._quantiles(x[:, j], GRID) for j in range(width)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if len(y) == 0:
            return self
        bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        f = np.full(len(y), self.base)
        counts = [np.bincount(b, minlength=len(t)).astype(float) for b, t in zip(bins, self.tables)]
        for _ in range(ROUNDS):
            for j in range(width):
                g, h = self._gradients(f, y)
                t = STEP * _tree(np.bincount(bins[j], g, len(self.tables[j])),
                                 np.bincount(bins[j], h, len(self.tables[j])), counts[j])
                self.tables[j] += t
                f += t[bins[j]]
        grids = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.coarse)]
        sides = [len(e) + 1 for e in self.coarse]

        def cells(a, b, values=None):
            return np.bincount(grids[a] * sides[b] + grids[b], values, sides[a] * sides[b]).reshape(
                sides[a], sides[b]).astype(float)

        g, h = self._gradients(f, y)
        gains = sorted(((_grid_tree(cells(a, b, g), cells(a, b, h), cells(a, b))[0], a, b)
                        for a, b in combinations(range(width), 2)), reverse=True)
        chosen = [(a, b, cells(a, b)) for gain, a, b in gains[:PAIRS] if gain > 0]
        tables = [np.zeros((sides[a], sides[b])) for a, b, _ in chosen]
        for _ in range(PAIR_ROUNDS):
            for (a, b, n), table in zip(chosen, tables):
                g, h = self._gradients(f, y)
                _, t = _grid_tree(cells(a, b, g), cells(a, b, h), n)
                if t is not None:
                    table += STEP * t
                    f += STEP * t[grids[a], grids[b]]
        self.pairs = [(a, b, t) for (a, b, _), t in zip(chosen, tables)]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            f += t[np.searchsorted(e, x[:, j], side="right")]
        for a, b, t in self.pairs:
            f += t[np.searchsorted(self.coarse[a], x[:, a], side="right"),
                   np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1.0 / (1.0 + np.exp(-f))

    @staticmethod
    def _quantiles(v: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(v, np.arange(1, bins) / bins)) if len(v) else np.empty(0)

    @staticmethod
    def _gradients(f, y):
        p = 1.0 / (1.0 + np.exp(-f))
        return p - y, p * (1 - p)
