"""Trees look at the gradients of a level once, not once per column, and scoring walks no settled rows."""

import numpy as np

from fairrank.operators import boosting
from fairrank.operators.boosting import BoostingParams, Forest


class Counted(np.ndarray):
    """An array that counts how often rows are picked out of it."""

    picked = 0

    def __getitem__(self, key):
        if isinstance(key, np.ndarray):
            Counted.picked += 1
        return super().__getitem__(key)


def test_gradients_are_picked_once_a_level():
    r = np.random.default_rng(5)
    bins = r.integers(0, 64, (2000, 20)).astype(np.uint8)
    g, h = r.normal(size=2000), r.uniform(0.5, 1.5, 2000)
    params, used = BoostingParams(depth=4), r.random(2000) < 0.8
    tree, at = boosting.grow(bins, g, h, used, list(range(20)), params, lambda a: a)
    Counted.picked = 0
    again, _ = boosting.grow(bins, g.view(Counted), h.view(Counted), used, list(range(20)), params, lambda a: a)
    assert Counted.picked <= 2 * (params.depth + 2)
    assert again == tree and len(tree["value"]) > 10
    for leaf in set(at):
        rows = used & (at == leaf)
        assert np.isclose(tree["value"][leaf], -g[rows].sum() / (h[rows].sum() + params.l2), rtol=1e-3, atol=1e-5)


def test_scores_equal_a_walk_of_every_row():
    r = np.random.default_rng(6)
    trees = []
    for _ in range(5):
        # node i has the children 2i + 1 and 2i + 2; some branches end early
        inner = r.random(63) < 0.7
        inner[31:] = False
        trees.append({"feature": np.where(inner, r.integers(0, 4, 63), -1), "threshold": r.normal(size=63),
                      "left": np.where(inner, 2 * np.arange(63) + 1, -1), "right": np.where(inner, 2 * np.arange(63) + 2, -1),
                      "value": r.normal(size=63)})
    trees.append({"feature": [-1], "threshold": [0.0], "left": [-1], "right": [-1], "value": [0.5]})
    x = r.normal(size=(300, 4))
    x[r.random(x.shape) < 0.1] = np.nan

    def walk(t, row):
        node = 0
        while t["feature"][node] >= 0:
            node = t["left" if row[t["feature"][node]] <= t["threshold"][node] else "right"][node]
        return t["value"][node]
    assert np.array_equal(Forest(trees).total(x), [sum(walk(t, row) for t in trees) for row in x])
    assert np.array_equal(Forest(trees).total(np.asfortranarray(x)), Forest(trees).total(x))
    assert len(Forest(trees).total(x[:0])) == 0
