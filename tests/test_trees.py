"""Own growers of trees: exact splits, resumed fits, several tasks, forests and their fallback."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairrank.operators import boosting, forest, ml
from fairrank.operators.boosting import BoostingParams, fit_boosting

KEY = ["ClientID", "ProductID"]


def table(spark, n=3000, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 4)).round(2)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)) | (x[:, 2] > 1.5)
    rows = [(int(i % 97), int(i), int(v), *[float(c) for c in a[:3]], float(a[3]) if i % 9 else None) for i, (a, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "ClientID long, ProductID long, label int, a double, b double, c double, d double")


def same_trees(m, k):
    return len(m.trees) == len(k.trees) and all(np.array_equal(s[c], t[c]) for s, t in zip(m.trees, k.trees) for c in boosting._TREE)


def test_splits_against_every_cut():
    r = np.random.default_rng(0)
    params = BoostingParams(depth=2, l2=0.5)
    bins = r.integers(0, 6, (200, 3)).astype(np.uint8)
    g, h = r.normal(size=200), r.uniform(0.5, 1.5, 200)
    used = r.random(200) < 0.8
    tree, at = boosting.grow(bins, g, h, used, [0, 2], params, lambda a: a)

    def best(rows):
        def score(m):
            return g[m].sum() ** 2 / (h[m].sum() + params.l2)
        options = [(score(rows & low) + score(rows & ~low) - score(rows), f, b) for f in (0, 2) for b in range(5)
                   for low in [bins[:, f] <= b] if min(h[rows & low].sum(), h[rows & ~low].sum()) >= 1]
        return max(options, key=lambda o: (o[0], -o[1], -o[2]))
    gain, f, b = best(used)
    assert (tree["feature"][0], tree["bin"][0]) == (f, b) and tree["gain"][0] == pytest.approx(gain, rel=1e-4)
    left = tree["left"][0]
    gain, f2, b2 = best(used & (bins[:, f] <= b))
    assert (tree["feature"][left], tree["bin"][left]) == (f2, b2) and tree["gain"][left] == pytest.approx(gain, rel=1e-4)
    for leaf in set(at):
        rows = used & (at == leaf)
        assert tree["value"][leaf] == pytest.approx(-g[rows].sum() / (h[rows].sum() + params.l2), rel=1e-4)


def test_resumed_fit_ends_with_equal_trees(spark, tmp_path):
    df, p = table(spark), BoostingParams(rounds=13, depth=4, step_rounds=5, step_size=0.3)
    whole = fit_boosting(df, list("abcd"), str(tmp_path / "whole"), KEY, params=p)
    half = fit_boosting(df, list("abcd"), str(tmp_path / "parts"), KEY, params=p, stop_after=1)
    assert len(half.trees) == 5 and len(whole.trees) == 13
    # an interrupted step leaves its table behind, but no line in the ledger
    spark.read.parquet(f"{tmp_path}/parts/steps/rounds=000005").limit(3).write.parquet(f"{tmp_path}/parts/steps/rounds=000010")
    assert same_trees(fit_boosting(df, list("abcd"), str(tmp_path / "parts"), KEY, params=p), whole)
    assert same_trees(fit_boosting(df, list("abcd"), str(tmp_path / "parts"), KEY, params=p), whole)
    with pytest.raises(ValueError):
        fit_boosting(df, list("abc"), str(tmp_path / "parts"), KEY, params=p)
    proba = {r.ProductID: (r.label, r.proba) for r in whole.predict_proba(df).collect()}
    assert len(proba) == 3000 and np.mean([(p > 0.5) == y for y, p in proba.values()]) > 0.93
    # margins of the last step are what the model predicts
    last = spark.read.parquet(f"{tmp_path}/whole/steps/rounds=000013").where("id is not null").select("margin")
    assert sorted(1 / (1 + np.exp(-r.margin)) for r in last.collect()) == pytest.approx(sorted(p for _, p in proba.values()))
    whole.save(spark, str(tmp_path / "m"))
    again = boosting.BoostedModel.load(spark, str(tmp_path / "m"))
    assert same_trees(again, whole) and again.start == whole.start
    imp = whole.importances(4)
    assert sum(imp) == pytest.approx(1) and imp[3] < min(imp[:2])


def test_several_tasks_grow_one_tree(spark, tmp_path, monkeypatch):
    df, p = table(spark), BoostingParams(rounds=3, depth=3)
    one = fit_boosting(df, list("abcd"), str(tmp_path / "one"), KEY, params=p)
    monkeypatch.setattr(boosting, "ROWS_PER_TASK", 1000)
    three = fit_boosting(df, list("abcd"), str(tmp_path / "three"), KEY, params=p)
    assert spark.read.parquet(f"{tmp_path}/three/done").first().tasks == 3
    for s, t in zip(one.trees, three.trees):
        assert np.array_equal(s["feature"], t["feature"]) and np.allclose(s["value"], t["value"], rtol=1e-3)


def test_forest(spark, tmp_path, monkeypatch):
    df = table(spark)
    p = forest.ForestParams(trees=20, depth=8)
    m = forest.fit_forest(df, list("abcd"), KEY, params=p)
    assert same_trees(m, forest.fit_forest(df.repartition(3), list("abcd"), KEY, params=p))
    got = m.predict_proba(df).select("label", "proba").collect()
    assert np.mean([(r.proba > 0.5) == r.label for r in got]) > 0.95 and all(0 <= r.proba <= 1 for r in got)
    ml.save_model(m, str(tmp_path / "f"))
    back = ml.load_model(str(tmp_path / "f"))
    assert isinstance(back, forest.ForestModel) and same_trees(back, m)
    # beyond the bound Spark ML grows it
    monkeypatch.setattr(forest, "MAX_TABLE_BYTES", 100)
    big = ml.fit_model("rf", df, list("abcd"), numTrees=3, maxDepth=3)
    assert not isinstance(big, boosting.BoostedModel) and ml.predict_proba(big, df).agg(F.avg("proba")).first()[0] > 0


def test_gini_splits_against_every_cut():
    r = np.random.default_rng(1)
    bins, y, w = r.integers(0, 5, (60, 1)).astype(np.uint8), r.integers(0, 2, 60).astype(float), r.uniform(0.5, 2, 60)
    t = forest.grow_tree(bins, y, w, 7, forest.ForestParams(depth=1))
    c = np.random.default_rng([42, 7]).poisson(1.0, 60)

    def impurity(m):
        ww = (w * c)[m]
        p = (ww * y[m]).sum() / max(ww.sum(), 1e-300)
        return ww.sum() * 2 * p * (1 - p)
    every = np.ones(60, bool)
    cuts = {b: impurity(every) - impurity(bins[:, 0] <= b) - impurity(bins[:, 0] > b) for b in range(4)}
    best = max(cuts, key=cuts.get)
    assert t["bin"][0] == best and t["gain"][0] == pytest.approx(cuts[best])
    low = bins[:, 0] <= best
    assert t["value"][1] == pytest.approx(((w * c)[low] * y[low]).sum() / (w * c)[low].sum())


def test_no_rows(spark, tmp_path):
    with pytest.raises(ValueError):
        fit_boosting(table(spark, 10).where("false"), list("abcd"), str(tmp_path / "none"), KEY)
