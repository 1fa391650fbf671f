"""The feature curve turns a fold's rows into bins once, and begins with its longest fits."""

from test_trees import KEY, same_trees, table

from fairrank.operators import boosting, ml
from fairrank.operators.boosting import Binned, BoostingParams, fit_boosting


def test_shared_bins_give_the_same_model(spark, tmp_path):
    df, p = table(spark), BoostingParams(rounds=4, depth=3)
    shared = Binned(df, list("abcd"), str(tmp_path / "bins"), KEY)
    for k in (2, 3):
        own = fit_boosting(df, list("abcd")[:k], str(tmp_path / f"own{k}"), KEY, params=p)
        got = fit_boosting(df, list("abcd")[:k], str(tmp_path / f"got{k}"), KEY, params=p, binned=shared)
        assert same_trees(own, got) and own.start == got.start
        a, b = (sorted(map(tuple, m.predict_proba(df).select("ProductID", "proba").collect())) for m in (own, got))
        assert a == b


def test_a_fold_is_binned_once(spark, tmp_path, monkeypatch):
    made, begun = [], []
    plain, fit = boosting.binned_rows, ml.fit_model
    monkeypatch.setattr(boosting, "binned_rows", lambda df, features, *a: made.append(list(features)) or plain(df, features, *a))
    monkeypatch.setattr(ml, "fit_model", lambda kind, df, features, **k: begun.append((len(features), k["side_by_side"])) or fit(kind, df, features, **k))
    names, run = [], ml.run_trials
    monkeypatch.setattr(ml, "run_trials", lambda spark, path, trials: names.extend(trials) or run(spark, path, trials))
    curve = ml.topk_feature_curve(table(spark), list("abcd"), ks=[1, 2, 4], folds=2, path=str(tmp_path / "curve"), maxIter=3, maxDepth=2)
    assert sorted(r.k for r in curve.collect()) == [1, 2, 4]
    assert made == [list("abcd")] * 2
    assert sorted(begun) == [(k, 6) for k in (1, 1, 2, 2, 4, 4)]
    assert [n.split(",")[0] for n in names] == ["k=004"] * 2 + ["k=002"] * 2 + ["k=001"] * 2
