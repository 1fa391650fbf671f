"""Training, search and model-scored lists: weights, selection, round trip, blend."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from fairrank.config import SIGNAL_WEIGHTS
from fairrank.operators import ml, scoring

SF = "/root/testdata/sf0.001"


def _rows(spark, seed, n=240):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x, noise = rnd.gauss(0, 1), rnd.gauss(0, 1)
        rows.append((i % 30, i, int(x + 0.3 * noise > 0.5), x, noise, "Male" if i % 5 else "Female"))
    return spark.createDataFrame(rows, "ClientID long, ProductID long, label int, x double, z double, grp string")


def test_balance_times_fairness_weight(spark):
    d = spark.createDataFrame([(1, 2.0), (0, 1.0), (0, 4.0), (0, 1.0)], "label int, sample_weight double")
    got = sorted(ml.with_balance_weight(d, base_col="sample_weight").select("label", "weight").collect())
    assert [tuple(r) for r in got] == [(0, 1.0), (0, 1.0), (0, 4.0), (1, 6.0)]


def test_select_save_and_load(spark, tmp_path):
    train, val, test = (_rows(spark, s) for s in (1, 2, 3))
    board, best = ml.train_and_select(train, val, test, ["x", "z"], kinds=("logreg", "rf"), metric="roc_auc",
                                      params={"rf": {"numTrees": 5, "maxDepth": 3}})
    rows = {r.model: r for r in board.collect()}
    top = max(sorted(rows), key=lambda m: rows[m].val_roc_auc)
    assert [m for m, r in rows.items() if r.selected] == [top] and rows[top].test_roc_auc > 0.9
    ml.save_model(best, str(tmp_path / "m"))
    a = ml.predict_proba(best, test).agg(F.sum("proba")).first()[0]
    b = ml.predict_proba(ml.load_model(str(tmp_path / "m")), test).agg(F.sum("proba")).first()[0]
    assert a == pytest.approx(b, abs=1e-12)
    with pytest.raises(ValueError):
        ml.train_and_select(train, val, test, ["x"], metric="accuracy")


def test_random_search_refits_the_best_trial(spark):
    train, val, test = (_rows(spark, s) for s in (1, 2, 3))

    def weigh(d):
        return d.withColumn("sample_weight", F.when(F.col("grp") == "Female", 2.0).otherwise(0.5))
    res = ml.random_search(train, val, test, ["x", "z"], "logreg", "recall_at_k", n_trials=2, folds=2, weigh=weigh)
    rows = {r.trial: r for r in res.trials.collect()}
    best = max(sorted(rows), key=lambda t: rows[t].cv_recall_at_k)
    assert len(rows) == 2 and str(res.params) == rows[best].params
    lr = res.model.stages[-1]
    weighed = ml.with_balance_weight(weigh(train), base_col="sample_weight")
    assert lr.getOrDefault("regParam") == pytest.approx(1 / (res.params["C"] * ml.total_weight(weighed, "weight")))
    assert {r.split for r in res.metrics.collect()} == {"val", "test"}


def test_draws_stay_in_the_declared_ranges():
    rnd = random.Random(7)
    for space in ml.SEARCH_SPACES.values():
        for _ in range(50):
            for name, v in ml.draw_params(space, rnd).items():
                assert space[name][1] <= float(v) <= space[name][2]


def test_ranked_feature_selection(spark):
    d = _rows(spark, 1, 5)
    assert scoring.select_feature_columns(d, ["z", "gone", "x"], 1) == ["z"]
    assert scoring.select_feature_columns(d, ["gone", "z", "x"], 1) == ["z", "x"]
    assert scoring.select_feature_columns(d) == ["x", "z"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_model_scored_lists_blend_and_order(spark):
    per = {}
    for r in E.queries()["model_recommendations"](spark, SF).collect():
        blend = sum(w * r[c] for c, w in SIGNAL_WEIGHTS.items())
        assert 0 <= r.affinity_score <= 1 and r.hybrid_score == pytest.approx(blend, abs=1e-5)
        per.setdefault(r.ClientID, []).append((r["rank"], r.hybrid_score))
    assert per
    for rows in per.values():
        rows.sort()
        assert [k for k, _ in rows] == list(range(1, len(rows) + 1)) and len(rows) <= 10
        assert all(a[1] >= b[1] - 1e-6 for a, b in zip(rows, rows[1:]))


def test_curve_and_search_resume(spark, tmp_path, monkeypatch):
    train, val, test = (_rows(spark, s) for s in (1, 2, 3))
    fitted = []
    plain = ml.fit_model
    monkeypatch.setattr(ml, "fit_model", lambda *a, **k: fitted.append(1) or plain(*a, **k))
    args = dict(ks=[1, 2], folds=2, path=str(tmp_path / "curve"), maxIter=5, maxDepth=2, stepSize=0.3)
    curve = sorted(map(tuple, ml.topk_feature_curve(train, ["x", "z"], **args).collect()))
    assert len(fitted) == 4 and [r[0] for r in curve] == [1, 2] and sum(r[-1] for r in curve) == 1 and min(r[1] for r in curve) > 0.8
    assert sorted(map(tuple, ml.topk_feature_curve(train, ["x", "z"], **args).collect())) == curve and len(fitted) == 4
    # an interrupted curve lacks one trial of four: only that one is fitted, to the same result
    shutil.copytree(tmp_path / "curve", tmp_path / "part", ignore=shutil.ignore_patterns("*k=002,fold=1*", "*k%3D002*fold%3D1*"))
    args["path"] = str(tmp_path / "part")
    assert sorted(map(tuple, ml.topk_feature_curve(train, ["x", "z"], **args).collect())) == curve and len(fitted) == 5
    space = {"gbt": {"maxIter": ("int", 3, 6), "maxDepth": ("int", 2, 3), "stepSize": ("log", 0.1, 0.3)},
             "rf": {"numTrees": ("int", 3, 6), "maxDepth": ("int", 2, 4), "minInstancesPerNode": ("int", 1, 3)}}
    for kind in ("gbt", "rf"):
        fitted.clear()
        one = ml.random_search(train, val, test, ["x", "z"], kind, n_trials=2, folds=2, space=space[kind], path=str(tmp_path / kind))
        assert len(fitted) == 5  # 2 trials x 2 folds and the refit
        more = ml.random_search(train, val, test, ["x", "z"], kind, n_trials=3, folds=2, space=space[kind], path=str(tmp_path / kind))
        assert len(fitted) == 5 + 3  # the new trial's folds and the refit
        old, new = ({r.trial: tuple(r) for r in s.trials.collect()} for s in (one, more))
        assert {k: new[k] for k in old} == old and len(new) == 3
        best = max(sorted(new), key=lambda t: new[t][2])
        assert str(more.params) == new[best][1] and {r.split for r in more.metrics.collect()} == {"val", "test"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_registered_ranking_and_curve(spark):
    rows = E.queries()["feature_importance"](spark, SF).orderBy("rank").collect()
    again = E.queries()["feature_importance"](spark, SF).orderBy("rank").collect()
    assert rows == again and [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and len({r.feature for r in rows}) == len(rows)
    assert sum(r.importance for r in rows) == pytest.approx(1, abs=1e-4)
    assert [r.importance for r in rows] == sorted((r.importance for r in rows), reverse=True)
