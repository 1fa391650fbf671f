"""Exact values on the reference's in-memory fixtures (worked out by hand)."""

import math

import pytest

from fairrank.operators import fairness, ranking


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 10, 1), (1, 11, 0), (1, 12, 1), (2, 20, 0), (2, 21, 1), (2, 22, 0)],
                                 "ClientID long, ProductID long, label int")


@pytest.fixture
def recs(spark):
    return spark.createDataFrame([(1, 10, 1, .9), (1, 11, 2, .8), (2, 20, 1, .9), (2, 21, 2, .8)],
                                 "ClientID long, ProductID long, rank int, hybrid_score double")


def test_ranking_metrics_k2(recs, labels):
    m = {r.metric: r.value for r in ranking.evaluate_recommendations(recs, labels, 2).collect()}
    assert m["clients"] == 2
    assert m["precision@2"] == pytest.approx(0.5)
    assert m["recall@2"] == pytest.approx(0.75)
    assert m["map@2"] == pytest.approx(0.5)
    assert m["hitrate@2"] == pytest.approx(1.0)
    ndcg = (1 / (1 + 1 / math.log2(3)) + 1 / math.log2(3)) / 2
    assert m["ndcg@2"] == pytest.approx(ndcg)
    for v in m.values():
        assert v >= 0


def test_sample_weights(spark):
    df = spark.createDataFrame([(1, "Male"), (2, "Male"), (3, "Female"), (4, "Female"), (5, "Female"), (6, None)],
                               "ClientID long, ClientGender string")
    w = {r.ClientID: r.sample_weight for r in
         fairness.sample_weights(df, "ClientGender", ["Male", "Female"]).collect()}
    assert w[1] == pytest.approx(1.25) and w[2] == pytest.approx(1.25)
    assert w[3] == pytest.approx(2.5 / 3)
    assert w[6] == pytest.approx(1.0)
    assert w[1] > w[3]


@pytest.fixture
def scored(spark):
    rows = []
    cats = ["A", "B", "C"]
    for c in range(1, 5):
        for j, cat in enumerate(cats):
            rows.append((c, c * 10 + j, cat, 0.9 - 0.1 * j + (0.05 if (c <= 2 and cat == "A") else 0)))
    return spark.createDataFrame(rows, "ClientID long, ProductID long, Category string, hybrid_score double")


@pytest.fixture
def groups(spark):
    return spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, "B")], "ClientID long, ClientGender string")


def test_fairness_report_shapes(scored, groups):
    top = ranking.prepare_top_k(scored.withColumn("label", scored.ClientID * 0), scored.limit(0).select(
        "ClientID", "ProductID").withColumn("label", scored.ClientID * 0), 2)
    exp, par, summ = fairness.fairness_report(top, groups, "ClientGender")
    assert exp.count() == 2 and par.count() == 2
    s = summ.first()
    assert 0 <= s.max_gap <= 1 and 0 <= s.min_max_ratio <= 1 and s.mean_category_l1 >= 0


def test_rerank_does_not_raise_l1(scored, groups):
    from fairrank.operators.scoring import top_k
    base = top_k(scored, 2)
    fair = fairness.rerank_for_exposure_balance(scored, groups, "ClientGender", 2, 1.2)
    pre = fairness.fairness_report(base, groups, "ClientGender")[2].first().mean_category_l1
    post = fairness.fairness_report(fair, groups, "ClientGender", score_col="fair_score")[2].first().mean_category_l1
    assert post <= pre + 1e-12
    ranks = sorted(r["rank"] for r in fair.where("ClientID = 1").collect())
    assert ranks == [1, 2]


def test_rerank_lambda_zero_is_base(scored, groups):
    from fairrank.operators.scoring import top_k
    base = {(r.ClientID, r.ProductID, r["rank"]) for r in top_k(scored, 2).collect()}
    fair = {(r.ClientID, r.ProductID, r["rank"]) for r in
            fairness.rerank_for_exposure_balance(scored, groups, "ClientGender", 2, 0.0).collect()}
    assert base == fair
