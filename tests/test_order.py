"""Ranks and quantiles over the whole table against windows and sorted lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairrank.operators import order
from fairrank.operators.labels import product_popularity


def no_single_partition(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "SinglePartition" not in plan


def test_rank_of_a_million_products(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        n = 1_000_000
        # one category holds most products, popularity has many ties, two rows of the last product
        hist = spark.range(n).select(F.col("id").alias("ProductID"), F.lit(1).alias("txn_date"),
                                     F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 9, F.lit(None)).otherwise(F.concat(F.lit("c"), F.col("id") % 5)).alias("Category"))
        hist = hist.union(hist.where("ProductID % 1000 = 3")).union(hist.where("ProductID % 1000 = 3"))
        pop = product_popularity(hist)
        assert no_single_partition(pop)
        got = pop.toPandas().sort_values("rank")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got["rank"].tolist() == list(range(1, n + 1))
    assert got["ProductID"].tolist() == [*range(3, n, 1000), *[i for i in range(n) if i % 1000 != 3]]
    for c, g in got.groupby("Category"):
        assert g["cat_rank"].tolist() == list(range(1, len(g) + 1))
    assert got[got["Category"].isna()]["cat_rank"].isna().all()


def test_quantiles_of_a_skewed_million(spark):
    r = spark.range(1_000_000)
    # few distinct values with most rows on one, a group of its own for null and for one row
    v = r.select(F.when(F.col("id") < 10, F.lit(None)).when(F.col("id") == 10, F.lit(-1)).otherwise(F.col("id") % 3).alias("grp"),
                 F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(2.5)).otherwise((F.col("id") * 7919 % 101).cast("double") / 8).alias("value"))
    probs = (0.0, 0.01, 0.5, 0.77, 0.95, 1.0)
    got = order.exact_quantiles(v, probs)
    assert no_single_partition(got)
    got = {x.grp: x for x in got.collect()}
    data = v.toPandas()
    for g, want in data.assign(grp=data["grp"].fillna(-9)).groupby("grp"):
        x = np.sort(want["value"].dropna().to_numpy())
        mine = got[None if g == -9 else int(g)]
        assert mine.n == len(x) and mine.q == pytest.approx(np.quantile(x, probs).tolist(), abs=1e-12)


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "grp string, value double")
    assert order.exact_quantiles(none, (0.5,)).collect() == []
    one = spark.createDataFrame([("a", 4.0), ("b", None)], "grp string, value double")
    assert [(r.grp, r.n, r.q) for r in order.exact_quantiles(one, (0.25, 0.5)).collect()] == [("a", 1, [4.0, 4.0])]
    assert order.global_rank(one, [F.col("grp")]).orderBy("rank").select("grp", "rank").collect() == [("a", 1), ("b", 2)]
    assert order.rank_within(none, "grp", [F.col("value")], "r").collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 100])
def test_binary_search_of_cuts(spark, n):
    cuts = sorted({i * 7919 % 1000 / 10 for i in range(n)})
    got = spark.range(1000).select((F.col("id") / 10 - 1).alias("v")).select("v", order.cuts_upto(F.col("v"), cuts).alias("k")).collect()
    assert all(r.k == sum(c <= r.v for c in cuts) for r in got)
