"""Splits, scores, product tables and history shuffle and write no more than they need."""

import os

from pyspark.sql import functions as F

from fairrank.operators import features, labels, scoring
from fairrank.plans.registry import Context
from fairrank.sources.tables import table_path
from test_client_buckets import history, plan, same


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_history_is_collapsed_without_written_interactions(spark, tmp_path):
    n = F.col("id")
    tables = {
        "transactions": spark.range(300).select((n % 7).alias("ClientID"), (n % 3).alias("ProductID"), (n % 2).alias("StoreID"),
                                                F.expr("timestamp_ntz'2024-01-01'").alias("SaleTransactionDate"),
                                                (n % 2).alias("Quantity"), (n % 5).cast("double").alias("SalesNetAmountEuro")),
        "clients": spark.range(6).select(n.alias("ClientID"), F.lit("A").alias("ClientCountry")),
        "products": spark.range(3).select(n.alias("ProductID"), F.lit("c").alias("Category")),
        "stores": spark.range(2).select(n.alias("StoreID"), F.lit("A").alias("StoreCountry")),
        "stocks": spark.range(3).select(F.lit("A").alias("StoreCountry"), n.alias("ProductID"), F.lit(1.0).alias("Quantity"))}
    ctx = Context(spark, str(tmp_path), {"canonical": tables})
    alone = ctx.history
    assert not os.path.exists(table_path(spark, str(tmp_path), "interactions").removeprefix("file:"))
    assert alone.count() > 0
    same(alone.drop("dup_count"), ctx.collapsed.drop("dup_count"))
    same(alone, ctx.collapsed)


def test_product_tables_take_no_maximum_of_texts_over_all_rows(spark):
    rows = history(spark, 2000)
    for df in (features.product_features(rows, "2024-02-01"), features.category_features(rows, "2024-02-01")):
        for line in plan(df).splitlines():
            assert "SortAggregate" not in line or "ClientID" not in line.split("functions=")[0]
    one = rows.where("ProductID is not null").groupBy("ProductID").agg(F.max("Category").alias("Category"), F.max("Universe").alias("u"))
    same(features.product_attributes(rows.where("ProductID is not null"), {"Category": "Category", "Universe": "u"}), one)
    pop = rows.where("ProductID is not null").groupBy("ProductID").agg(F.count("txn_date").alias("pop"), F.max("Category").alias("Category"))
    same(labels.product_popularity(rows).select("ProductID", "pop", "Category"), pop)


def test_pairs_meet_the_widest_table_last(spark):
    rows = history(spark, 2000)
    tables = {"user": features.user_features(rows, "2024-02-01"), "product": features.product_features(rows, "2024-02-01"),
              "cp": features.client_product_recency(rows, "2024-02-01"), "category": features.category_features(rows, "2024-02-01")}
    pairs = rows.select("ClientID", "ProductID").where("ClientID < 5 and ProductID < 3").distinct().withColumn("label", F.lit(1))
    ds = labels.assemble_dataset(pairs, rows, tables)
    first = next(x for x in optimized(ds).splitlines() if "Join LeftOuter" in x)
    assert "ClientID" in first and "ProductID" not in first
    u, cp = ds.columns.index("u_txns"), ds.columns.index("cp_txns")
    assert ds.columns[:3] == ["ClientID", "ProductID", "label"] and u < ds.columns.index("p_txns") < cp
    assert ds.count() == pairs.count() and ds.where("cp_txns is null or u_txns is null").count() == 0


def test_scores_take_the_history_of_their_clients(spark):
    rows = history(spark, 2000)
    some = spark.createDataFrame([(1, 100, "C1"), (2, 5, None)], "ClientID long, ProductID long, Category string")
    theirs = scoring.history_of(some, rows)
    same(theirs, rows.where("ClientID in (1, 2)"))
    same(scoring.hybrid_signals(some, rows, theirs), scoring.hybrid_signals(some, rows))
    split = some.withColumns({"label": F.lit(1), "cp_txns": F.lit(0), "p_txns": F.lit(1), "cp_days_since_last_cp": F.lit(9999)})
    assert "Join LeftSemi, (ClientID" in optimized(scoring.score_hybrid_candidates(split, rows))
