"""Tables in buckets of clients: what is grouped by client needs no shuffle; stock flags with many countries."""

import uuid

from pyspark.sql import functions as F

from fairrank.functions.columns import round_doubles
from fairrank.operators import dedupe, features, labels
from fairrank.operators.interactions import build_interactions
from fairrank.sources.tables import BUCKET_ROWS, MOST_BUCKETS, bucket_count, materialize_bucketed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def history(spark, rows):
    i = F.col("id")
    return spark.range(rows).select(
        F.when(i % 17 != 0, i % 23).alias("ClientID"), F.when(i % 13 != 0, i % 7).alias("ProductID"),
        F.when(i % 11 != 0, i % 3).alias("StoreID"),
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(int(id % 40))").alias("txn_date"), (i % 2).alias("Quantity"),
        F.when(i % 5 != 0, (i % 4).cast("double")).alias("SalesNetAmountEuro"),
        *[F.when(i % 6 != 0, F.concat(F.lit(c[0]), (i % n).cast("string"))).alias(c) for n, c in enumerate(
            ("Category", "FamilyLevel1", "FamilyLevel2", "Universe", "StoreCountry", "ClientCountry"), 2)])


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_number_of_buckets_follows_the_rows():
    assert [bucket_count(n) for n in (0, 1, BUCKET_ROWS, BUCKET_ROWS + 1, 10**10)] == [1, 1, 1, 2, MOST_BUCKETS]


def test_collapse_and_client_features_need_no_shuffle(spark):
    rows = history(spark, 3000)
    t = materialize_bucketed(rows, "test", f"buckets-{uuid.uuid4().hex}", "ClientID", 5)
    assert t.count() == 3000 and t.columns == rows.columns
    for level in dedupe.LEVEL_KEYS:
        assert "Exchange" not in plan(dedupe.collapse_duplicates(t, level)[0])
        same(dedupe.collapse_duplicates(t, level)[0], dedupe.collapse_duplicates(rows, level)[0])
        same(dedupe.collapse_duplicates(t, level)[1], dedupe.collapse_duplicates(rows, level)[1])
    for build in (features.user_rfm, features.client_product_recency):
        assert "Exchange" not in plan(build(t, "2024-02-01"))
    same(round_doubles(features.user_features(t, "2024-02-01")), round_doubles(features.user_features(rows, "2024-02-01")))
    assert "hashpartitioning" not in plan(features.user_features(t, "2024-02-01"))
    assert "Exchange" not in plan(labels.client_pref_category(t)) + plan(labels.positives(t, "sum_qty"))


def test_collapse_keeps_rows_without_a_key_apart(spark):
    rows = [(None, 1, "d", 1, 2, 5.0), (None, 1, "d", 1, 2, 5.0), (1, None, "d", 1, 2, 5.0), (1, 1, "d", 1, None, 5.0),
            (1, 1, "d", 1, 2, 5.0), (1, 1, "d", 1, 2, None)]
    df = spark.createDataFrame(rows, "ClientID long, ProductID long, txn_date string, StoreID long, Quantity long, SalesNetAmountEuro double")
    out, metrics = dedupe.collapse_duplicates(df)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(None, 1, "d", 1, 2, 5.0, 1)] * 2 + [(1, None, "d", 1, 2, 5.0, 1), (1, 1, "d", 1, 2, 5.0, 3)], key=str)
    assert tuple(metrics.first()) == (6, 4, 2, 1, 1, "c_p_d_s")


def test_availability_in_more_countries_than_a_word_has_bits(spark):
    n = 150
    tx = spark.range(n).selectExpr("id AS ClientID", "id % 2 AS ProductID", f"{n - 1} - id AS StoreID",
                                   "timestamp_ntz'2024-01-01' AS SaleTransactionDate", "1L AS Quantity", "1.0D AS SalesNetAmountEuro")
    clients = spark.range(n).selectExpr("id AS ClientID", "concat('c', id) AS ClientCountry")
    stores = spark.range(n).selectExpr("id AS StoreID", "concat('c', id) AS StoreCountry")
    products = spark.createDataFrame([(0, "a"), (1, "b")], "ProductID long, Category string")
    stocks = spark.range(n).selectExpr("concat('c', id) AS StoreCountry", "id % 2 AS ProductID", "double(id % 3 - 1) AS Quantity")
    out = build_interactions(tx, clients, products, stores, stocks, validate=False, client_partitions=3)
    got = {r.ClientID: (r.AvailableInStoreCountry, r.AvailableInClientCountry) for r in out.collect()}

    def has(country, product):
        return int(country % 2 == product and country % 3 == 2)
    assert got == {i: (has(n - 1 - i, i % 2), has(i, i % 2)) for i in range(n)}
