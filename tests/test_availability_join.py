"""The interactions table looks its stock flags up without joins of their own."""

from fairrank.operators.interactions import build_interactions


def test_availability_comes_with_the_product(spark):
    tx = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 9), (2, None, 1), (3, 7, 2)], "ClientID long, ProductID long, StoreID long")
    tx = tx.selectExpr("*", "timestamp_ntz'2024-01-01' AS SaleTransactionDate", "1L AS Quantity", "1.0D AS SalesNetAmountEuro")
    clients = spark.createDataFrame([(1, "FR"), (2, None)], "ClientID long, ClientCountry string")
    products = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "ProductID long, Category string")
    stores = spark.createDataFrame([(1, "FR"), (2, "US")], "StoreID long, StoreCountry string")
    stocks = spark.createDataFrame([("FR", 1, 3.0), ("FR", 1, -1.0), ("US", 2, 1.0), ("FR", 2, None), (None, 1, 5.0), ("US", 7, 1.0)],
                                   "StoreCountry string, ProductID long, Quantity double")
    out = build_interactions(tx, clients, products, stores, stocks, validate=False)
    got = sorted(out.select("ClientID", "ProductID", "Category", "AvailableInStoreCountry", "AvailableInClientCountry").collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1, "a", 1, 1), (1, 2, "b", 1, 0), (1, 2, "c", 1, 0), (2, 1, "a", 0, 0),
                                                      (2, None, None, 0, 0), (3, 7, None, 0, 0)], key=str)
    assert dict(out.dtypes)["AvailableInStoreCountry"] == "tinyint"
    assert out._jdf.queryExecution().executedPlan().toString().count("Join") == 3  # clients, stores, products: none to look up a flag
