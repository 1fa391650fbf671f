"""Wide interactions table: star join, calendar parts, stock availability.

J1-J4, Q1, C8, C11, C22, S4.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairrank.config import INTERACTION_COLUMNS
from fairrank.operators.order import global_rank
from fairrank.sources.tables import materialize


def normalize_txn_date(c: str | Column) -> Column:
    """Timestamps are UTC-naive; zoned input is converted to UTC first."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("timestamp_ntz")


def apply_cutoff(df: DataFrame, cutoff: str | None, col: str = "txn_date") -> DataFrame:
    """Keep rows strictly before ``cutoff`` (None = no filter).  The
    predicate is a literal comparison, so it reaches the parquet scan."""
    if not cutoff:
        return df
    try:
        _dt.datetime.fromisoformat(str(cutoff))
    except ValueError as e:
        raise ValueError(f"cutoff {cutoff!r} is not an ISO date or timestamp") from e
    return df.where(F.col(col) < F.lit(cutoff).cast("timestamp_ntz"))


def assert_unique_key(df: DataFrame, keys: Sequence[str], name: str) -> None:
    """J1 validation: the right side of an m:1 join must have a unique key."""
    dup = df.groupBy(*keys).count().where(F.col("count") > 1).limit(1).count()
    if dup:
        raise ValueError(f"{name}: key {list(keys)} is not unique; m:1 join would fan out")


def stock_availability(stocks: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Q1 (+J3): stock summed per (StoreCountry, ProductID), NULL as 0,
    restricted to known products; ``Available`` = sum > 0."""
    s = stocks
    if products is not None:
        s = s.join(products.select("ProductID"), "ProductID", "left_semi")
    return (s.groupBy("StoreCountry", "ProductID")
             .agg(F.sum(F.coalesce(F.col("Quantity").cast("double"), F.lit(0.0))).alias("StockQuantity"))
             .withColumn("Available", (F.col("StockQuantity") > 0).cast("tinyint")))


def calendar_parts(df: DataFrame, ts: str = "txn_date") -> DataFrame:
    """C11: year, month, weekday (0=Mon), ISO week, weekend flag."""
    t = F.col(ts)
    dow = F.weekday(t)
    return df.withColumns({
        "txn_year": F.year(t),
        "txn_month": F.month(t),
        "txn_dow": dow,
        "txn_week": F.weekofyear(t),
        "is_weekend": F.when(dow.isNull(), F.lit(None)).otherwise(dow.isin(5, 6)).cast("tinyint"),
    })


def _with_availability(clients: DataFrame, products: DataFrame, stores: DataFrame,
                       stocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clients with __client_at and stores with __store_at, their country's number among the countries
    that have any product available (null: none), and products with __available, a bit per such
    country in words of 64.  Written, so that joins know their sizes."""
    avail = stock_availability(stocks, products).where((F.col("Available") == 1) & F.col("StoreCountry").isNotNull())
    avail = materialize(avail.select("StoreCountry", "ProductID"), "interactions", f"available-{uuid.uuid4().hex}")
    numbers = materialize(global_rank(avail.select("StoreCountry").distinct(), [F.asc("StoreCountry")], "__nth"),
                          "interactions", f"countries-{uuid.uuid4().hex}")

    def numbered(df: DataFrame, country: str, out: str) -> DataFrame:
        if country not in df.columns:
            return df
        of = numbers.select(F.col("StoreCountry").alias("__of"), (F.col("__nth") - 1).cast("int").alias(out))
        return df.join(of, F.col(country) == F.col("__of"), "left").drop("__of")

    at = avail.join(numbers, "StoreCountry").select(
        "ProductID", F.floor((F.col("__nth") - 1) / 64).cast("int").alias("word"), ((F.col("__nth") - 1) % 64).cast("int").alias("bit"))
    words = at.groupBy("ProductID", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    maps = words.groupBy("ProductID").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    maps = maps.select("ProductID", F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("m"))), lambda w: F.coalesce(
        F.try_element_at("m", w), F.lit(0).cast("bigint"))).alias("__available"))
    parts = {"clients": numbered(clients, "ClientCountry", "__client_at"), "stores": numbered(stores, "StoreCountry", "__store_at"),
             "products": products.join(maps, "ProductID", "left")}
    out = {name: materialize(df, "interactions", f"{name}-{uuid.uuid4().hex}") for name, df in parts.items()}
    return out["clients"], out["products"], out["stores"]


def _available(at: str) -> Column:
    """1 if the bit of country number ``at`` is set in __available, else 0."""
    word = F.get("__available", F.floor(F.col(at) / 64).cast("int"))
    return F.coalesce(F.bit_get(word, F.col(at) % 64), F.lit(0)).cast("tinyint")


def build_interactions(transactions: DataFrame, clients: DataFrame, products: DataFrame,
                       stores: DataFrame, stocks: DataFrame, validate: bool = True,
                       client_partitions: int | None = None) -> DataFrame:
    """J1 + J2 + C11 + C22: the 25-column interactions table.

    Dimensions are left-joined (m:1, uniqueness checked when ``validate``).
    Availability comes with the product, as a bit per country, so the wide
    rows are not shuffled again to look up two flags.  No broadcast hints: a
    join becomes a broadcast only if a side's size is known to be small.
    ``client_partitions``: rows are dealt by ClientID over so many partitions.
    Clients join last, and columns that follow from others are made after that,
    so that what is dealt is narrow."""
    if validate:
        assert_unique_key(clients, ["ClientID"], "clients")
        assert_unique_key(products, ["ProductID"], "products")
        assert_unique_key(stores, ["StoreID"], "stores")

    def dealt(df: DataFrame) -> DataFrame:
        return df if client_partitions is None else df.repartition(client_partitions, "ClientID")

    clients, products, stores = _with_availability(clients, products, stores, stocks)
    # the first dealing is the only shuffle where stores and products are small; Spark leaves out the second one then
    df = dealt(transactions).join(stores, "StoreID", "left").join(products, "ProductID", "left")
    df = dealt(df).join(clients, "ClientID", "left")
    for flag, at in (("AvailableInStoreCountry", "__store_at"), ("AvailableInClientCountry", "__client_at")):
        df = df.withColumn(flag, _available(at) if at in df.columns else F.lit(0).cast("tinyint"))
    df = calendar_parts(df.withColumn("txn_date", normalize_txn_date("SaleTransactionDate")))
    return df.select([c for c in INTERACTION_COLUMNS if c in df.columns])


def drop_orphans(transactions: DataFrame, clients: DataFrame, products: DataFrame,
                 stores: DataFrame) -> DataFrame:
    """Keep transactions whose client, product and store all exist."""
    return (transactions
            .join(clients.select("ClientID"), "ClientID", "left_semi")
            .join(products.select("ProductID"), "ProductID", "left_semi")
            .join(stores.select("StoreID"), "StoreID", "left_semi"))


def orphan_counts(transactions: DataFrame, clients: DataFrame, products: DataFrame,
                  stores: DataFrame, stocks: DataFrame | None = None) -> DataFrame:
    """Rows whose key is absent from its dimension, one row of counts.

    Each dimension contributes a flag through a left join on its distinct
    keys; the flags are summed in a single aggregation over transactions."""
    t = transactions.select("ClientID", "ProductID", "StoreID")
    flagged = (t.join(clients.select("ClientID").distinct().withColumn("_c", F.lit(1)), "ClientID", "left")
                .join(products.select("ProductID").distinct().withColumn("_p", F.lit(1)), "ProductID", "left")
                .join(stores.select("StoreID").distinct().withColumn("_s", F.lit(1)), "StoreID", "left"))
    out = flagged.agg(
        F.count_if(F.col("_c").isNull()).alias("orphan_clients"),
        F.count_if(F.col("_p").isNull()).alias("orphan_products"),
        F.count_if(F.col("_s").isNull()).alias("orphan_stores"),
    )
    if stocks is not None:
        sc = (stocks.select("ProductID")
                    .join(products.select("ProductID").distinct(), "ProductID", "left_anti")
                    .agg(F.count(F.lit(1)).alias("stocks_products_not_in_products")))
        out = out.crossJoin(sc)  # both sides are single-row aggregates
    return out


def load_interactions(collapsed: DataFrame | None, raw: DataFrame | None) -> DataFrame:
    """Prefer the collapsed table, else the raw one; normalise txn_date."""
    src = collapsed if collapsed is not None else raw
    if src is None:
        raise FileNotFoundError("neither collapsed nor raw interactions were given")
    return src.withColumn("txn_date", normalize_txn_date("txn_date"))
