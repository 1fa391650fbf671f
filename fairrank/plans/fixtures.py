"""Driver tables -> retail domain tables.

The driver ships TPC-H-like tables; the library works on clients, products,
stores, stocks, transactions and a request log.  The mapping is written once
as portable SQL (it runs unchanged on Spark SQL and on DuckDB), so the oracle
queries and the Spark jobs start from identical inputs.  Operator logic is
written separately on each side.

Mapping (every table grows with the scale factor):

* clients      <- customer x nation.  Gender takes six raw spellings so the
                  contract normalisation and UNKNOWN handling are exercised.
* products     <- part, grouped 20 part keys per product so clients repeat
                  products; attributes come from the lowest part key.
* stores       <- supplier x nation.
* stocks       <- net shipped-minus-returned quantity per supplier nation,
                  product and supplier (several rows per key, summed later).
* transactions <- lineitem x orders, plus injected dirt: exact copies of some
                  lines, copies with a changed quantity, NULL amounts, lines
                  booked on unknown stores.  Dirt only adds rows.
* request_log  <- events (path = event type, 500 for errors).
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events")

# Ordered CTE bodies; ``{table}`` placeholders are replaced by view names.
DOMAIN_CTES: list[tuple[str, str]] = [
    ("clients_raw", """
    SELECT c.c_custkey AS ClientID,
           c.c_mktsegment AS ClientSegment,
           n.n_name AS ClientCountry,
           CAST(c.c_custkey % 2 AS BIGINT) AS ClientOptINEmail,
           CAST(CASE WHEN c.c_acctbal > 0 THEN 1 ELSE 0 END AS BIGINT) AS ClientOptINPhone,
           CASE c.c_custkey % 6 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'male'
                                WHEN 3 THEN 'female' WHEN 4 THEN 'U' ELSE NULL END AS ClientGender,
           CAST(18 + c.c_custkey % 60 AS DOUBLE) AS Age
    FROM {customer} c LEFT JOIN {nation} n ON c.c_nationkey = n.n_nationkey"""),
    ("products_raw", """
    SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS ProductID,
           CASE WHEN min_by(p_size, p_partkey) = 50 THEN NULL
                ELSE min_by(p_brand, p_partkey) END AS Category,
           min_by(p_type, p_partkey) AS FamilyLevel1,
           CASE WHEN min_by(p_size, p_partkey) <= 10 THEN 'XS'
                WHEN min_by(p_size, p_partkey) <= 20 THEN 'S'
                WHEN min_by(p_size, p_partkey) <= 30 THEN 'M'
                WHEN min_by(p_size, p_partkey) <= 40 THEN 'L'
                ELSE 'XL' END AS FamilyLevel2,
           CASE WHEN min_by(p_retailprice, p_partkey) >= 1500 THEN 'Premium'
                ELSE 'Standard' END AS Universe
    FROM {part}
    GROUP BY CAST(floor(p_partkey / 20) AS BIGINT)"""),
    ("stores_raw", """
    SELECT s.s_suppkey AS StoreID, n.n_name AS StoreCountry
    FROM {supplier} s LEFT JOIN {nation} n ON s.s_nationkey = n.n_nationkey"""),
    ("stocks_raw", """
    SELECT n.n_name AS StoreCountry,
           CAST(floor(l.l_partkey / 20) AS BIGINT) AS ProductID,
           CAST(sum(CASE l.l_returnflag WHEN 'N' THEN l.l_quantity
                                        WHEN 'R' THEN -l.l_quantity ELSE 0 END) AS DOUBLE) AS Quantity
    FROM {lineitem} l
    JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
    JOIN {nation} n ON s.s_nationkey = n.n_nationkey
    GROUP BY n.n_name, CAST(floor(l.l_partkey / 20) AS BIGINT), s.s_suppkey"""),
    ("txn_base", """
    SELECT o.o_custkey AS ClientID,
           CAST(floor(l.l_partkey / 20) AS BIGINT) AS ProductID,
           o.o_orderdate AS SaleTransactionDate,
           l.l_suppkey AS StoreID,
           CAST(l.l_quantity AS BIGINT) AS Quantity,
           CASE WHEN l.l_linenumber = 7 THEN NULL
                ELSE CAST(round(CAST(l.l_extendedprice AS DECIMAL(12,2))
                                * (1 - CAST(l.l_discount AS DECIMAL(4,2))), 2) AS DOUBLE)
           END AS SalesNetAmountEuro,
           l.l_orderkey AS okey,
           l.l_linenumber AS lnum
    FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey"""),
    ("transactions_raw", """
    SELECT ClientID, ProductID, SaleTransactionDate, StoreID + CASE WHEN copy = 3 THEN 1000000 ELSE 0 END AS StoreID,
           Quantity + CASE WHEN copy = 2 THEN 1 ELSE 0 END AS Quantity, SalesNetAmountEuro
    FROM txn_base JOIN (VALUES (0), (1), (2), (3)) AS copies(copy)
      ON copy = 0 OR (copy = 1 AND okey % 7 = 0) OR (copy = 2 AND okey % 11 = 0) OR (copy = 3 AND okey % 13 = 0 AND lnum = 1)"""),
    ("request_log", """
    SELECT ts AS timestamp_utc,
           event_type AS path,
           CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
           CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
           value AS latency_ms
    FROM {events}"""),
]

DOMAIN_TABLES = {
    "clients": "clients_raw",
    "products": "products_raw",
    "stores": "stores_raw",
    "stocks": "stocks_raw",
    "transactions": "transactions_raw",
    "request_log": "request_log",
}


def domain_cte_sql(view_names: dict[str, str] | None = None) -> str:
    """``name AS (...)`` list (without the leading WITH) for all domain tables."""
    names = {t: t for t in DRIVER_TABLES}
    names.update(view_names or {})
    return ",\n".join(f"{n} AS ({body.format(**names)}\n)" for n, body in DOMAIN_CTES)


def _register_driver_views(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    tag = hashlib.md5(os.path.abspath(sf_dir).encode()).hexdigest()[:8]
    names = {}
    for t in DRIVER_TABLES:
        view = f"fr_{tag}_{t}"
        spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")).createOrReplaceTempView(view)
        names[t] = view
    return names


def load_domain(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Lazy domain DataFrames for a driver-table directory."""
    names = _register_driver_views(spark, sf_dir)
    ctes = domain_cte_sql(names)
    return {t: spark.sql(f"WITH {ctes}\nSELECT * FROM {cte}") for t, cte in DOMAIN_TABLES.items()}
