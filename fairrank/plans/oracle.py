"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark operators (windows and joins where the
library uses aggregations, and vice versa) so that the two can catch each
other's mistakes.  Every query starts from the same domain mapping CTEs as
the Spark side (``fixtures.domain_cte_sql``).
"""

from __future__ import annotations

from fairrank.plans.fixtures import domain_cte_sql

ROUND_NUDGE = "0.000000001"

INTERACTION_COLS = """ClientID, ProductID, SaleTransactionDate, txn_date, StoreID, StoreCountry,
  Quantity, SalesNetAmountEuro, ClientSegment, ClientCountry, ClientOptINEmail, ClientOptINPhone,
  ClientGender, Age, Category, FamilyLevel1, FamilyLevel2, Universe, txn_year, txn_month, txn_dow,
  txn_week, is_weekend, AvailableInStoreCountry, AvailableInClientCountry"""

CANONICAL = """
clients AS (
  SELECT ClientID, ClientSegment, ClientCountry, ClientOptINEmail, ClientOptINPhone,
         CASE ClientGender WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female'
                           WHEN 'male' THEN 'Male' WHEN 'female' THEN 'Female'
                           ELSE ClientGender END AS ClientGender,
         Age
  FROM clients_raw),
products AS (SELECT * FROM products_raw),
stores AS (SELECT * FROM stores_raw),
transactions AS (SELECT * FROM transactions_raw),
stocks AS (SELECT * FROM stocks_raw WHERE ProductID IN (SELECT ProductID FROM products)),
stock_avail AS (
  SELECT StoreCountry, ProductID, sum(coalesce(Quantity, 0)) AS StockQuantity,
         CAST(CASE WHEN sum(coalesce(Quantity, 0)) > 0 THEN 1 ELSE 0 END AS TINYINT) AS Available
  FROM stocks GROUP BY StoreCountry, ProductID),
interactions AS (
  SELECT t.ClientID, t.ProductID, t.SaleTransactionDate, t.SaleTransactionDate AS txn_date,
         t.StoreID, s.StoreCountry, t.Quantity, t.SalesNetAmountEuro,
         c.ClientSegment, c.ClientCountry, c.ClientOptINEmail, c.ClientOptINPhone, c.ClientGender, c.Age,
         p.Category, p.FamilyLevel1, p.FamilyLevel2, p.Universe,
         CAST(year(t.SaleTransactionDate) AS INTEGER) AS txn_year,
         CAST(month(t.SaleTransactionDate) AS INTEGER) AS txn_month,
         CAST(isodow(t.SaleTransactionDate) - 1 AS INTEGER) AS txn_dow,
         CAST(weekofyear(t.SaleTransactionDate) AS INTEGER) AS txn_week,
         CAST(CASE WHEN isodow(t.SaleTransactionDate) >= 6 THEN 1 ELSE 0 END AS TINYINT) AS is_weekend,
         CAST(coalesce(a1.Available, 0) AS TINYINT) AS AvailableInStoreCountry,
         CAST(coalesce(a2.Available, 0) AS TINYINT) AS AvailableInClientCountry
  FROM transactions t
  LEFT JOIN clients c ON t.ClientID = c.ClientID
  LEFT JOIN products p ON t.ProductID = p.ProductID
  LEFT JOIN stores s ON t.StoreID = s.StoreID
  LEFT JOIN stock_avail a1 ON a1.StoreCountry = s.StoreCountry AND a1.ProductID = t.ProductID
  LEFT JOIN stock_avail a2 ON a2.StoreCountry = c.ClientCountry AND a2.ProductID = t.ProductID),
cpds_groups AS (
  SELECT ClientID, ProductID, txn_date, StoreID, count(*) AS n,
         count(DISTINCT Quantity) AS qn, count(DISTINCT SalesNetAmountEuro) AS an
  FROM interactions
  WHERE ClientID IS NOT NULL AND ProductID IS NOT NULL AND txn_date IS NOT NULL AND StoreID IS NOT NULL
  GROUP BY ClientID, ProductID, txn_date, StoreID),
numbered AS (
  SELECT i.*, row_number() OVER (PARTITION BY ClientID, ProductID, txn_date, StoreID
                                 ORDER BY Quantity NULLS LAST, SalesNetAmountEuro NULLS LAST) AS rn
  FROM interactions i),
collapsed AS (
  SELECT {cols}, CAST(g.n AS BIGINT) AS dup_count
  FROM numbered i JOIN cpds_groups g
    ON i.ClientID = g.ClientID AND i.ProductID = g.ProductID AND i.txn_date = g.txn_date AND i.StoreID = g.StoreID
  WHERE g.qn = 1 AND g.an = 1 AND i.rn = 1
  UNION ALL
  SELECT {cols}, CAST(1 AS BIGINT) AS dup_count
  FROM numbered i LEFT JOIN cpds_groups g
    ON i.ClientID = g.ClientID AND i.ProductID = g.ProductID AND i.txn_date = g.txn_date AND i.StoreID = g.StoreID
  WHERE g.n IS NULL OR NOT (g.qn = 1 AND g.an = 1)),
cutoffs AS (
  SELECT CAST(CAST(max(txn_date) - INTERVAL 90 DAY AS DATE) AS TIMESTAMP) AS train_end,
         CAST(CAST(max(txn_date) - INTERVAL 60 DAY AS DATE) AS TIMESTAMP) AS val_end,
         CAST(CAST(max(txn_date) - INTERVAL 30 DAY AS DATE) AS TIMESTAMP) AS test_end
  FROM collapsed),
hist AS (SELECT * FROM collapsed WHERE txn_date < (SELECT test_end FROM cutoffs))
""".format(cols=", ".join("i." + c.strip() for c in INTERACTION_COLS.split(",")))


def with_base(body: str, extra_ctes: str = "") -> str:
    ctes = domain_cte_sql() + ",\n" + CANONICAL
    if extra_ctes:
        ctes += ",\n" + extra_ctes
    if body.lstrip().upper().startswith("WITH"):
        body = f"SELECT * FROM ({body}) AS _body"
    return f"WITH {ctes}\n{body}"


def rounded(sql: str, doubles: list[str]) -> str:
    if not doubles:
        return sql
    rep = ", ".join(f"round({c} + {ROUND_NUDGE}, 6) AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS q"


ORACLE: dict[str, str] = {}


def oracle(name: str, doubles: list[str] | None = None, extra_ctes: str = ""):
    def deco(fn):
        ORACLE[name] = rounded(with_base(fn(), extra_ctes), doubles or [])
        return fn
    return deco


def oracle_sql() -> dict[str, str]:
    from fairrank.plans import oracle_core, oracle_more, oracle_ops, oracle_reco  # noqa: F401
    return dict(ORACLE)
