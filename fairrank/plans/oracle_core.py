"""Oracle SQL: interactions, duplicates, features."""

from fairrank.plans.oracle import INTERACTION_COLS, oracle


@oracle("interactions", doubles=["SalesNetAmountEuro", "Age"])
def _():
    return f"SELECT {INTERACTION_COLS} FROM interactions"


@oracle("stock_availability", doubles=["StockQuantity"])
def _():
    return "SELECT StoreCountry, ProductID, StockQuantity, Available FROM stock_avail"


@oracle("orphan_counts")
def _():
    return """
    SELECT CAST(count(*) FILTER (WHERE ClientID NOT IN (SELECT ClientID FROM clients)) AS BIGINT) AS orphan_clients,
           CAST(count(*) FILTER (WHERE ProductID NOT IN (SELECT ProductID FROM products)) AS BIGINT) AS orphan_products,
           CAST(count(*) FILTER (WHERE StoreID NOT IN (SELECT StoreID FROM stores)) AS BIGINT) AS orphan_stores,
           (SELECT CAST(count(*) AS BIGINT) FROM stocks
             WHERE ProductID NOT IN (SELECT ProductID FROM products)) AS stocks_products_not_in_products
    FROM transactions"""


@oracle("collapsed_interactions", doubles=["SalesNetAmountEuro", "Age"])
def _():
    return "SELECT * FROM collapsed"


@oracle("collapse_metrics")
def _():
    return """
    SELECT (SELECT CAST(count(*) AS BIGINT) FROM interactions) AS rows_before,
           (SELECT CAST(count(*) AS BIGINT) FROM collapsed) AS rows_after,
           (SELECT CAST(count(*) AS BIGINT) FROM interactions) - (SELECT CAST(count(*) AS BIGINT) FROM collapsed) AS rows_removed,
           (SELECT CAST(count(*) AS BIGINT) FROM cpds_groups WHERE qn = 1 AND an = 1) AS collapsible_groups,
           (SELECT CAST(count(*) AS BIGINT) FROM cpds_groups) AS groups_total,
           'c_p_d_s' AS level"""


@oracle("collapsible_groups_c_p_d")
def _():
    return """
    SELECT ClientID, ProductID, txn_date, CAST(count(*) AS BIGINT) AS rows,
           CAST(count(DISTINCT Quantity) AS BIGINT) AS qty_nunique,
           CAST(count(DISTINCT SalesNetAmountEuro) AS BIGINT) AS amt_nunique,
           CAST(count(DISTINCT StoreID) AS BIGINT) AS stores_nunique,
           count(DISTINCT Quantity) = 1 AND count(DISTINCT SalesNetAmountEuro) = 1 AS same_qty_amt,
           count(DISTINCT Quantity) = 1 AND count(DISTINCT SalesNetAmountEuro) = 1
             AND count(DISTINCT StoreID) = 1 AS collapsible
    FROM interactions
    WHERE ClientID IS NOT NULL AND ProductID IS NOT NULL AND txn_date IS NOT NULL
    GROUP BY ClientID, ProductID, txn_date"""


_CLUSTER_SUMMARY = """
    SELECT '{label}' AS label, CAST(count(*) AS BIGINT) AS clusters, CAST(sum(rows) AS BIGINT) AS rows_in_clusters,
           quantile_cont(rows, 0.5) AS median_rows_per_cluster,
           quantile_cont(rows, 0.95) AS p95_rows_per_cluster,
           avg(CASE WHEN qn > 1 THEN 1.0 ELSE 0.0 END) AS share_var_qty,
           avg(CASE WHEN an > 1 THEN 1.0 ELSE 0.0 END) AS share_var_amt,
           avg(CASE WHEN {multi} THEN 1.0 ELSE 0.0 END) AS share_multi_store
    FROM (SELECT count(*) AS rows, count(DISTINCT Quantity) AS qn, count(DISTINCT SalesNetAmountEuro) AS an,
                 count(DISTINCT StoreID) AS sn
          FROM interactions WHERE {notnull} GROUP BY {keys}) g"""


@oracle("dup_cluster_summary", doubles=["median_rows_per_cluster", "p95_rows_per_cluster",
                                         "share_var_qty", "share_var_amt", "share_multi_store"])
def _():
    k1 = ["ClientID", "ProductID", "txn_date", "StoreID"]
    k2 = ["ClientID", "ProductID", "txn_date"]
    parts = []
    for label, keys, multi in (("by_client_product_date_store", k1, "FALSE"),
                               ("by_client_product_date", k2, "sn > 1")):
        parts.append(_CLUSTER_SUMMARY.format(label=label, keys=", ".join(keys), multi=multi,
                                             notnull=" AND ".join(f"{k} IS NOT NULL" for k in keys)))
    return "\nUNION ALL\n".join(parts)


@oracle("heaviest_clusters", doubles=["SalesNetAmountEuro", "Age"])
def _():
    return f"""
    SELECT i.ClientID, i.ProductID, i.txn_date, i.StoreID,
           {", ".join("i." + c.strip() for c in INTERACTION_COLS.split(",")
                      if c.strip() not in ("ClientID", "ProductID", "txn_date", "StoreID"))},
           t.cluster_rows
    FROM interactions i
    JOIN (SELECT ClientID, ProductID, txn_date, StoreID, CAST(count(*) AS BIGINT) AS cluster_rows
          FROM interactions
          WHERE ClientID IS NOT NULL AND ProductID IS NOT NULL AND txn_date IS NOT NULL AND StoreID IS NOT NULL
          GROUP BY ALL ORDER BY cluster_rows DESC, ClientID, ProductID, txn_date, StoreID LIMIT 10) t
      ON i.ClientID = t.ClientID AND i.ProductID = t.ProductID AND i.txn_date = t.txn_date AND i.StoreID = t.StoreID"""


def _user_features_sql(src: str, ref: str) -> str:
    def mode(col, out):
        return f"""
    {out} AS (SELECT ClientID, {col} AS {out} FROM (
        SELECT ClientID, {col}, row_number() OVER (PARTITION BY ClientID ORDER BY count(*) DESC, {col}) AS rn
        FROM {src} WHERE {col} IS NOT NULL GROUP BY ClientID, {col}) WHERE rn = 1)"""

    def entropy(expr, out):
        return f"""
    {out} AS (SELECT ClientID, -sum((n / tot) * ln(n / tot)) AS {out} FROM (
        SELECT ClientID, CAST(count(*) AS DOUBLE) AS n, CAST(sum(count(*)) OVER (PARTITION BY ClientID) AS DOUBLE) AS tot
        FROM {src} WHERE txn_date IS NOT NULL GROUP BY ClientID, {expr}) GROUP BY ClientID)"""

    ctes = ",".join([
        f"""
    b AS (SELECT ClientID, count(txn_date) AS txns, CAST(coalesce(sum(Quantity), 0) AS BIGINT) AS qty_sum,
                 coalesce(CAST(sum(CAST(SalesNetAmountEuro AS DECIMAL(18,2))) AS DOUBLE), 0.0) AS eur_sum,
                 min(txn_date) AS fd, max(txn_date) AS ld,
                 avg(SalesNetAmountEuro) AS basket_mean,
                 quantile_cont(SalesNetAmountEuro, 0.5) AS basket_median,
                 count(DISTINCT ProductID) AS n_products, count(DISTINCT Category) AS n_categories,
                 count(DISTINCT StoreID) AS n_stores
          FROM {src} WHERE ClientID IS NOT NULL GROUP BY ClientID)""",
        mode("StoreCountry", "pref_store_country"),
        mode("ClientCountry", "pref_client_country"),
        mode("Category", "top_category"),
        mode("FamilyLevel1", "top_family_lvl1"),
        entropy("month(txn_date)", "month_entropy"),
        entropy("isodow(txn_date)", "dow_entropy"),
    ])
    return f"""
    WITH {ctes}
    SELECT b.ClientID, CAST(b.txns AS BIGINT) AS txns, b.qty_sum, b.eur_sum,
           CAST(CASE WHEN date_sub('day', b.ld, {ref}) < 0 THEN 0 ELSE date_sub('day', b.ld, {ref}) END AS BIGINT) AS recency_days,
           b.basket_mean, b.basket_median,
           CAST(b.n_products AS BIGINT) AS n_products, CAST(b.n_categories AS BIGINT) AS n_categories,
           CAST(b.n_stores AS BIGINT) AS n_stores,
           s.pref_store_country, c.pref_client_country, t.top_category, f.top_family_lvl1,
           m.month_entropy, d.dow_entropy,
           CAST(CASE WHEN date_sub('day', b.fd, b.ld) < 0 THEN 0 ELSE date_sub('day', b.fd, b.ld) END AS BIGINT) AS customer_age_days
    FROM b
    LEFT JOIN pref_store_country s ON b.ClientID = s.ClientID
    LEFT JOIN pref_client_country c ON b.ClientID = c.ClientID
    LEFT JOIN top_category t ON b.ClientID = t.ClientID
    LEFT JOIN top_family_lvl1 f ON b.ClientID = f.ClientID
    LEFT JOIN month_entropy m ON b.ClientID = m.ClientID
    LEFT JOIN dow_entropy d ON b.ClientID = d.ClientID"""


USER_FEATURE_DOUBLES = ["eur_sum", "basket_mean", "basket_median", "month_entropy", "dow_entropy"]


@oracle("user_features", doubles=USER_FEATURE_DOUBLES)
def _():
    return _user_features_sql("hist", "(SELECT test_end FROM cutoffs)")


@oracle("user_features_all_history", doubles=USER_FEATURE_DOUBLES)
def _():
    return _user_features_sql("collapsed", "(SELECT max(txn_date) FROM collapsed)")


@oracle("product_features", doubles=["eur_sum", "eur_30d", "eur_60d", "eur_per_qty"])
def _():
    vel = []
    for d in (30, 60):
        w = f"txn_date >= (SELECT test_end FROM cutoffs) - INTERVAL {d} DAY"
        vel.append(f"""
           CASE WHEN count(*) FILTER (WHERE {w}) > 0
                THEN CAST(coalesce(sum(Quantity) FILTER (WHERE {w}), 0) AS BIGINT) END AS qty_{d}d,
           CASE WHEN count(*) FILTER (WHERE {w}) > 0
                THEN coalesce(CAST(sum(CAST(SalesNetAmountEuro AS DECIMAL(18,2))) FILTER (WHERE {w}) AS DOUBLE), 0.0) END AS eur_{d}d,
           CASE WHEN count(*) FILTER (WHERE {w}) > 0
                THEN CAST(count(txn_date) FILTER (WHERE {w}) AS BIGINT) END AS txns_{d}d,
           CASE WHEN count(*) FILTER (WHERE {w}) > 0
                THEN CAST(count(DISTINCT ClientID) FILTER (WHERE {w}) AS BIGINT) END AS buyers_{d}d""")
    return f"""
    SELECT ProductID, CAST(count(txn_date) AS BIGINT) AS txns, CAST(count(DISTINCT ClientID) AS BIGINT) AS buyers,
           CAST(coalesce(sum(Quantity), 0) AS BIGINT) AS qty_sum,
           coalesce(CAST(sum(CAST(SalesNetAmountEuro AS DECIMAL(18,2))) AS DOUBLE), 0.0) AS eur_sum,
           max(Category) AS category, max(FamilyLevel1) AS family_lvl1, max(FamilyLevel2) AS family_lvl2,
           max(Universe) AS universe, {",".join(vel)},
           coalesce(CAST(sum(CAST(SalesNetAmountEuro AS DECIMAL(18,2))) AS DOUBLE), 0.0)
             / nullif(CAST(coalesce(sum(Quantity), 0) AS DOUBLE), 0) AS eur_per_qty,
           CAST(greatest(date_sub('day', min(txn_date), max(txn_date)), 0) AS BIGINT) AS product_age_days,
           CAST(greatest(date_sub('day', max(txn_date), (SELECT test_end FROM cutoffs)), 0) AS BIGINT) AS days_since_sold
    FROM hist WHERE ProductID IS NOT NULL GROUP BY ProductID"""


@oracle("user_rfm", doubles=["eur_sum", "avg_basket_eur"])
def _():
    return """
    SELECT ClientID, CAST(count(txn_date) AS BIGINT) AS freq_txns,
           CAST(coalesce(sum(Quantity), 0) AS BIGINT) AS qty_sum,
           coalesce(CAST(sum(CAST(SalesNetAmountEuro AS DECIMAL(18,2))) AS DOUBLE), 0.0) AS eur_sum,
           CAST(greatest(date_sub('day', max(txn_date), (SELECT test_end FROM cutoffs)), 0) AS BIGINT) AS recency_days,
           CAST(greatest(date_sub('day', min(txn_date), max(txn_date)), 0) AS BIGINT) AS tenure_days,
           coalesce(CAST(sum(CAST(SalesNetAmountEuro AS DECIMAL(18,2))) AS DOUBLE), 0.0)
             / nullif(CAST(count(txn_date) AS DOUBLE), 0) AS avg_basket_eur
    FROM hist WHERE ClientID IS NOT NULL GROUP BY ClientID"""


@oracle("client_product_recency", doubles=["cp_eur_sum"])
def _():
    return """
    SELECT ClientID, ProductID, CAST(count(txn_date) AS BIGINT) AS cp_txns,
           CAST(coalesce(sum(Quantity), 0) AS BIGINT) AS cp_qty_sum,
           coalesce(CAST(sum(CAST(SalesNetAmountEuro AS DECIMAL(18,2))) AS DOUBLE), 0.0) AS cp_eur_sum,
           CAST(greatest(date_sub('day', max(txn_date), (SELECT test_end FROM cutoffs)), 0) AS BIGINT) AS days_since_last_cp,
           CAST(greatest(date_sub('day', min(txn_date), max(txn_date)), 0) AS BIGINT) AS cp_tenure_days
    FROM hist WHERE ClientID IS NOT NULL AND ProductID IS NOT NULL GROUP BY ClientID, ProductID"""


@oracle("category_features", doubles=["cat_eur", "cat_txn_share", "cat_eur_per_txn"])
def _():
    return """
    WITH cat AS (
      SELECT Category, CAST(count(txn_date) AS BIGINT) AS cat_txns, CAST(count(DISTINCT ClientID) AS BIGINT) AS cat_buyers,
             CAST(coalesce(sum(Quantity), 0) AS BIGINT) AS cat_qty,
             coalesce(CAST(sum(CAST(SalesNetAmountEuro AS DECIMAL(18,2))) AS DOUBLE), 0.0) AS cat_eur
      FROM hist WHERE Category IS NOT NULL GROUP BY Category),
    prod AS (
      SELECT ProductID, max(Category) AS Category, max(FamilyLevel1) AS FamilyLevel1,
             max(FamilyLevel2) AS FamilyLevel2, max(Universe) AS Universe
      FROM hist WHERE ProductID IS NOT NULL GROUP BY ProductID)
    SELECT p.ProductID, p.Category, p.FamilyLevel1, p.FamilyLevel2, p.Universe,
           c.cat_txns, c.cat_buyers, c.cat_qty, c.cat_eur,
           c.cat_txns / CAST(greatest((SELECT count(*) FROM hist), 1) AS DOUBLE) AS cat_txn_share,
           c.cat_eur / nullif(CAST(c.cat_txns AS DOUBLE), 0) AS cat_eur_per_txn
    FROM prod p LEFT JOIN cat c ON p.Category = c.Category"""
