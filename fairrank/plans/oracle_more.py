"""Oracle SQL: quarantine, audits, folds, snapshot and enriched lists."""

from fairrank.plans.oracle import ORACLE, oracle
from fairrank.plans.oracle_ops import TABLE_COLS, cat
from fairrank.plans.oracle_reco import reco


@oracle("quarantined_rows", ["SalesNetAmountEuro"])
def _():
    return """
    SELECT ClientID, ProductID, StoreID, CASE WHEN m <> 4 THEN date_trunc('second', SaleTransactionDate) END AS SaleTransactionDate,
           CASE WHEN m = 4 THEN Quantity END AS Quantity, CAST(SalesNetAmountEuro AS DOUBLE) AS SalesNetAmountEuro,
           CASE WHEN m = 4 THEN 'SaleTransactionDate: not a datetime64[ns]' ELSE 'Quantity: not a int64' END AS violations
    FROM (SELECT *, ((Quantity % 5) + 5) % 5 AS m FROM transactions_raw) WHERE m IN (1, 2, 4)"""


@oracle("canonical_checks", ["value"])
def _():
    t = "FROM transactions WHERE"
    orphans = "\nUNION ALL\n".join(
        f"SELECT 'key_consistency' AS section, 'transactions' AS \"table\", 'orphan_{d}' AS item, count(*)::DOUBLE AS value {t} {k} NOT IN (SELECT {k} FROM {d}) OR {k} IS NULL"
        for d, k in (("clients", "ClientID"), ("products", "ProductID"), ("stores", "StoreID")))
    keys = "ClientID, ProductID, SaleTransactionDate, StoreID"
    nulls = "\nUNION ALL\n".join(
        f"SELECT '{t}' AS t, '{c}' AS c, round_even(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100, 2) AS v FROM {t}"
        for t, cols in TABLE_COLS.items() for c in cols.split())
    return f"""{orphans}
    UNION ALL SELECT 'key_consistency', 'transactions', 'stocks_products_not_in_products', count(*) FROM stocks WHERE ProductID NOT IN (SELECT ProductID FROM products)
    UNION ALL SELECT 'suspicious_duplicates', 'transactions', '{keys.replace(", ", "+")}', coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM transactions GROUP BY {keys} HAVING count(*) > 1)
    UNION ALL SELECT 'top_nulls', t, c, v FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY v DESC, c) AS r FROM ({nulls})) WHERE r <= 15"""


ORACLE["quality_gate_outcome"] = f"SELECT coalesce(bool_and(passed), false) AS passed, count(*) AS checks FROM ({ORACLE['quality_gates']})"


@oracle("target_audit")
def _():
    parts = []
    for split in ("train", "val", "test"):
        end = f"(SELECT {split}_end FROM cutoffs)"
        w = f"(SELECT * FROM collapsed WHERE txn_date > {end} AND txn_date <= {end} + INTERVAL 30 DAY AND ClientID IS NOT NULL AND ProductID IS NOT NULL)"
        for mode, truth in (("binary", "1"), ("count_txn", "count(txn_date)"), ("sum_qty", "coalesce(sum(Quantity), 0)")):
            parts.append(f"""
            SELECT '{split}' AS split, '{mode}' AS mode, ClientID, ProductID, CASE WHEN t > 0 THEN 'changed' ELSE 'surplus' END AS change,
                   CAST(1 AS BIGINT) AS old_target, CASE WHEN t > 0 THEN CAST(t AS BIGINT) END AS new_target
            FROM (SELECT ClientID, ProductID, {truth} AS t FROM {w} GROUP BY ClientID, ProductID) WHERE t <> 1""")
    return "\nUNION ALL\n".join(parts)


@reco("balanced_folds")
def _():
    return """
    WITH RECURSIVE g AS (SELECT ClientID, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, ClientID) AS i FROM ds GROUP BY ClientID),
    deal AS (SELECT 0::BIGINT AS i, [0, 0, 0]::BIGINT[] AS loads, NULL::BIGINT AS ClientID, 0::BIGINT AS n, 0 AS fold
        UNION ALL SELECT g.i, list_transform(loads, lambda x, j: x + CASE WHEN j = list_position(loads, list_min(loads)) THEN g.n ELSE 0 END),
            g.ClientID, g.n, list_position(loads, list_min(loads)) - 1 FROM deal JOIN g ON g.i = deal.i + 1)
    SELECT ClientID, n AS rows, CAST(fold AS INTEGER) AS fold FROM deal WHERE i > 0"""


@reco("labelled_top_k", ["hybrid_score"])
def _():
    return """SELECT b.ClientID, b.ProductID, b.hybrid_score, CAST(d.label AS INTEGER) AS label,
        CAST(row_number() OVER (PARTITION BY b.ClientID ORDER BY b.hybrid_score DESC, b.ProductID) AS INTEGER) AS pos
        FROM base b JOIN ds d ON b.ClientID = d.ClientID AND b.ProductID = d.ProductID"""


@reco("monitoring_snapshot", ["value"])
def _():
    def lines(section, item, src, columns):
        return [f"SELECT '{section}' AS section, {item} AS item, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM ({ORACLE[src]})" for c in columns]
    return "\nUNION ALL\n".join(
        lines("api", "'all'", "request_log_summary", ("events", "p50_latency_ms", "p95_latency_ms", "error_rate"))
        + lines("paths", "path", "request_path_breakdown", ("requests", "p95_latency_ms", "error_rate"))
        + lines("drift", "report", "fairness_drift", ("pre_max_gap", "post_max_gap", "pre_min_max_ratio", "post_min_max_ratio")))


@oracle("appended_request_log", ["slowest_ms"])
def _():
    return """SELECT path, method, status_code, count(*) AS requests, min(timestamp_utc) AS first_seen, max(latency_ms) AS slowest_ms
              FROM request_log GROUP BY path, method, status_code"""


@oracle("coerced_flags")
def _():
    return "SELECT ClientID, CASE WHEN ClientID % 5 <> 4 THEN ClientOptINEmail = 1 END AS email FROM clients_raw"


@cat("enriched_cart_recommendations", ["score"])
def _():
    return f"""SELECT r.cart_id, r.rank, r.ProductID, coalesce(c.ProductName, 'Product ' || r.ProductID) AS ProductName,
        coalesce(c.Category, 'UNKNOWN') AS Category, coalesce(c.FamilyLevel1, 'UNKNOWN') AS FamilyLevel1, r.score, r.co_users
        FROM ({ORACLE['cart_recommendations']}) r LEFT JOIN catalog c ON r.ProductID = c.ProductID"""


# The numeric features of a labelled split.
NUMERIC = """u_txns u_qty_sum u_eur_sum u_recency_days u_basket_mean u_basket_median u_n_products u_n_categories u_n_stores
u_month_entropy u_dow_entropy u_customer_age_days p_txns p_buyers p_qty_sum p_eur_sum p_qty_30d p_eur_30d p_txns_30d p_buyers_30d
p_qty_60d p_eur_60d p_txns_60d p_buyers_60d p_eur_per_qty p_product_age_days p_days_since_sold cat_txns cat_buyers cat_qty cat_eur
cat_txn_share cat_eur_per_txn cp_txns cp_qty_sum cp_eur_sum cp_days_since_last_cp cp_tenure_days""".split()


@reco("selected_features")
def _():
    row = ", ".join(f"var_pop(CAST({c} AS DOUBLE)) AS {c}" for c in NUMERIC)
    return f"""SELECT CAST(row_number() OVER (ORDER BY v DESC, feature) AS INTEGER) AS place, feature
        FROM (UNPIVOT (SELECT {row} FROM ds) ON COLUMNS(*) INTO NAME feature VALUE v)
        QUALIFY row_number() OVER (ORDER BY v DESC, feature) <= 10"""
