"""Oracle SQL: quality reports, catalog, co-occurrence, monitoring, curves."""

from fairrank.plans import oracle_core  # noqa: F401  (registers product_features)
from fairrank.plans.oracle import INTERACTION_COLS, ORACLE, oracle, with_base
from fairrank.plans.oracle_reco import RECO, reco

N = 5
ICOLS = [c.strip() for c in INTERACTION_COLS.split(",")]


@oracle("null_percent_interactions", ["null_percent"])
def _():
    parts = [f"SELECT '{c}' AS \"column\", round_even(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100, 2) "
             f"AS null_percent FROM interactions" for c in ICOLS]
    return "\nUNION ALL\n".join(parts)


@oracle("canonical_report")
def _():
    specs = [("clients", ["ClientID"], "clients", 7), ("products", ["ProductID"], "products", 5),
             ("stores", ["StoreID"], "stores", 2), ("transactions", None, "transactions", 6),
             ("stocks", ["StoreCountry", "ProductID"], "stocks", 3)]
    parts = []
    for name, pk, src, ncols in specs:
        pkdup = (f"(SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM {src} "
                 f"GROUP BY {', '.join(pk)} HAVING count(*) > 1))") if pk else "CAST(0 AS BIGINT)"
        after = f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(pk) if pk else '*'} FROM {src}))"
        parts.append(f"""
        SELECT '{name}' AS "table", CAST(count(*) AS BIGINT) AS rows_before, CAST({after} AS BIGINT) AS rows_after,
               {ncols} AS cols,
               CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src})) AS BIGINT) AS duplicate_rows_full,
               {pkdup} AS duplicate_rows_on_pk, CAST(count(*) - {after} AS BIGINT) AS rows_removed_dedup
        FROM {src}""")
    return "\nUNION ALL\n".join(parts)


# The columns of the canonical tables.
TABLE_COLS = {
    "clients": "ClientID ClientSegment ClientCountry ClientOptINEmail ClientOptINPhone ClientGender Age",
    "products": "ProductID Category FamilyLevel1 FamilyLevel2 Universe",
    "stores": "StoreID StoreCountry",
    "transactions": "ClientID ProductID StoreID SaleTransactionDate Quantity SalesNetAmountEuro",
    "stocks": "StoreCountry ProductID Quantity",
}


@oracle("ingested_transactions", ["SalesNetAmountEuro"])
def _():
    return """
    SELECT ClientID, ProductID, CASE WHEN m = 4 THEN NULL ELSE date_trunc('second', SaleTransactionDate) END AS SaleTransactionDate,
           StoreID, CASE WHEN m IN (1, 2) THEN NULL ELSE Quantity END AS Quantity,
           CASE WHEN m = 3 THEN NULL ELSE CAST(SalesNetAmountEuro AS DOUBLE) END AS SalesNetAmountEuro
    FROM (SELECT *, ((Quantity % 5) + 5) % 5 AS m FROM transactions_raw)"""


@oracle("contract_violations")
def _():
    parts = []
    for t, pk in (("clients", ["ClientID"]), ("products", ["ProductID"]), ("stores", ["StoreID"]),
                  ("stocks", ["StoreCountry", "ProductID"])):
        listed = str(pk).replace("'", "''")
        parts.append(f"""SELECT '{t}' AS "table", 'primary key {listed} has ' || sum(n) || ' duplicate rows' AS error
                         FROM (SELECT count(*) AS n FROM {t} GROUP BY {', '.join(pk)}) WHERE n > 1 HAVING sum(n) > 0""")
    return "\nUNION ALL\n".join(parts)


@oracle("canonical_null_percent", ["null_percent"])
def _():
    return "\nUNION ALL\n".join(
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", "
        f"round_even(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100, 2) AS null_percent FROM {t}"
        for t, cols in TABLE_COLS.items() for c in cols.split())


@oracle("cleaned_interactions", ["SalesNetAmountEuro", "Age"])
def _():
    return f"""SELECT DISTINCT {', '.join(ICOLS)} FROM interactions
               WHERE ClientID IN (SELECT ClientID FROM clients) AND ProductID IN (SELECT ProductID FROM products)
                 AND StoreID IN (SELECT StoreID FROM stores)"""


@oracle("describe_numeric", ["count", "mean", "std", "min", "p1", "p5", "p25", "p50", "p75", "p95", "p99", "max"])
def _():
    parts = []
    for c in ("Quantity", "SalesNetAmountEuro"):
        x = f"CAST({c} AS DOUBLE)"
        qs = ", ".join(f"quantile_cont({x}, {p}) AS p{int(round(p * 100))}"
                       for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99))
        parts.append(f"""SELECT '{c}' AS "column", CAST(count({x}) AS DOUBLE) AS count, avg({x}) AS mean,
                         stddev_samp({x}) AS std, min({x}) AS min, {qs}, max({x}) AS max FROM interactions""")
    return "\nUNION ALL\n".join(parts)


@oracle("availability_report", ["share"])
def _():
    parts = []
    for c in ("AvailableInStoreCountry", "AvailableInClientCountry"):
        parts.append(f"""SELECT '{c}' AS flag, CAST({c} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS count,
                         (SELECT avg(CAST({c} AS DOUBLE)) FROM interactions) AS share
                         FROM interactions GROUP BY {c}""")
    return "\nUNION ALL\n".join(parts)


@oracle("interactions_report")
def _():
    def dup(keys):
        return (f"(SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM interactions "
                f"GROUP BY {', '.join(keys)} HAVING count(*) > 1))")
    return f"""
    SELECT CAST(count(*) AS BIGINT) AS rows, 25 AS cols, min(txn_date) AS date_min, max(txn_date) AS date_max,
           CAST(count(DISTINCT ClientID) AS BIGINT) AS ClientID_nunique,
           CAST(count(DISTINCT ProductID) AS BIGINT) AS ProductID_nunique,
           CAST(count(DISTINCT StoreID) AS BIGINT) AS StoreID_nunique,
           {dup(["ClientID", "ProductID", "txn_date", "StoreID"])} AS dup_rows_c_p_d_s,
           {dup(["ClientID", "ProductID", "txn_date"])} AS dup_rows_c_p_d,
           concat_ws('; ',
             CASE WHEN count(*) FILTER (WHERE Quantity < 0) > 0 THEN 'Negative quantities detected.' END,
             CASE WHEN count(*) FILTER (WHERE SalesNetAmountEuro < 0) > 0 THEN 'Negative net amounts detected.' END,
             CASE WHEN avg(CASE WHEN txn_date IS NULL THEN 1.0 ELSE 0.0 END) > 0.05
                  THEN 'More than 5% missing txn_date.' END) AS warnings
    FROM interactions"""


def _checks(table, src, keys, nonneg, nonneg_null):
    rows = [f"""SELECT '{table}' AS "table", '{"_".join(keys)}_unique' AS name,
               (SELECT count(*) FROM (SELECT DISTINCT {", ".join(keys)} FROM {src})) = count(*) AS passed,
               'rows=' || CAST(count(*) AS VARCHAR) || ' distinct=' ||
               CAST((SELECT count(*) FROM (SELECT DISTINCT {", ".join(keys)} FROM {src})) AS VARCHAR) AS message
               FROM {src}"""]
    for k in keys:
        rows.append(f"""SELECT '{table}', '{k}_not_null', count(*) FILTER (WHERE {k} IS NULL) = 0,
                        'nulls=' || CAST(count(*) FILTER (WHERE {k} IS NULL) AS VARCHAR) FROM {src}""")
    for c in nonneg:
        rows.append(f"""SELECT '{table}', '{c}_non_negative', count(*) FILTER (WHERE NOT coalesce({c} >= 0, false)) = 0,
                        'violations=' || CAST(count(*) FILTER (WHERE NOT coalesce({c} >= 0, false)) AS VARCHAR)
                        FROM {src}""")
    for c in nonneg_null:
        rows.append(f"""SELECT '{table}', '{c}_non_negative_or_null', count(*) FILTER (WHERE {c} < 0) = 0,
                        'violations=' || CAST(count(*) FILTER (WHERE {c} < 0) AS VARCHAR) FROM {src}""")
    return rows


RFM = """(SELECT ClientID, count(txn_date) AS freq_txns, coalesce(sum(Quantity), 0) AS qty_sum,
          coalesce(sum(CAST(SalesNetAmountEuro AS DECIMAL(18,2))), 0) AS eur_sum,
          greatest(date_sub('day', max(txn_date), (SELECT test_end FROM cutoffs)), 0) AS recency_days,
          greatest(date_sub('day', min(txn_date), max(txn_date)), 0) AS tenure_days,
          CAST(coalesce(sum(CAST(SalesNetAmountEuro AS DECIMAL(18,2))), 0) AS DOUBLE) / nullif(count(txn_date), 0)
            AS avg_basket_eur
          FROM hist WHERE ClientID IS NOT NULL GROUP BY ClientID) AS rfm"""


@reco("feature_checks")
def _():
    rows = (_checks("user_features", "uf", ["ClientID"],
                    ["txns", "qty_sum", "eur_sum", "recency_days", "n_products", "customer_age_days"],
                    ["basket_mean", "basket_median"])
            + _checks("product_features", "pf", ["ProductID"],
                      ["txns", "buyers", "qty_sum", "product_age_days", "days_since_sold"], ["eur_per_qty"])
            + _checks("user_rfm", RFM, ["ClientID"],
                      ["recency_days", "tenure_days", "freq_txns", "qty_sum", "eur_sum"], ["avg_basket_eur"])
            + _checks("client_product_recency", "cpf", ["ClientID", "ProductID"],
                      ["days_since_last_cp", "cp_tenure_days", "cp_txns", "cp_qty_sum", "cp_eur_sum"], [])
            + _checks("category_features", "catf", ["ProductID"],
                      ["cat_txns", "cat_qty", "cat_eur", "cat_buyers", "cat_txn_share"], ["cat_eur_per_txn"]))
    return "\nUNION ALL\n".join(rows)


def _split_gates(split):
    at = with_base(f"""
    SELECT '{split}_rows_gt_0' AS name, count(*) > 0 AS passed, 'rows=' || CAST(count(*) AS VARCHAR) AS message FROM ds
    UNION ALL SELECT '{split}_label_binary', count(*) FILTER (WHERE label IS NOT NULL AND label NOT IN (0, 1)) = 0,
           'label must be {{0,1}}' FROM ds""", RECO)
    return f"SELECT * FROM ({at.replace('(SELECT test_end FROM cutoffs)', f'(SELECT {split}_end FROM cutoffs)')})"


@reco("quality_gates")
def _():
    null_ratio = "avg(CASE WHEN {0} IS NULL THEN 1.0 ELSE 0.0 END)"
    rows = ["""SELECT 'interactions_non_empty' AS name, count(*) > 0 AS passed,
                      'rows=' || CAST(count(*) AS VARCHAR) AS message FROM collapsed"""]
    for c in ("ClientID", "ProductID"):
        r = null_ratio.format(c)
        rows.append(f"SELECT '{c}_null_ratio_lt_1pct', {r} < 0.01, '{c}_null_ratio=' || printf('%.4f', {r}) FROM collapsed")
    r = "avg(CASE WHEN txn_date IS NOT NULL THEN 1.0 ELSE 0.0 END)"
    rows.append(f"SELECT 'txn_date_valid_ratio_gt_95pct', {r} > 0.95, 'txn_date_valid_ratio=' || printf('%.4f', {r}) "
                "FROM collapsed")
    for table, src in (("user_features", "uf"), ("product_features", "pf"), ("user_rfm", RFM),
                       ("client_product_recency", "cpf"), ("category_features", "catf")):
        rows.append(f"SELECT '{table}_non_empty', count(*) > 0, 'rows=' || CAST(count(*) AS VARCHAR) FROM {src}")
    return "\nUNION ALL\n".join(rows + [_split_gates(s) for s in ("train", "val", "test")])


@oracle("interim_profile")
def _():
    tables = {"clients": ["ClientID", "ClientSegment", "ClientCountry", "ClientOptINEmail", "ClientOptINPhone",
                          "ClientGender", "Age"],
              "products": ["ProductID", "Category", "FamilyLevel1", "FamilyLevel2", "Universe"],
              "stores": ["StoreID", "StoreCountry"],
              "transactions": ["ClientID", "ProductID", "SaleTransactionDate", "StoreID", "Quantity",
                               "SalesNetAmountEuro"],
              "stocks": ["StoreCountry", "ProductID", "Quantity"]}

    def line(table, metric, item="NULL", value="NULL", text="NULL", tail=""):
        return (f"""SELECT '{table}' AS "table", '{metric}' AS metric, CAST({item} AS VARCHAR) AS item,
                    CAST({value} AS DOUBLE) AS value, CAST({text} AS VARCHAR) AS text {tail or f'FROM {table}'}""")

    rows = []
    for t, cols in tables.items():
        rows += [line(t, "rows", value="count(*)"), line(t, "columns", value=str(len(cols)), tail=" ")]
        rows += [line(t, "null_percent", f"'{c}'",
                      f"round_even(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 2)") for c in cols]
    for m, f in (("date_min", "min"), ("date_max", "max")):
        rows.append(line("transactions", m, text=f"strftime({f}(SaleTransactionDate), '%Y-%m-%d %H:%M:%S')"))
    for c in ("Quantity", "SalesNetAmountEuro"):
        rows.append(line("transactions", "negative", f"'{c}'", f"count(*) FILTER (WHERE {c} < 0)"))
    for d, k in (("clients", "ClientID"), ("products", "ProductID"), ("stores", "StoreID")):
        rows.append(line("transactions", "orphans", f"'{d}'", "count(*)", tail=(
            f"FROM transactions t WHERE NOT EXISTS (SELECT 1 FROM {d} d WHERE d.{k} = t.{k})")))
    rows.append(line("stocks", "orphans", "'products'", "count(*)", tail=(
        "FROM stocks t WHERE NOT EXISTS (SELECT 1 FROM products d WHERE d.ProductID = t.ProductID)")))
    rows.append(line("clients", "gender", "ClientGender", "n", tail=(
        "FROM (SELECT ClientGender, count(*) AS n FROM clients GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST LIMIT 5)")))
    rows.append(line("products", "category", "Category", tail=(
        "FROM (SELECT DISTINCT Category FROM products WHERE Category IS NOT NULL ORDER BY 1 LIMIT 10)")))
    return "\nUNION ALL\n".join(rows)


@oracle("sampled_dup_clusters")
def _():
    return """
    SELECT ClientID, ProductID, txn_date, CAST(count(*) AS BIGINT) AS rows,
           CAST(count(DISTINCT Quantity) AS BIGINT) AS qty_nunique,
           CAST(count(DISTINCT SalesNetAmountEuro) AS BIGINT) AS amt_nunique,
           CAST(count(DISTINCT StoreID) AS BIGINT) AS stores_nunique,
           count(DISTINCT Quantity) > 1 AS has_var_qty, count(DISTINCT SalesNetAmountEuro) > 1 AS has_var_amt,
           count(DISTINCT StoreID) > 1 AS multi_store
    FROM interactions
    WHERE ClientID IS NOT NULL AND ProductID IS NOT NULL AND txn_date IS NOT NULL
      AND substr(md5('42|' || CAST(ClientID AS VARCHAR)), 1, 1) < '8'
    GROUP BY ClientID, ProductID, txn_date"""


@oracle("collapsed_interactions_c_p_d")
def _():
    return f"""
    WITH marked AS (
      SELECT {", ".join(ICOLS)}, count(*) OVER k AS n,
             ClientID IS NOT NULL AND ProductID IS NOT NULL AND txn_date IS NOT NULL
             AND min(Quantity) OVER k = max(Quantity) OVER k
             AND min(SalesNetAmountEuro) OVER k = max(SalesNetAmountEuro) OVER k
             AND min(StoreID) OVER k = max(StoreID) OVER k AS one,
             row_number() OVER (PARTITION BY ClientID, ProductID, txn_date ORDER BY Quantity NULLS LAST,
                                SalesNetAmountEuro NULLS LAST, StoreID NULLS LAST) AS rn
      FROM interactions WINDOW k AS (PARTITION BY ClientID, ProductID, txn_date))
    SELECT {", ".join(ICOLS)}, CAST(CASE WHEN coalesce(one, false) THEN n ELSE 1 END AS BIGINT) AS dup_count
    FROM marked WHERE NOT coalesce(one, false) OR rn = 1"""


# the ordered copy holds the same rows
ORACLE["product_features_ordered"] = ORACLE["product_features"]


CATALOG = """
catalog AS (
  SELECT ProductID, Category, FamilyLevel1, FamilyLevel2, Universe, ProductName,
         CASE WHEN count(*) OVER (PARTITION BY ProductName) > 1
              THEN ProductName || ' (option ' || CAST(row_number() OVER (PARTITION BY ProductName ORDER BY ProductID) AS VARCHAR) || ')'
              ELSE ProductName END AS ProductLabel
  FROM (SELECT *, regexp_replace(regexp_replace(concat_ws(' · ', Category, FamilyLevel1, FamilyLevel2), '\\s+', ' ', 'g'),
                                 '^[ ·]+|[ ·]+$', '', 'g') AS ProductName
        FROM (SELECT ProductID, coalesce(max(Category), 'UNKNOWN') AS Category,
                     coalesce(max(FamilyLevel1), 'UNKNOWN') AS FamilyLevel1,
                     coalesce(max(FamilyLevel2), 'UNKNOWN') AS FamilyLevel2,
                     coalesce(max(Universe), 'UNKNOWN') AS Universe
              FROM collapsed WHERE ClientID IS NOT NULL AND ProductID IS NOT NULL GROUP BY ProductID))),
bp AS (SELECT DISTINCT ClientID, ProductID FROM hh WHERE ClientID IS NOT NULL AND ProductID IS NOT NULL),
nb AS (SELECT ProductID, count(*) AS u FROM bp GROUP BY ProductID),
seeds AS (SELECT DISTINCT ProductID AS SeedID FROM win),
cooc AS (
  SELECT s.SeedID, b2.ProductID, CAST(count(*) AS BIGINT) AS co_users,
         count(*) / sqrt(CAST(greatest(n1.u, 1) AS DOUBLE) * CAST(greatest(n2.u, 1) AS DOUBLE)) AS score
  FROM seeds s JOIN bp b1 ON b1.ProductID = s.SeedID
  JOIN bp b2 ON b2.ClientID = b1.ClientID AND b2.ProductID <> s.SeedID
  JOIN nb n1 ON n1.ProductID = s.SeedID JOIN nb n2 ON n2.ProductID = b2.ProductID
  GROUP BY s.SeedID, b2.ProductID, n1.u, n2.u),
cooc_ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY SeedID ORDER BY score DESC, co_users DESC, ProductID) AS INTEGER) AS rank
  FROM cooc)
"""


def cat(name, doubles=None):
    return oracle(name, doubles, extra_ctes=RECO + "," + CATALOG)


@cat("catalog")
def _():
    return "SELECT * FROM catalog"


@cat("catalog_search")
def _():
    return """SELECT * FROM catalog WHERE contains(lower(ProductName), 'economy') OR contains(lower(Category), 'economy')
              OR contains(lower(FamilyLevel1), 'economy') OR contains(lower(FamilyLevel2), 'economy')"""


@cat("item_cooccurrence", ["score"])
def _():
    return f"SELECT SeedID, ProductID, co_users, score, rank FROM cooc_ranked WHERE rank <= {N}"


@cat("category_recommendations", ["score"])
def _():
    return f"""
    SELECT * FROM (
      SELECT Category, ProductID, CAST(count(ClientID) AS DOUBLE) AS score,
             CAST(count(DISTINCT ClientID) AS BIGINT) AS co_users,
             CAST(row_number() OVER (PARTITION BY Category ORDER BY count(ClientID) DESC,
                                     count(DISTINCT ClientID) DESC, ProductID) AS INTEGER) AS rank
      FROM hh WHERE Category IS NOT NULL AND ProductID IS NOT NULL GROUP BY Category, ProductID)
    WHERE rank <= {N}"""


@cat("cart_recommendations", ["score"])
def _():
    return f"""
    WITH carts AS (SELECT DISTINCT ClientID AS cart_id, ProductID FROM win
                   WHERE ClientID IS NOT NULL AND ProductID IS NOT NULL),
    agg AS (SELECT c.cart_id, r.ProductID, sum(r.score) AS score, CAST(sum(r.co_users) AS BIGINT) AS co_users
            FROM carts c JOIN cooc_ranked r ON r.SeedID = c.ProductID AND r.rank <= 50
            WHERE NOT EXISTS (SELECT 1 FROM carts x WHERE x.cart_id = c.cart_id AND x.ProductID = r.ProductID)
            GROUP BY c.cart_id, r.ProductID)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cart_id ORDER BY score DESC, co_users DESC, ProductID)
                                  AS INTEGER) AS rank FROM agg) WHERE rank <= {N}"""


@cat("similar_to_seed", ["score"])
def _():
    return f"""
    WITH r AS (
      SELECT c.SeedID, c.ProductID, c.co_users, c.score, c.rank,
             CASE WHEN i.FamilyLevel1 = s.FamilyLevel1 THEN 0 WHEN i.Category = s.Category THEN 1 ELSE 2 END AS tier
      FROM cooc_ranked c LEFT JOIN catalog i ON c.ProductID = i.ProductID LEFT JOIN catalog s ON c.SeedID = s.ProductID),
    best AS (SELECT SeedID, min(tier) AS tier FROM r GROUP BY SeedID)
    SELECT * FROM (SELECT SeedID, ProductID, co_users, score, CAST(row_number() OVER (PARTITION BY SeedID ORDER BY rank) AS INTEGER) AS rank
                   FROM r JOIN best USING (SeedID, tier)) WHERE rank <= {N}"""


@cat("cart_category_recommendations", ["score"])
def _():
    return """
    WITH carts AS (SELECT DISTINCT ClientID AS cart_id, ProductID FROM win
                   WHERE ClientID IS NOT NULL AND ProductID IS NOT NULL),
    agg AS (SELECT c.cart_id, r.ProductID, sum(r.score) AS score, CAST(sum(r.co_users) AS BIGINT) AS co_users
            FROM carts c JOIN cooc_ranked r ON r.SeedID = c.ProductID AND r.rank <= 50
            WHERE NOT EXISTS (SELECT 1 FROM carts x WHERE x.cart_id = c.cart_id AND x.ProductID = r.ProductID)
            GROUP BY c.cart_id, r.ProductID),
    recs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cart_id ORDER BY score DESC, co_users DESC, ProductID) AS k
                            FROM agg) WHERE k <= 12),
    cats AS (SELECT DISTINCT cart_id, Category FROM carts JOIN catalog USING (ProductID)),
    marked AS (SELECT r.cart_id, r.ProductID, r.score, r.co_users, p.Category, c.Category IS NOT NULL AS hit
               FROM recs r LEFT JOIN catalog p USING (ProductID)
               LEFT JOIN cats c ON c.cart_id = r.cart_id AND c.Category = p.Category),
    own AS (SELECT cart_id, ProductID, score, co_users, Category FROM (
              SELECT *, bool_or(hit) OVER (PARTITION BY cart_id) AS anyhit FROM marked) WHERE hit OR NOT anyhit),
    popular AS (SELECT p.Category, p.ProductID, CAST(count(h.ClientID) AS DOUBLE) AS score,
                       CAST(count(DISTINCT h.ClientID) AS BIGINT) AS co_users
                FROM hh h JOIN catalog p ON p.ProductID = h.ProductID AND p.Category = h.Category GROUP BY 1, 2),
    fill AS (SELECT c.cart_id, p.ProductID, p.score, p.co_users, p.Category FROM cats c JOIN popular p USING (Category)
             WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.cart_id = c.cart_id)
               AND NOT EXISTS (SELECT 1 FROM carts x WHERE x.cart_id = c.cart_id AND x.ProductID = p.ProductID))
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cart_id ORDER BY score DESC, co_users DESC, ProductID)
                                  AS INTEGER) AS rank FROM (SELECT * FROM own UNION ALL SELECT * FROM fill)) WHERE rank <= 12"""


MON = """
mon_asof AS (SELECT max(timestamp_utc) AS t FROM request_log),
win24 AS (SELECT * FROM request_log WHERE timestamp_utc >= (SELECT t FROM mon_asof) - INTERVAL 24 HOUR)
"""


@oracle("request_log_summary", ["p50_latency_ms", "p95_latency_ms", "error_rate"], extra_ctes=MON)
def _():
    return """SELECT 24 AS window_hours, CAST(count(*) AS BIGINT) AS events,
                     quantile_cont(latency_ms, 0.5) AS p50_latency_ms, quantile_cont(latency_ms, 0.95) AS p95_latency_ms,
                     avg(CASE WHEN status_code >= 400 THEN 1.0 ELSE 0.0 END) AS error_rate FROM win24"""


@oracle("request_path_breakdown", ["p95_latency_ms", "error_rate"], extra_ctes=MON)
def _():
    return """SELECT path, CAST(count(*) AS BIGINT) AS requests, quantile_cont(latency_ms, 0.95) AS p95_latency_ms,
                     avg(CASE WHEN status_code >= 400 THEN 1.0 ELSE 0.0 END) AS error_rate
              FROM win24 GROUP BY path"""


@oracle("request_log_hourly", ["error_rate", "p50_latency_ms", "p95_latency_ms"])
def _():
    return """SELECT time_bucket(INTERVAL 1 HOUR, timestamp_utc) AS window_start,
                     time_bucket(INTERVAL 1 HOUR, timestamp_utc) + INTERVAL 1 HOUR AS window_end, path,
                     CAST(count(*) AS BIGINT) AS requests,
                     avg(CASE WHEN status_code >= 400 THEN 1.0 ELSE 0.0 END) AS error_rate,
                     quantile_cont(latency_ms, 0.5) AS p50_latency_ms, quantile_cont(latency_ms, 0.95) AS p95_latency_ms
              FROM request_log GROUP BY ALL"""


SCORES = """
thr AS (SELECT affinity_score AS score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg
        FROM aff GROUP BY affinity_score),
cum AS (SELECT score, pos, neg, CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp,
               CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp FROM thr),
tot AS (SELECT sum(pos) AS P, sum(neg) AS Nn FROM thr)
"""


@reco("threshold_counts", ["score"])
def _():
    return "SELECT * FROM (WITH " + SCORES + " SELECT * FROM cum)"


@reco("score_metrics", ["roc_auc", "pr_auc", "logloss", "best_f1"])
def _():
    eps = "2.220446049250313e-16"
    return f"""SELECT * FROM (WITH {SCORES}
    SELECT sum(neg * ((tp - pos) + pos / 2.0)) / (max(P) * max(Nn)) AS roc_auc,
           sum(pos / CAST(P AS DOUBLE) * tp / CAST(tp + fp AS DOUBLE)) AS pr_auc,
           (SELECT avg(-(label * ln(least(greatest(affinity_score, {eps}), 1 - {eps}))
                        + (1 - label) * ln(1 - least(greatest(affinity_score, {eps}), 1 - {eps})))) FROM aff) AS logloss,
           max(CASE WHEN tp / CAST(tp + fp AS DOUBLE) + tp / CAST(P AS DOUBLE) > 0
                    THEN 2 * (tp / CAST(tp + fp AS DOUBLE)) * (tp / CAST(P AS DOUBLE))
                         / (tp / CAST(tp + fp AS DOUBLE) + tp / CAST(P AS DOUBLE)) ELSE 0 END) AS best_f1
    FROM cum CROSS JOIN tot)"""


@oracle("feature_store_versions")
def _():
    keys = {"user": "ClientID", "rfm": "ClientID", "product": "ProductID", "category": "ProductID", "cp": "(ClientID, ProductID)"}
    null = {k: " AND ".join(f"{c} IS NOT NULL" for c in v.strip("()").split(", ")) for k, v in keys.items()}
    return "\nUNION ALL\n".join(f"""
        SELECT '{t}' AS "table", strftime(k.{c}, '%Y-%m-%d') AS cutoff, count(DISTINCT {key}) AS rows
        FROM collapsed, cutoffs k WHERE txn_date < k.{c} AND {null[t]} GROUP BY k.{c}"""
        for t, key in keys.items() for c in ("train_end", "val_end", "test_end"))
