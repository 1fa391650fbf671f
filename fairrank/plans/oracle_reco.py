"""Oracle SQL: splits, labels, negatives (brute force), scoring, fairness, evaluation.

Test split: history ``<= test_end``, label window ``(test_end, test_end + 30d]``,
5 negatives per positive; features from rows ``< test_end``.
"""

from fairrank.plans.oracle import ORACLE, oracle
from fairrank.plans.oracle_core import _user_features_sql

K = 10

HH = """
hh AS (SELECT * FROM collapsed WHERE txn_date <= (SELECT test_end FROM cutoffs)),
win AS (SELECT * FROM collapsed WHERE txn_date > (SELECT test_end FROM cutoffs)
                                AND txn_date <= (SELECT test_end FROM cutoffs) + INTERVAL 30 DAY),
pos AS (SELECT DISTINCT ClientID, ProductID FROM win WHERE ClientID IS NOT NULL AND ProductID IS NOT NULL),
seen AS (SELECT DISTINCT ClientID, ProductID FROM hh WHERE ClientID IS NOT NULL AND ProductID IS NOT NULL),
pp AS (
  SELECT ProductID, pop, Category,
         CAST(row_number() OVER (ORDER BY pop DESC, ProductID) AS INTEGER) AS rank,
         CASE WHEN Category IS NOT NULL THEN
           CAST(row_number() OVER (PARTITION BY Category ORDER BY pop DESC, ProductID) AS INTEGER) END AS cat_rank
  FROM (SELECT ProductID, count(txn_date) AS pop, max(Category) AS Category
        FROM hh WHERE ProductID IS NOT NULL GROUP BY ProductID)),
pref AS (
  SELECT ClientID, Category AS pref_category FROM (
    SELECT ClientID, Category, row_number() OVER (PARTITION BY ClientID ORDER BY count(*) DESC, Category) AS r
    FROM hh WHERE Category IS NOT NULL AND ClientID IS NOT NULL GROUP BY ClientID, Category) WHERE r = 1),
dem AS (SELECT ClientID, count(*) * 5 AS n FROM pos GROUP BY ClientID),
unblocked AS (
  SELECT d.ClientID, p.ProductID, p.rank, p.Category, d.n
  FROM dem d CROSS JOIN pp p
  WHERE NOT EXISTS (SELECT 1 FROM pos x WHERE x.ClientID = d.ClientID AND x.ProductID = p.ProductID)
    AND NOT EXISTS (SELECT 1 FROM seen x WHERE x.ClientID = d.ClientID AND x.ProductID = p.ProductID)),
neg_pop AS (
  SELECT ClientID, ProductID, 0 AS label, CAST(r AS INTEGER) AS neg_order FROM (
    SELECT *, row_number() OVER (PARTITION BY ClientID ORDER BY rank) AS r FROM unblocked) WHERE r <= n),
tier0 AS (
  SELECT ClientID, ProductID, rank, n FROM (
    SELECT u.*, row_number() OVER (PARTITION BY u.ClientID ORDER BY u.rank) AS r
    FROM unblocked u JOIN pref ON u.ClientID = pref.ClientID AND u.Category = pref.pref_category) WHERE r <= n),
tier1 AS (
  SELECT ClientID, ProductID, rank FROM (
    SELECT u.*, row_number() OVER (PARTITION BY u.ClientID ORDER BY u.rank) AS r,
           u.n - coalesce((SELECT count(*) FROM tier0 t WHERE t.ClientID = u.ClientID), 0) AS need
    FROM unblocked u
    WHERE NOT EXISTS (SELECT 1 FROM tier0 t WHERE t.ClientID = u.ClientID AND t.ProductID = u.ProductID))
  WHERE r <= need),
neg_prefcat AS (
  SELECT ClientID, ProductID, 0 AS label,
         CAST(row_number() OVER (PARTITION BY ClientID ORDER BY tier, rank) AS INTEGER) AS neg_order
  FROM (SELECT ClientID, ProductID, 0 AS tier, rank FROM tier0
        UNION ALL SELECT ClientID, ProductID, 1 AS tier, rank FROM tier1)),
uf AS (SELECT * FROM ({uf})),
pf AS (
  SELECT ProductID, CAST(count(txn_date) AS BIGINT) AS txns, CAST(count(DISTINCT ClientID) AS BIGINT) AS buyers,
         CAST(coalesce(sum(Quantity), 0) AS BIGINT) AS qty_sum,
         coalesce(CAST(sum(CAST(SalesNetAmountEuro AS DECIMAL(18,2))) AS DOUBLE), 0.0) AS eur_sum,
         {vel},
         coalesce(CAST(sum(CAST(SalesNetAmountEuro AS DECIMAL(18,2))) AS DOUBLE), 0.0)
           / nullif(CAST(coalesce(sum(Quantity), 0) AS DOUBLE), 0) AS eur_per_qty,
         CAST(greatest(date_sub('day', min(txn_date), max(txn_date)), 0) AS BIGINT) AS product_age_days,
         CAST(greatest(date_sub('day', max(txn_date), (SELECT test_end FROM cutoffs)), 0) AS BIGINT) AS days_since_sold
  FROM hist WHERE ProductID IS NOT NULL GROUP BY ProductID),
cpf AS (
  SELECT ClientID, ProductID, CAST(count(txn_date) AS BIGINT) AS cp_txns,
         CAST(coalesce(sum(Quantity), 0) AS BIGINT) AS cp_qty_sum,
         coalesce(CAST(sum(CAST(SalesNetAmountEuro AS DECIMAL(18,2))) AS DOUBLE), 0.0) AS cp_eur_sum,
         CAST(greatest(date_sub('day', max(txn_date), (SELECT test_end FROM cutoffs)), 0) AS BIGINT) AS days_since_last_cp,
         CAST(greatest(date_sub('day', min(txn_date), max(txn_date)), 0) AS BIGINT) AS cp_tenure_days
  FROM hist WHERE ClientID IS NOT NULL AND ProductID IS NOT NULL GROUP BY ClientID, ProductID),
catpop AS (
  SELECT Category, CAST(count(txn_date) AS BIGINT) AS cat_txns, CAST(count(DISTINCT ClientID) AS BIGINT) AS cat_buyers,
         CAST(coalesce(sum(Quantity), 0) AS BIGINT) AS cat_qty,
         coalesce(CAST(sum(CAST(SalesNetAmountEuro AS DECIMAL(18,2))) AS DOUBLE), 0.0) AS cat_eur
  FROM hist WHERE Category IS NOT NULL GROUP BY Category),
catf AS (
  SELECT p.ProductID, p.Category, p.FamilyLevel1, p.FamilyLevel2, p.Universe,
         c.cat_txns, c.cat_buyers, c.cat_qty, c.cat_eur,
         c.cat_txns / CAST(greatest((SELECT count(*) FROM hist), 1) AS DOUBLE) AS cat_txn_share,
         c.cat_eur / nullif(CAST(c.cat_txns AS DOUBLE), 0) AS cat_eur_per_txn
  FROM (SELECT ProductID, max(Category) AS Category, max(FamilyLevel1) AS FamilyLevel1,
               max(FamilyLevel2) AS FamilyLevel2, max(Universe) AS Universe
        FROM hist WHERE ProductID IS NOT NULL GROUP BY ProductID) p
  LEFT JOIN catpop c ON p.Category = c.Category),
cand AS (SELECT ClientID, ProductID, 1 AS label FROM pos
         UNION ALL SELECT ClientID, ProductID, label FROM neg_prefcat),
ds AS (
  SELECT c.ClientID, c.ProductID, c.label,
         u.txns AS u_txns, u.qty_sum AS u_qty_sum, u.eur_sum AS u_eur_sum, u.recency_days AS u_recency_days,
         u.basket_mean AS u_basket_mean, u.basket_median AS u_basket_median, u.n_products AS u_n_products,
         u.n_categories AS u_n_categories, u.n_stores AS u_n_stores, u.pref_store_country AS u_pref_store_country,
         u.pref_client_country AS u_pref_client_country, u.top_category AS u_top_category,
         u.top_family_lvl1 AS u_top_family_lvl1, u.month_entropy AS u_month_entropy,
         u.dow_entropy AS u_dow_entropy, u.customer_age_days AS u_customer_age_days,
         p.txns AS p_txns, p.buyers AS p_buyers, p.qty_sum AS p_qty_sum, p.eur_sum AS p_eur_sum,
         p.qty_30d AS p_qty_30d, p.eur_30d AS p_eur_30d, p.txns_30d AS p_txns_30d, p.buyers_30d AS p_buyers_30d,
         p.qty_60d AS p_qty_60d, p.eur_60d AS p_eur_60d, p.txns_60d AS p_txns_60d, p.buyers_60d AS p_buyers_60d,
         p.eur_per_qty AS p_eur_per_qty, p.product_age_days AS p_product_age_days,
         p.days_since_sold AS p_days_since_sold,
         k.Category, k.FamilyLevel1, k.FamilyLevel2, k.Universe, k.cat_txns, k.cat_buyers, k.cat_qty, k.cat_eur,
         k.cat_txn_share, k.cat_eur_per_txn,
         coalesce(x.cp_txns, 0) AS cp_txns, coalesce(x.cp_qty_sum, 0) AS cp_qty_sum,
         coalesce(x.cp_eur_sum, 0.0) AS cp_eur_sum, coalesce(x.days_since_last_cp, 9999) AS cp_days_since_last_cp,
         coalesce(x.cp_tenure_days, 0) AS cp_tenure_days,
         CAST(c.label AS BIGINT) AS target
  FROM cand c
  LEFT JOIN uf u ON c.ClientID = u.ClientID
  LEFT JOIN pf p ON c.ProductID = p.ProductID
  LEFT JOIN catf k ON c.ProductID = k.ProductID
  LEFT JOIN cpf x ON c.ClientID = x.ClientID AND c.ProductID = x.ProductID),
aff_in AS (SELECT *, ln(1 + cp_txns) AS a1, ln(1 + p_txns) AS a2, CAST(cp_days_since_last_cp AS DOUBLE) AS a3 FROM ds),
aff_mm AS (SELECT min(a1) AS lo1, max(a1) AS hi1, min(a2) AS lo2, max(a2) AS hi2, min(a3) AS lo3, max(a3) AS hi3
           FROM aff_in),
aff AS (
  SELECT a.*, coalesce(
    0.55 * CASE WHEN hi1 > lo1 THEN (a1 - lo1) / (hi1 - lo1) ELSE 0 END
    + 0.35 * CASE WHEN hi2 > lo2 THEN (a2 - lo2) / (hi2 - lo2) ELSE 0 END
    + 0.10 * (1 - CASE WHEN hi3 > lo3 THEN (a3 - lo3) / (hi3 - lo3) ELSE 0 END), 0) AS affinity_score
  FROM aff_in a CROSS JOIN aff_mm),
unseen AS (
  SELECT a.* FROM aff a
  WHERE NOT EXISTS (SELECT 1 FROM hh h WHERE h.ClientID = a.ClientID AND h.ProductID = a.ProductID)),
prodsig AS (SELECT ProductID, count(ClientID) AS hist_txn, count(DISTINCT ClientID) AS hist_buyers
            FROM hh WHERE ProductID IS NOT NULL GROUP BY ProductID),
catpref AS (
  SELECT ClientID, Category, n / CAST(sum(n) OVER (PARTITION BY ClientID) AS DOUBLE) AS pref_p
  FROM (SELECT ClientID, Category, count(*) AS n FROM hh
        WHERE Category IS NOT NULL AND ClientID IS NOT NULL GROUP BY ClientID, Category)),
sig_in AS (
  SELECT u.*, ln(1 + coalesce(ps.hist_txn, 0)) AS s1, ln(1 + coalesce(ps.hist_buyers, 0)) AS s2,
         coalesce(cp.pref_p, 0.0) AS content_score
  FROM unseen u LEFT JOIN prodsig ps ON u.ProductID = ps.ProductID
  LEFT JOIN catpref cp ON u.ClientID = cp.ClientID AND u.Category = cp.Category),
sig_mm AS (SELECT min(s1) AS l1, max(s1) AS h1, min(s2) AS l2, max(s2) AS h2 FROM sig_in),
scored AS (
  SELECT s.*, CASE WHEN h1 > l1 THEN (s1 - l1) / (h1 - l1) ELSE 0 END AS collab_score,
         CASE WHEN h2 > l2 THEN (s2 - l2) / (h2 - l2) ELSE 0 END AS popularity_score
  FROM sig_in s CROSS JOIN sig_mm),
scored2 AS (
  SELECT *, 0.6 * affinity_score + 0.2 * collab_score + 0.15 * content_score + 0.05 * popularity_score AS hybrid_score
  FROM scored),
cgroups AS (
  SELECT ClientID, CASE max(ClientGender) WHEN 'U' THEN 'Unisex' ELSE max(ClientGender) END AS ClientGender,
         max(Age) AS Age, max(ClientCountry) AS ClientCountry
  FROM hh WHERE ClientID IS NOT NULL GROUP BY ClientID),
withg AS (
  SELECT s.*, coalesce(g.ClientGender, 'UNKNOWN') AS grp FROM scored2 s LEFT JOIN cgroups g ON s.ClientID = g.ClientID),
base AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY ClientID ORDER BY hybrid_score DESC, ProductID) AS INTEGER) AS rank
                 FROM withg) WHERE rank <= {k}),
lmat AS (
  SELECT grp, Category, count(*) AS n, sum(count(*)) OVER (PARTITION BY grp) AS gt FROM base GROUP BY grp, Category),
lglob AS (
  SELECT Category, sum(n) / greatest((SELECT CAST(sum(n) AS DOUBLE) FROM lmat), 1.0) AS global_share
  FROM lmat WHERE Category IS NOT NULL GROUP BY Category),
lifts AS (SELECT m.grp, m.Category, g.global_share - m.n / CAST(m.gt AS DOUBLE) AS lift
          FROM lmat m LEFT JOIN lglob g ON m.Category = g.Category),
fairall AS (
  SELECT w.*, coalesce(l.lift, 0.0) AS lift, w.hybrid_score + 0.25 * coalesce(l.lift, 0.0) AS fair_score
  FROM withg w LEFT JOIN lifts l ON w.grp = l.grp AND w.Category = l.Category),
fair AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY ClientID ORDER BY fair_score DESC, ProductID) AS INTEGER) AS rank
                 FROM fairall) WHERE rank <= {k})
"""


def _vel():
    out = []
    for d in (30, 60):
        w = f"txn_date >= (SELECT test_end FROM cutoffs) - INTERVAL {d} DAY"
        out.append(f"""CASE WHEN count(*) FILTER (WHERE {w}) > 0
                THEN CAST(coalesce(sum(Quantity) FILTER (WHERE {w}), 0) AS BIGINT) END AS qty_{d}d,
           CASE WHEN count(*) FILTER (WHERE {w}) > 0
                THEN coalesce(CAST(sum(CAST(SalesNetAmountEuro AS DECIMAL(18,2))) FILTER (WHERE {w}) AS DOUBLE), 0.0) END AS eur_{d}d,
           CASE WHEN count(*) FILTER (WHERE {w}) > 0
                THEN CAST(count(txn_date) FILTER (WHERE {w}) AS BIGINT) END AS txns_{d}d,
           CASE WHEN count(*) FILTER (WHERE {w}) > 0
                THEN CAST(count(DISTINCT ClientID) FILTER (WHERE {w}) AS BIGINT) END AS buyers_{d}d""")
    return ",\n".join(out)


RECO = HH.format(uf=_user_features_sql("hist", "(SELECT test_end FROM cutoffs)"), vel=_vel(), k=K)

SPLIT_DOUBLES = ["u_eur_sum", "u_basket_mean", "u_basket_median", "u_month_entropy", "u_dow_entropy",
                 "p_eur_sum", "p_eur_30d", "p_eur_60d", "p_eur_per_qty", "cat_eur", "cat_txn_share",
                 "cat_eur_per_txn", "cp_eur_sum"]


def reco(name, doubles=None):
    return oracle(name, doubles, extra_ctes=RECO)


@reco("infer_cutoffs")
def _():
    return "SELECT train_end, val_end, test_end FROM cutoffs"


@reco("time_split_summary")
def _():
    return """
    SELECT split, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT ClientID) AS BIGINT) AS uniq_clients,
           CAST(count(DISTINCT ProductID) AS BIGINT) AS uniq_products, min(txn_date) AS min_date, max(txn_date) AS max_date
    FROM (SELECT c.*, CASE WHEN txn_date <= k.train_end THEN 'train' WHEN txn_date <= k.val_end THEN 'val'
                           WHEN txn_date <= k.test_end THEN 'test' END AS split
          FROM collapsed c CROSS JOIN cutoffs k)
    WHERE split IS NOT NULL GROUP BY split"""


@reco("positives_count_txn")
def _():
    return """SELECT ClientID, ProductID, 1 AS label, CAST(count(txn_date) AS BIGINT) AS target FROM win
              WHERE ClientID IS NOT NULL AND ProductID IS NOT NULL GROUP BY ClientID, ProductID
              HAVING count(txn_date) > 0"""


@reco("positives_sum_qty")
def _():
    return """SELECT ClientID, ProductID, 1 AS label, CAST(coalesce(sum(Quantity), 0) AS BIGINT) AS target FROM win
              WHERE ClientID IS NOT NULL AND ProductID IS NOT NULL GROUP BY ClientID, ProductID
              HAVING coalesce(sum(Quantity), 0) > 0"""


@reco("client_pref_category")
def _():
    return "SELECT ClientID, pref_category FROM pref"


@reco("product_popularity")
def _():
    return "SELECT ProductID, CAST(pop AS BIGINT) AS pop, Category, rank, cat_rank FROM pp"


@reco("negatives_pop")
def _():
    return "SELECT * FROM neg_pop"


@reco("negatives_pop_in_prefcat")
def _():
    return "SELECT * FROM neg_prefcat"


def _bits(text):
    return f"CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT)"


@reco("negatives_none")
def _():
    """Draws by hashed rank, then the hash order of the whole catalog for the clients left."""
    return f"""
    WITH d AS (SELECT m.ClientID, m.n, (SELECT count(*) FROM pp) AS nc,
                      (SELECT count(*) FROM (SELECT * FROM pos UNION SELECT * FROM seen) x
                       WHERE x.ClientID = m.ClientID) AS b FROM dem m),
    probe AS (SELECT ClientID, n, {_bits("'42|' || ClientID || '|' || j")} % nc + 1 AS rank, min(j) AS j
              FROM (SELECT *, unnest(generate_series(1, 2 * n + 64)) AS j FROM d WHERE nc > 4 * (n + b)) GROUP BY ALL),
    drawn AS (SELECT p.ClientID, u.ProductID, p.n, row_number() OVER (PARTITION BY p.ClientID ORDER BY p.j) AS r
              FROM probe p JOIN unblocked u ON u.ClientID = p.ClientID AND u.rank = p.rank),
    served AS (SELECT ClientID FROM drawn GROUP BY ClientID, n HAVING count(*) >= n),
    hashed AS (SELECT ClientID, ProductID, n, row_number() OVER (PARTITION BY ClientID
                 ORDER BY {_bits("'42|' || ClientID || '|' || ProductID")}, ProductID) AS r
               FROM unblocked WHERE ClientID NOT IN (SELECT ClientID FROM served))
    SELECT ClientID, ProductID, 0 AS label, CAST(r AS INTEGER) AS neg_order
    FROM (SELECT * FROM drawn WHERE ClientID IN (SELECT ClientID FROM served) UNION ALL
          SELECT ClientID, ProductID, n, r FROM hashed) WHERE r <= n"""


@reco("grouped_folds")
def _():
    return f"""SELECT ClientID, ProductID, label, CAST({_bits("'42|' || ClientID")} % 3 AS INTEGER) AS fold
               FROM ds"""


@reco("split_test_dataset", SPLIT_DOUBLES)
def _():
    return "SELECT * FROM ds"


@reco("split_summary")
def _():
    return """
    SELECT 'test' AS split, strftime((SELECT test_end FROM cutoffs), '%Y-%m-%d') AS cutoff, 30 AS label_days,
           CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT ClientID) AS BIGINT) AS clients,
           CAST(count(DISTINCT ProductID) AS BIGINT) AS products,
           CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS positives,
           CAST(count(*) FILTER (WHERE label = 0) AS BIGINT) AS negatives,
           5.0 AS neg_per_pos, 'pop_in_prefcat' AS hard_negatives, 'binary' AS pos_target
    FROM ds"""


@reco("scored_candidates", ["affinity_score", "collab_score", "content_score", "popularity_score", "hybrid_score"])
def _():
    return """SELECT ClientID, ProductID, label, Category, affinity_score, collab_score, content_score,
                     popularity_score, hybrid_score FROM scored2"""


@reco("recommendations_base", ["hybrid_score"])
def _():
    return "SELECT ClientID, ProductID, Category, hybrid_score, rank FROM base"


@reco("recommendations_fair", ["hybrid_score", "lift", "fair_score"])
def _():
    return """SELECT ClientID, ProductID, Category, grp AS ClientGender, hybrid_score, lift, fair_score, rank
              FROM fair"""


@reco("client_groups", ["Age"])
def _():
    return "SELECT * FROM cgroups"


def _exposure(src, score):
    return f"""
    SELECT grp AS ClientGender, CAST(count(ProductID) AS BIGINT) AS exposure_rows,
           CAST(count(DISTINCT ProductID) AS BIGINT) AS unique_items, avg({score}) AS avg_score,
           quantile_cont({score}, 0.5) AS median_score, CAST(count(DISTINCT ClientID) AS BIGINT) AS clients,
           count(ProductID) / CAST(greatest((SELECT count(*) FROM {src}), 1) AS DOUBLE) AS exposure_share,
           coalesce(count(ProductID) / nullif(CAST(count(DISTINCT ClientID) AS DOUBLE), 0), 0.0) AS rows_per_client
    FROM {src} GROUP BY grp"""


EXPOSURE_DOUBLES = ["avg_score", "median_score", "exposure_share", "rows_per_client"]


@reco("fairness_exposure_pre", EXPOSURE_DOUBLES)
def _():
    return _exposure("base", "hybrid_score")


@reco("fairness_exposure_post", EXPOSURE_DOUBLES)
def _():
    return _exposure("fair", "fair_score")


def _l1(src):
    """Per group: sum over the union of categories of |global - group| (brute-force grid)."""
    return f"""
    SELECT g.grp AS ClientGender,
           sum(abs(coalesce(gl.gs, 0.0) - coalesce(m.share, 0.0))) AS category_l1_distance
    FROM (SELECT DISTINCT grp FROM {src}) g
    CROSS JOIN (SELECT DISTINCT Category FROM {src}) c
    LEFT JOIN (SELECT grp, Category, count(*) / CAST(sum(count(*)) OVER (PARTITION BY grp) AS DOUBLE) AS share
               FROM {src} GROUP BY grp, Category) m
      ON m.grp = g.grp AND m.Category IS NOT DISTINCT FROM c.Category
    LEFT JOIN (SELECT Category, count(*) / CAST(greatest((SELECT count(*) FROM {src}), 1) AS DOUBLE) AS gs
               FROM {src} WHERE Category IS NOT NULL GROUP BY Category) gl
      ON gl.Category = c.Category
    GROUP BY g.grp"""


@reco("category_parity_pre", ["category_l1_distance"])
def _():
    return _l1("base")


def _summary(src, score, variant):
    return f"""
    SELECT coalesce(max(exposure_share) - min(exposure_share), 0.0) AS max_gap,
           CASE WHEN max(exposure_share) IS NULL OR max(exposure_share) = 0 THEN 1.0
                ELSE min(exposure_share) / max(exposure_share) END AS min_max_ratio,
           (SELECT coalesce(avg(category_l1_distance), 0.0) FROM ({_l1(src)})) AS mean_category_l1,
           '{variant}' AS variant
    FROM ({_exposure(src, score)})"""


@reco("fairness_summary", ["max_gap", "min_max_ratio", "mean_category_l1"])
def _():
    return _summary("base", "hybrid_score", "pre") + "\nUNION ALL\n" + _summary("fair", "fair_score", "post")


def _focus(src):
    return f"(SELECT * FROM {src} WHERE grp IN ('Male', 'Female'))"


@reco("fairness_focus_summary", ["max_gap", "min_max_ratio", "mean_category_l1"])
def _():
    return (_summary(_focus("base"), "hybrid_score", "pre") + "\nUNION ALL\n"
            + _summary(_focus("fair"), "fair_score", "post"))


@reco("fairness_drift", ["pre_max_gap", "post_max_gap", "pre_min_max_ratio", "post_min_max_ratio"])
def _():
    def row(name, focus):
        pre = _summary(focus("base"), "hybrid_score", "pre")
        post = _summary(focus("fair"), "fair_score", "post")
        return f"""SELECT '{name}' AS report, (SELECT test_end FROM cutoffs) AS generated_at,
                   a.max_gap AS pre_max_gap, b.max_gap AS post_max_gap,
                   a.min_max_ratio AS pre_min_max_ratio, b.min_max_ratio AS post_min_max_ratio
                   FROM ({pre}) a CROSS JOIN ({post}) b"""
    return row("reco_test", str) + "\nUNION ALL\n" + row("reco_test_focus", _focus)


@reco("category_exposure_matrix", ["exposure_share"])
def _():
    return """
    SELECT grp AS ClientGender, Category, CAST(count(*) AS BIGINT) AS n,
           CAST(sum(count(*)) OVER (PARTITION BY grp) AS BIGINT) AS group_total,
           count(*) / CAST(sum(count(*)) OVER (PARTITION BY grp) AS DOUBLE) AS exposure_share
    FROM base GROUP BY grp, Category"""


@reco("category_lift", ["lift"])
def _():
    return "SELECT grp AS ClientGender, Category, lift FROM lifts"


@reco("sample_weights", ["sample_weight"])
def _():
    return """
    WITH d AS (SELECT x.ClientID, x.ProductID, x.label, coalesce(g.ClientGender, 'UNKNOWN') AS ClientGender
               FROM ds x LEFT JOIN cgroups g ON x.ClientID = g.ClientID),
    c AS (SELECT ClientGender, count(*) AS cnt FROM d WHERE ClientGender IN ('Male', 'Female') GROUP BY ClientGender),
    s AS (SELECT sum(cnt) / CAST(count(*) AS DOUBLE) AS scale FROM c)
    SELECT d.*, CASE WHEN d.ClientGender IN ('Male', 'Female')
                     THEN least(greatest((SELECT scale FROM s) / c.cnt, 0.2), 5.0) ELSE 1.0 END AS sample_weight
    FROM d LEFT JOIN c ON d.ClientGender = c.ClientGender"""


def _per_client(src, k=K):
    return f"""
    SELECT t.ClientID, t.hits, coalesce(pc.pos_total, 0) AS pos_total, t.ap_sum, t.dcg
    FROM (SELECT r.ClientID, sum(coalesce(l.label, 0)) AS hits,
                 sum(CASE WHEN coalesce(l.label, 0) = 1 THEN r.cum / r.rank END) AS ap_sum,
                 sum(coalesce(l.label, 0) / log2(r.rank + 1)) AS dcg
          FROM (SELECT b.ClientID, b.ProductID, b.rank,
                       sum(coalesce(l2.label, 0)) OVER (PARTITION BY b.ClientID ORDER BY b.rank) AS cum
                FROM {src} b LEFT JOIN ds l2 ON b.ClientID = l2.ClientID AND b.ProductID = l2.ProductID
                WHERE b.rank <= {k}) r
          LEFT JOIN ds l ON r.ClientID = l.ClientID AND r.ProductID = l.ProductID
          GROUP BY r.ClientID) t
    LEFT JOIN (SELECT ClientID, count(*) AS pos_total FROM ds WHERE label = 1 GROUP BY ClientID) pc
      ON t.ClientID = pc.ClientID"""


def _metrics(src, k=K):
    idcg = f"(SELECT sum(1.0 / log2(i + 1)) FROM range(1, least({k}, pos_total) + 1) AS t(i))"
    return f"""
    SELECT count(*) AS clients,
           avg(hits / {float(k)}) AS precision,
           coalesce(avg(CASE WHEN pos_total > 0 THEN hits / CAST(pos_total AS DOUBLE) END), 0.0) AS recall,
           coalesce(avg(CASE WHEN pos_total > 0 THEN coalesce(ap_sum, 0.0) / least({k}, pos_total) END), 0.0) AS map,
           coalesce(avg(CASE WHEN pos_total > 0 THEN dcg / {idcg} END), 0.0) AS ndcg,
           avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END) AS hitrate
    FROM ({_per_client(src, k)})"""


def _long(src, k=K):
    m = _metrics(src, k)
    return f"""
    SELECT metric, value FROM (
      SELECT 'clients' AS metric, CAST(clients AS DOUBLE) AS value FROM ({m})
      UNION ALL SELECT 'precision@{k}', precision FROM ({m})
      UNION ALL SELECT 'recall@{k}', recall FROM ({m})
      UNION ALL SELECT 'map@{k}', map FROM ({m})
      UNION ALL SELECT 'ndcg@{k}', ndcg FROM ({m})
      UNION ALL SELECT 'hitrate@{k}', hitrate FROM ({m}))"""


@reco("eval_base", ["value"])
def _():
    return _long("base")


@reco("eval_base_vs_fair", ["base", "fair", "delta_fair_minus_base"])
def _():
    return f"""
    SELECT b.metric, b.value AS base, f.value AS fair, f.value - b.value AS delta_fair_minus_base
    FROM ({_long("base")}) b JOIN ({_long("fair")}) f ON b.metric = f.metric
    WHERE b.metric <> 'clients'"""


@reco("group_ranking_metrics", ["recall_at_k", "map_at_k"])
def _():
    return f"""
    WITH r AS (SELECT ClientID, label, row_number() OVER (PARTITION BY ClientID ORDER BY affinity_score DESC, ProductID) AS pos
               FROM aff),
    g AS (SELECT ClientID, sum(label) AS n_pos, sum(label) FILTER (WHERE pos <= {K}) AS hits FROM r GROUP BY ClientID),
    ap AS (SELECT ClientID, sum(cum / CAST(pos AS DOUBLE)) AS ap FROM (
             SELECT ClientID, label, pos, sum(label) OVER (PARTITION BY ClientID ORDER BY pos) AS cum
             FROM r WHERE pos <= {K}) WHERE label = 1 GROUP BY ClientID)
    SELECT coalesce(avg(CASE WHEN n_pos > 0 THEN hits / CAST(least({K}, n_pos) AS DOUBLE) END), 0.0) AS recall_at_k,
           coalesce(avg(CASE WHEN hits > 0 THEN ap.ap / hits END), 0.0) AS map_at_k
    FROM g LEFT JOIN ap ON g.ClientID = ap.ClientID"""


@reco("class_weight", ["scale_pos_weight"])
def _():
    return """SELECT CASE WHEN count(*) FILTER (WHERE label = 1) > 0
                     THEN count(*) FILTER (WHERE label = 0) / CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE)
                     ELSE 1.0 END AS scale_pos_weight FROM ds"""


_BLOCKS = {
    "u": ["u_txns", "u_qty_sum", "u_eur_sum", "u_recency_days", "u_basket_mean", "u_basket_median",
          "u_n_products", "u_n_categories", "u_n_stores", "u_pref_store_country", "u_pref_client_country",
          "u_top_category", "u_top_family_lvl1", "u_month_entropy", "u_dow_entropy", "u_customer_age_days"],
    "p": ["p_txns", "p_buyers", "p_qty_sum", "p_eur_sum", "p_qty_30d", "p_eur_30d", "p_txns_30d", "p_buyers_30d",
          "p_qty_60d", "p_eur_60d", "p_txns_60d", "p_buyers_60d", "p_eur_per_qty", "p_product_age_days",
          "p_days_since_sold"],
    "cp": ["cp_txns", "cp_qty_sum", "cp_eur_sum", "cp_days_since_last_cp", "cp_tenure_days"],
    "cat": ["cat_txns", "cat_buyers", "cat_qty", "cat_eur", "cat_txn_share", "cat_eur_per_txn"],
}


@reco("split_validation", ["rows", "clients", "products", "positives", "negatives", "pos_ratio", "label_days",
                           "pos_not_in_window", "neg_seen_violations", "clients_checked", "target_mismatch_pairs",
                           "u_null_share", "p_null_share", "cp_null_share", "cat_null_share", "pair_duplicates"])
def _():
    shares = ",\n".join(
        "(" + " + ".join(f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)" for c in cols) + f") / {len(cols)}"
        f" AS {b}_null_share" for b, cols in _BLOCKS.items())
    return f"""
    WITH v AS (
      SELECT CAST(count(*) AS DOUBLE) AS rows, CAST(count(DISTINCT ClientID) AS DOUBLE) AS clients,
             CAST(count(DISTINCT ProductID) AS DOUBLE) AS products,
             CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS positives,
             CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) AS negatives,
             CAST(count(*) FILTER (WHERE label = 1 AND target <> 1) AS DOUBLE) AS target_mismatch_pairs,
             {shares}
      FROM ds),
    x AS (SELECT
      (SELECT CAST(count(*) AS DOUBLE) FROM (SELECT DISTINCT ClientID, ProductID FROM ds WHERE label = 1) p
        WHERE NOT EXISTS (SELECT 1 FROM win w WHERE w.ClientID = p.ClientID AND w.ProductID = p.ProductID))
        AS pos_not_in_window,
      (SELECT CAST(count(*) AS DOUBLE) FROM (SELECT DISTINCT ClientID, ProductID FROM ds WHERE label = 0) n
        WHERE EXISTS (SELECT 1 FROM hh h WHERE h.ClientID = n.ClientID AND h.ProductID = n.ProductID))
        AS neg_seen_violations,
      (SELECT CAST(count(DISTINCT ClientID) AS DOUBLE) FROM ds WHERE label = 0) AS clients_checked,
      (SELECT CAST(coalesce(sum(c), 0) AS DOUBLE) FROM (SELECT count(*) AS c FROM ds GROUP BY ClientID, ProductID
                                                       HAVING count(*) > 1)) AS pair_duplicates)
    SELECT 'test' AS split, strftime((SELECT test_end FROM cutoffs), '%Y-%m-%d') AS cutoff, 30.0 AS label_days,
           'binary' AS pos_target, rows, clients, products, positives, negatives,
           positives / greatest(rows, 1.0) AS pos_ratio,
           pos_not_in_window = 0 AS pos_in_window_ok, pos_not_in_window,
           neg_seen_violations = 0 AS neg_not_seen_ok, neg_seen_violations, clients_checked,
           target_mismatch_pairs = 0 AS target_check_ok, target_mismatch_pairs,
           u_null_share, p_null_share, cp_null_share, cat_null_share,
           pair_duplicates = 0 AS pair_unique_ok, pair_duplicates
    FROM v CROSS JOIN x"""


def _every_split(name):
    """The query of the test split for all three: an earlier split is the test split of earlier cutoffs."""
    def at(split, days):
        sql = ORACLE[name].replace("max(txn_date) - INTERVAL 30 DAY AS DATE) AS TIMESTAMP) AS test_end",
                                   f"max(txn_date) - INTERVAL {days} DAY AS DATE) AS TIMESTAMP) AS test_end")
        return "SELECT * FROM (" + sql.replace("'test' AS split", f"'{split}' AS split") + ")"
    ORACLE[name] = "\nUNION ALL\n".join(at(s, d) for s, d in (("train", 90), ("val", 60), ("test", 30)))


_every_split("split_summary")
_every_split("split_validation")
