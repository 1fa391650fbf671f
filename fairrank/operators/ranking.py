"""Offline ranking metrics (E1-E8, E13) as window + aggregate plans.

Per-client metrics are one pass over the top-k rows: a running hit count
(window over the client's positions) feeds precision, recall, AP and DCG; the
ideal DCG is a closed-form sum over ``min(k, positives)`` positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["ClientID", "ProductID"]


def _idcg(m: Column) -> Column:
    """sum_{i=1..m} 1 / log2(i + 1) (NULL/0 -> 0)."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1)).cast("int")), F.lit(0.0),
                       lambda acc, i: acc + F.lit(1.0) / F.log2(i + F.lit(1)))


def prepare_top_k(recs: DataFrame, labels: DataFrame, k: int, score_col: str = "hybrid_score") -> DataFrame:
    """Attach labels (missing -> 0) unless present, order by rank (else
    score desc), keep the first k per client with their position."""
    df = recs
    if "label" not in df.columns:
        df = df.join(labels.select(*PAIR, "label"), PAIR, "left")
    df = df.withColumn("label", F.coalesce(F.col("label"), F.lit(0)).cast("int"))
    if "rank" in df.columns:
        order = [F.asc("rank"), F.asc("ProductID")]
    elif score_col in df.columns:
        order = [F.desc(score_col), F.asc("ProductID")]
    else:
        raise ValueError(f"cannot order the lists: no column rank and no column {score_col}")
    w = Window.partitionBy("ClientID").orderBy(*order)
    return df.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def per_client_metrics(recs: DataFrame, labels: DataFrame, k: int = 10,
                       score_col: str = "hybrid_score") -> DataFrame:
    """E2-E5 per client: hits, precision, recall, AP, NDCG, hitrate."""
    top = prepare_top_k(recs, labels, k, score_col)
    w = Window.partitionBy("ClientID").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    top = top.withColumn("cum_hits", F.sum("label").over(w))
    pos_tot = (labels.where(F.col("label") == 1).groupBy("ClientID")
                     .agg(F.count(F.lit(1)).alias("pos_total")))
    pc = top.groupBy("ClientID").agg(
        F.sum("label").alias("hits"),
        F.sum(F.when(F.col("label") == 1, F.col("cum_hits") / F.col("pos"))).alias("ap_sum"),
        F.sum(F.col("label") / F.log2(F.col("pos") + 1)).alias("dcg"))
    pc = pc.join(pos_tot, "ClientID", "left").withColumn("pos_total", F.coalesce("pos_total", F.lit(0)))
    has = F.col("pos_total") > 0
    denom = F.least(F.lit(k), F.col("pos_total"))
    return pc.select(
        "ClientID", "hits", "pos_total",
        (F.col("hits") / F.lit(float(k))).alias("precision"),
        F.when(has, F.col("hits") / F.col("pos_total")).alias("recall"),
        F.when(has, F.coalesce(F.col("ap_sum"), F.lit(0.0)) / denom).alias("map"),
        F.when(has, F.col("dcg") / _idcg(denom)).alias("ndcg"),
        F.when(F.col("hits") > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("hitrate"),
        has.cast("int").alias("has_positive"))


def evaluate_recommendations(recs: DataFrame, labels: DataFrame, k: int = 10,
                             score_col: str = "hybrid_score") -> DataFrame:
    """E2-E5 averaged: long format (metric, value).  Precision and hitrate
    average over all recommended clients; recall, MAP and NDCG over clients
    with at least one positive (0 when there are none)."""
    pc = per_client_metrics(recs, labels, k, score_col)
    a = pc.agg(
        F.count(F.lit(1)).cast("double").alias("clients"),
        F.coalesce(F.avg("precision"), F.lit(0.0)).alias(f"precision@{k}"),
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias(f"recall@{k}"),
        F.coalesce(F.avg("map"), F.lit(0.0)).alias(f"map@{k}"),
        F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias(f"ndcg@{k}"),
        F.coalesce(F.avg("hitrate"), F.lit(0.0)).alias(f"hitrate@{k}"))
    names = ["clients", f"precision@{k}", f"recall@{k}", f"map@{k}", f"ndcg@{k}", f"hitrate@{k}"]
    return a.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value"))
                                        for n in names])))


def compare_base_vs_fair(base: DataFrame, fair: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """Metric, base, fair, delta_fair_minus_base (clients row excluded)."""
    b = evaluate_recommendations(base, labels, k, "hybrid_score").withColumnRenamed("value", "base")
    f = evaluate_recommendations(fair, labels, k, "fair_score").withColumnRenamed("value", "fair")
    return (b.join(f, "metric").where(F.col("metric") != "clients")
             .withColumn("delta_fair_minus_base", F.col("fair") - F.col("base")))


# ---------------------------------------------------------------------------
# Training-flavoured group metrics (E7, E8) and class weight
# ---------------------------------------------------------------------------
def group_ranking_metrics(scored: DataFrame, k: int = 10, score_col: str = "score",
                          label_col: str = "label", group_col: str = "ClientID") -> DataFrame:
    """E7 recall@k (hits / min(k, positives in the group's candidates), groups
    without positives skipped) and E8 MAP@k (denominator = positives inside
    the top k; groups with none skipped).  One row: recall_at_k, map_at_k."""
    w = Window.partitionBy(group_col).orderBy(F.desc(score_col), F.asc("ProductID"))
    df = scored.withColumn("pos", F.row_number().over(w))
    df = df.withColumn("cum", F.sum(F.when(F.col("pos") <= k, F.col(label_col)).otherwise(0))
                       .over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = df.groupBy(group_col).agg(
        F.sum(label_col).alias("n_pos"),
        F.sum(F.when(F.col("pos") <= k, F.col(label_col))).alias("hits"),
        F.sum(F.when((F.col("pos") <= k) & (F.col(label_col) == 1), F.col("cum") / F.col("pos"))).alias("ap"))
    rec = F.when(F.col("n_pos") > 0, F.col("hits") / F.least(F.lit(k), F.col("n_pos")))
    mp = F.when(F.col("hits") > 0, F.col("ap") / F.col("hits"))
    return g.agg(F.coalesce(F.avg(rec), F.lit(0.0)).alias("recall_at_k"),
                 F.coalesce(F.avg(mp), F.lit(0.0)).alias("map_at_k"))


def class_imbalance_weight(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Negatives / positives (1.0 when there are no positives)."""
    a = df.agg(F.count_if(F.col(label_col) == 1).alias("pos"), F.count_if(F.col(label_col) == 0).alias("neg"))
    return a.select(F.when(F.col("pos") > 0, F.col("neg") / F.col("pos")).otherwise(F.lit(1.0))
                     .alias("scale_pos_weight"))
