"""Exposure audit, category parity, fairness re-rank and sample weights.

Groups and categories are small dimensions: the per-group and per-(group,
category) aggregates are tiny, and the L1 distance is computed without a
groups x categories grid (absent categories contribute their global share).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairrank.config import OTHERS_WEIGHT, UNKNOWN, WEIGHT_CLIP
from fairrank.functions.columns import clip_range, safe_ratio
from fairrank.operators.order import exact_quantiles
from fairrank.operators.scoring import top_k


def attach_group_labels(recs: DataFrame, client_groups: DataFrame, group_col: str) -> DataFrame:
    """Client -> group (NULL -> UNKNOWN); of a client's several groups the smallest counts."""
    if group_col in recs.columns:
        return recs.withColumn(group_col, F.coalesce(F.col(group_col).cast("string"), F.lit(UNKNOWN)))
    g = client_groups.groupBy("ClientID").agg(F.min(group_col).alias(group_col))
    return (recs.join(g, "ClientID", "left")
                .withColumn(group_col, F.coalesce(F.col(group_col).cast("string"), F.lit(UNKNOWN))))


def exposure_by_group(recs: DataFrame, group_col: str, item_col: str = "ProductID",
                      score_col: str = "hybrid_score") -> DataFrame:
    """Rows, unique items, mean / median score, clients, share, rows per client."""
    total = recs.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("__total"))
    g = recs.groupBy(group_col).agg(
        F.count(item_col).alias("exposure_rows"),
        F.count_distinct(item_col).alias("unique_items"),
        F.avg(score_col).alias("avg_score"),
        F.count_distinct("ClientID").alias("clients"))
    medians = exact_quantiles(recs.select(F.col(group_col).alias("grp"), F.col(score_col).cast("double").alias("value")), (0.5,))
    g = (g.join(medians, F.col(group_col).eqNullSafe(F.col("grp")), "left")
          .select(group_col, "exposure_rows", "unique_items", "avg_score", F.col("q")[0].alias("median_score"), "clients"))
    return (g.crossJoin(F.broadcast(total))  # single-row scalar
             .withColumns({"exposure_share": F.col("exposure_rows") / F.col("__total"),
                           "rows_per_client": safe_ratio("exposure_rows", "clients", 0.0)})
             .drop("__total"))


def category_exposure_matrix(recs: DataFrame, group_col: str, category_col: str = "Category") -> DataFrame:
    """(group, category) counts and the category's share within the group
    (a NULL category is kept as its own cell)."""
    m = recs.groupBy(group_col, category_col).agg(F.count(F.lit(1)).alias("n"))
    m = m.withColumn("group_total", F.sum("n").over(Window.partitionBy(group_col)))
    return m.withColumn("exposure_share", F.coalesce(F.try_divide(F.col("n"), F.col("group_total")), F.lit(0.0)))


def parity_metrics(exposure: DataFrame, share_col: str = "exposure_share") -> DataFrame:
    """Max - min share and min / max ratio (empty -> 0 and 1)."""
    a = exposure.agg(F.max(share_col).alias("mx"), F.min(share_col).alias("mn"))
    return a.select(
        F.coalesce(F.col("mx") - F.col("mn"), F.lit(0.0)).alias("max_gap"),
        F.when(F.col("mx").isNull(), F.lit(1.0))
         .when(F.col("mx") == 0, F.lit(1.0))
         .otherwise(F.col("mn") / F.col("mx")).alias("min_max_ratio"))


def global_category_share(matrix: DataFrame, category_col: str = "Category") -> DataFrame:
    """Share of each non-NULL category over ALL cells (NULL kept in the denominator)."""
    total = matrix.agg(F.greatest(F.sum("n").cast("double"), F.lit(1.0)).alias("__tot"))
    return (matrix.where(F.col(category_col).isNotNull()).groupBy(category_col)
                  .agg(F.sum("n").alias("__gn"))
                  .crossJoin(F.broadcast(total))  # single-row scalar
                  .select(category_col, (F.col("__gn") / F.col("__tot")).alias("global_share")))


def category_parity_distance(matrix: DataFrame, group_col: str, category_col: str = "Category",
                             share_col: str = "exposure_share") -> DataFrame:
    """Per group sum over the union of categories of |global - group|.

    = sum over the group's cells |g - s| + (sum of global shares of
    categories the group lacks), computed as  sum|g - s| + G - sum(g)."""
    gs = global_category_share(matrix, category_col)
    g_total = gs.agg(F.coalesce(F.sum("global_share"), F.lit(0.0)).alias("__G"))
    j = matrix.join(gs, category_col, "left").withColumn("__g", F.coalesce("global_share", F.lit(0.0)))
    per = j.groupBy(group_col).agg(F.sum(F.abs(F.col("__g") - F.col(share_col))).alias("__d"),
                                   F.sum("__g").alias("__gin"))
    return (per.crossJoin(F.broadcast(g_total))  # single-row scalar
               .select(group_col, (F.col("__d") + F.col("__G") - F.col("__gin")).alias("category_l1_distance")))


def fairness_report(recs: DataFrame, client_groups: DataFrame, group_col: str,
                    item_col: str = "ProductID", category_col: str = "Category",
                    score_col: str = "hybrid_score") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(exposure by group, L1 distance by group, one-row summary)."""
    wg = attach_group_labels(recs, client_groups, group_col)
    exp = exposure_by_group(wg, group_col, item_col, score_col)
    mat = category_exposure_matrix(wg, group_col, category_col)
    par = category_parity_distance(mat, group_col, category_col)
    mean_l1 = par.agg(F.coalesce(F.avg("category_l1_distance"), F.lit(0.0)).alias("mean_category_l1"))
    summary = parity_metrics(exp).crossJoin(mean_l1)  # both single-row
    return exp, par, summary


def category_lift_table(top: DataFrame, group_col: str, category_col: str = "Category") -> DataFrame:
    """lift = global_share(category) - group_share(category) on the top-K."""
    mat = category_exposure_matrix(top, group_col, category_col)
    gs = global_category_share(mat, category_col)
    return (mat.join(gs, category_col, "left")
               .select(group_col, category_col, (F.col("global_share") - F.col("exposure_share")).alias("lift")))


def rerank_for_exposure_balance(scored: DataFrame, client_groups: DataFrame, group_col: str,
                                top_k_n: int = 10, lambda_fairness: float = 0.25,
                                score_col: str = "hybrid_score", category_col: str = "Category",
                                eligible_groups: list[str] | None = None) -> DataFrame:
    """fair_score = score + lambda * lift(group, category) over ALL
    candidates, then a new top-K.  Lift comes from the base top-K of the
    eligible groups; (group, category) cells absent there get lift 0.  The
    caller chooses the columns, so the lift table has no proven size: AQE
    broadcasts it only if it is measured to be small."""
    wg = attach_group_labels(scored, client_groups, group_col)
    top = top_k(wg, top_k_n, score_col)
    if eligible_groups is not None:
        top = top.where(F.col(group_col).isin(list(eligible_groups)))
    lifts = category_lift_table(top, group_col, category_col)
    out = (wg.join(lifts, [group_col, category_col], "left")
             .withColumn("lift", F.coalesce(F.col("lift"), F.lit(0.0)))
             .withColumn("fair_score", F.col(score_col) + F.lit(float(lambda_fairness)) * F.col("lift")))
    return top_k(out, top_k_n, "fair_score")


def sample_weights(df: DataFrame, group_col: str, eligible_groups: Iterable[str] | None = None,
                   others_weight: float = OTHERS_WEIGHT, clip: tuple[float, float] = WEIGHT_CLIP,
                   out_col: str = "sample_weight") -> DataFrame:
    """Inverse-frequency weight inside eligible groups,
    clip((N_eligible / n_groups) / count(group), lo, hi); others ``others_weight``."""
    g = F.coalesce(F.col(group_col).cast("string"), F.lit(UNKNOWN))
    d = df.withColumn("__grp", g)
    elig = F.col("__grp").isin(list(eligible_groups)) if eligible_groups is not None else F.lit(True)
    d = d.withColumn("__elig", elig)
    counts = d.where("__elig").groupBy("__grp").agg(F.count(F.lit(1)).alias("__cnt"))
    scale = counts.agg((F.sum("__cnt") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("__scale"))
    w = (counts.crossJoin(scale)  # groups x one row
               .select("__grp", clip_range(F.col("__scale") / F.col("__cnt"), clip[0], clip[1]).alias("__w")))
    out = d.join(w, "__grp", "left")
    return (out.withColumn(out_col, F.when(F.col("__elig"), F.col("__w")).otherwise(F.lit(float(others_weight))))
               .drop("__grp", "__elig", "__w"))
