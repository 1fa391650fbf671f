"""Registered queries: ingest, interactions, duplicates, quality, features."""

from __future__ import annotations

from fairrank.operators import dedupe, features
from fairrank.operators.interactions import orphan_counts, stock_availability
from fairrank.plans.registry import Context, query


# --- interactions / duplicates ---------------------------------------------
@query("interactions")
def q_interactions(ctx: Context):
    """J1+J2+C11+C22: the 25-column interactions table."""
    return ctx.interactions


@query("stock_availability")
def q_stock_availability(ctx: Context):
    """Q1: summed stock and availability flag per (country, product)."""
    t = ctx.canonical
    return stock_availability(t["stocks"], t["products"])


@query("orphan_counts")
def q_orphans(ctx: Context):
    """Orphan transactions per dimension + stock rows of unknown products."""
    t = ctx.canonical
    return orphan_counts(t["transactions"], t["clients"], t["products"], t["stores"], t["stocks"])


@query("collapsed_interactions")
def q_collapsed(ctx: Context):
    """Q15: interactions with collapsible duplicate groups folded (dup_count)."""
    return ctx.collapsed


@query("collapse_metrics")
def q_collapse_metrics(ctx: Context):
    """Q15 metrics row."""
    return ctx.prepared[2]


@query("collapsible_groups_c_p_d")
def q_collapsible_cpd(ctx: Context):
    """Q14 at client-product-date level (store must be single-valued)."""
    return dedupe.find_collapsible_groups(ctx.interactions, "c_p_d")


@query("dup_cluster_summary")
def q_dup_summary(ctx: Context):
    """Q12+Q13: cluster summaries at both key levels (U1 union)."""
    i = ctx.interactions
    k1 = ["ClientID", "ProductID", "txn_date", "StoreID"]
    k2 = ["ClientID", "ProductID", "txn_date"]
    return (dedupe.summary_from_clusters(dedupe.describe_dup_clusters(i, k1), "by_client_product_date_store")
            .unionByName(dedupe.summary_from_clusters(dedupe.describe_dup_clusters(i, k2),
                                                      "by_client_product_date")))


@query("heaviest_clusters")
def q_heaviest(ctx: Context):
    """Rows of the 10 largest (client, product, date, store) clusters."""
    return dedupe.heaviest_clusters(ctx.interactions, ["ClientID", "ProductID", "txn_date", "StoreID"], 10)


# --- features at the test cutoff --------------------------------------------
@query("user_features")
def q_user_features(ctx: Context):
    """F1-F6 at the inferred test cutoff."""
    return features.user_features(ctx.history, ctx.cutoffs.test_end)


@query("product_features")
def q_product_features(ctx: Context):
    """F7-F9 at the inferred test cutoff."""
    return features.product_features(ctx.history, ctx.cutoffs.test_end)


@query("user_rfm")
def q_user_rfm(ctx: Context):
    """F10 at the inferred test cutoff."""
    return features.user_rfm(ctx.history, ctx.cutoffs.test_end)


@query("client_product_recency")
def q_cp_recency(ctx: Context):
    """F11 at the inferred test cutoff."""
    return features.client_product_recency(ctx.history, ctx.cutoffs.test_end)


@query("category_features")
def q_category_features(ctx: Context):
    """F12+F13 at the inferred test cutoff."""
    return features.category_features(ctx.history, ctx.cutoffs.test_end)


@query("user_features_all_history")
def q_user_features_nocut(ctx: Context):
    """F6 without a cutoff (reference date = latest transaction)."""
    return features.user_features(ctx.history, None)
