"""Leakage-safe feature builders at a cutoff.

Every builder filters ``txn_date < cutoff`` first (pushed into the scan) and
measures elapsed days against ``ref_date = cutoff`` (or the latest date when
no cutoff is given).

Scale notes
* Per-client "profile" statistics (distinct products / stores / categories,
  four modes, two calendar entropies) come from two exploded
  ``(client, dimension, value) -> count`` aggregations (numbers, and the
  modes of texts) instead of eight separate group-bys; the explode runs inside whole-stage codegen and the
  partial aggregation happens map-side, so a hot client is pre-combined.
* Distinct counts with conditions (product buyers overall / in trailing
  windows) use a two-level aggregation (pair level, then product level)
  rather than several ``countDistinct``, which would trigger an Expand.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairrank.functions.columns import (clip_lower0, elapsed_days_clipped, money_sum,
                                        safe_ratio)
from fairrank.operators.interactions import apply_cutoff


def with_ref_date(agg: DataFrame, source: DataFrame, cutoff: str | None) -> DataFrame:
    """Attach ``__ref`` (cutoff, else the latest txn_date of ``source``)."""
    if cutoff:
        return agg.withColumn("__ref", F.lit(cutoff).cast("timestamp_ntz"))
    ref = source.agg(F.max("txn_date").alias("__ref"))
    return agg.crossJoin(F.broadcast(ref))  # single-row scalar


def _keys_not_null(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.where(cond)


def _zsum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def _zmoney(c: Column | str) -> Column:
    return F.coalesce(money_sum(c), F.lit(0.0))


# ---------------------------------------------------------------------------
# F1-F6 user features
# ---------------------------------------------------------------------------
def profile_dims() -> dict[str, Column]:
    """dimension -> value expression (NULL values are dropped)."""
    return {
        "product": F.col("ProductID").cast("string"),
        "store": F.col("StoreID").cast("string"),
        "category": F.col("Category"),
        "family1": F.col("FamilyLevel1"),
        "store_country": F.col("StoreCountry"),
        "client_country": F.col("ClientCountry"),
        "month": F.month("txn_date").cast("string"),
        "dow": F.weekday("txn_date").cast("string"),
    }


def client_profile_counts(df: DataFrame, key: str = "ClientID",
                          dims: dict[str, Column] | None = None) -> DataFrame:
    """(key, dim, val, n): row counts per key and value of every dimension."""
    dims = dims or profile_dims()
    arr = F.array(*[F.struct(F.lit(d).alias("dim"), v.cast("string").alias("val"))
                    for d, v in dims.items()])
    return (df.select(key, F.inline(arr))
              .where(F.col("val").isNotNull())
              .groupBy(key, "dim", "val").agg(F.count(F.lit(1)).alias("n")))


def _mode(dim: str) -> Column:
    """The value of ``dim`` among a client's first values."""
    return F.max(F.when(F.col("dim") == dim, F.col("val")))


def client_modes(counts: DataFrame, key: str = "ClientID") -> DataFrame:
    """(key, dim, val): the most frequent value of every dimension; ties -> smallest value.

    A sort that stops at the first row of a group: an aggregate over text takes no hash table."""
    first = F.row_number().over(Window.partitionBy(key, "dim").orderBy(F.desc("n"), F.asc("val")))
    return counts.withColumn("__nth", first).where(F.col("__nth") == 1).drop("__nth", "n")


def _distinct(dim: str) -> Column:
    return F.count_if(F.col("dim") == dim)


def _entropy(dim: str) -> Column:
    """-sum p ln p = ln N - sum(n ln n) / N over the value counts of ``dim``."""
    on = F.col("dim") == dim
    n_tot = F.sum(F.when(on, F.col("n")))
    s = F.sum(F.when(on, F.col("n") * F.ln(F.col("n"))))
    return F.ln(n_tot) - s / n_tot


def user_features(interactions: DataFrame, cutoff: str | None = None,
                  median_accuracy: int | None = None) -> DataFrame:
    """16 per-client features.  ``median_accuracy`` switches the exact
    basket median (buffers distinct amounts per client) to ``percentile_approx``."""
    df = _keys_not_null(apply_cutoff(interactions, cutoff), ["ClientID"])
    amt = F.col("SalesNetAmountEuro")
    median = (F.percentile(amt, 0.5) if median_accuracy is None
              else F.percentile_approx(amt, 0.5, median_accuracy).cast("double"))
    base = df.groupBy("ClientID").agg(
        F.count("txn_date").alias("txns"),
        _zsum(F.col("Quantity")).alias("qty_sum"),
        _zmoney("SalesNetAmountEuro").alias("eur_sum"),
        F.min("txn_date").alias("first_txn"),
        F.max("txn_date").alias("last_txn"),
        F.avg(amt).alias("basket_mean"),
        median.alias("basket_median"),
    )
    base = with_ref_date(base, df, cutoff)
    dims = profile_dims()
    named = {d: dims[d] for d in ("category", "family1", "store_country", "client_country")}
    counted = {d: dims[d] for d in ("product", "category", "store", "month", "dow")}
    # numbers and texts apart: aggregates over numbers alone take a hash table and no sort
    prof = client_profile_counts(df, dims=counted).groupBy("ClientID").agg(
        _distinct("product").alias("n_products"),
        _distinct("category").alias("n_categories"),
        _distinct("store").alias("n_stores"),
        _entropy("month").alias("month_entropy"),
        _entropy("dow").alias("dow_entropy"),
    )
    modes = client_modes(client_profile_counts(df, dims=named)).groupBy("ClientID").agg(
        _mode("store_country").alias("pref_store_country"),
        _mode("client_country").alias("pref_client_country"),
        _mode("category").alias("top_category"),
        _mode("family1").alias("top_family_lvl1"),
    )
    out = base.join(prof, "ClientID", "left").join(modes, "ClientID", "left")
    return out.select(
        "ClientID", "txns", "qty_sum", "eur_sum",
        elapsed_days_clipped("__ref", "last_txn").alias("recency_days"),
        "basket_mean", "basket_median",
        F.coalesce("n_products", F.lit(0)).alias("n_products"),
        F.coalesce("n_categories", F.lit(0)).alias("n_categories"),
        F.coalesce("n_stores", F.lit(0)).alias("n_stores"),
        "pref_store_country", "pref_client_country", "top_category", "top_family_lvl1",
        "month_entropy", "dow_entropy",
        elapsed_days_clipped("last_txn", "first_txn").alias("customer_age_days"),
    )


# ---------------------------------------------------------------------------
# F7-F9 product features
# ---------------------------------------------------------------------------
def product_attributes(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Each product's largest value of the text columns in ``names`` (column -> name in the result).

    Of the distinct rows, which take a hash table; a maximum of texts over all rows would sort them."""
    seen = df.select("ProductID", *names).distinct()
    return seen.groupBy("ProductID").agg(*[F.max(c).alias(out) for c, out in names.items()])


def product_features(interactions: DataFrame, cutoff: str | None = None,
                     velocity_days: Sequence[int] = (30, 60)) -> DataFrame:
    """Product totals, trailing-window velocity (NULL when the product
    has no sale in the window), price intensity, age and recency."""
    df = _keys_not_null(apply_cutoff(interactions, cutoff), ["ProductID"])
    df = with_ref_date(df, df, cutoff) if not cutoff else df.withColumn(
        "__ref", F.lit(cutoff).cast("timestamp_ntz"))
    amt = F.col("SalesNetAmountEuro").cast("decimal(18,2)")
    in_w = {d: F.col("txn_date") >= F.col("__ref") - F.expr(f"INTERVAL {int(d)} DAYS") for d in velocity_days}
    pair_aggs = [
        F.count("txn_date").alias("t"),
        F.sum("Quantity").alias("q"),
        F.sum(amt).alias("e"),
        F.min("txn_date").alias("first_txn"),
        F.max("txn_date").alias("last_txn"),
        F.max("__ref").alias("__ref"),
    ]
    for d, cond in in_w.items():
        pair_aggs += [
            F.count_if(cond).alias(f"r{d}"),
            F.count(F.when(cond, F.col("txn_date"))).alias(f"t{d}"),
            F.sum(F.when(cond, F.col("Quantity"))).alias(f"q{d}"),
            F.sum(F.when(cond, amt)).alias(f"e{d}"),
        ]
    pairs = df.groupBy("ProductID", "ClientID").agg(*pair_aggs)
    prod_aggs = [
        F.sum("t").alias("txns"),
        F.count("ClientID").alias("buyers"),
        _zsum(F.col("q")).alias("qty_sum"),
        F.coalesce(F.sum("e").cast("double"), F.lit(0.0)).alias("eur_sum"),
        F.min("first_txn").alias("first_txn"),
        F.max("last_txn").alias("last_txn"),
        F.max("__ref").alias("__ref"),
    ]
    for d in velocity_days:
        has = F.sum(f"r{d}") > 0
        prod_aggs += [
            F.when(has, _zsum(F.col(f"q{d}"))).alias(f"qty_{d}d"),
            F.when(has, F.coalesce(F.sum(f"e{d}").cast("double"), F.lit(0.0))).alias(f"eur_{d}d"),
            F.when(has, F.sum(f"t{d}")).alias(f"txns_{d}d"),
            F.when(has, F.count(F.when((F.col(f"r{d}") > 0), F.col("ClientID")))).alias(f"buyers_{d}d"),
        ]
    names = {"Category": "category", "FamilyLevel1": "family_lvl1", "FamilyLevel2": "family_lvl2", "Universe": "universe"}
    prod = pairs.groupBy("ProductID").agg(*prod_aggs).join(product_attributes(df, names), "ProductID")
    vel_cols = [f"{m}_{d}d" for d in velocity_days for m in ("qty", "eur", "txns", "buyers")]
    return prod.select(
        "ProductID", "txns", "buyers", "qty_sum", "eur_sum",
        "category", "family_lvl1", "family_lvl2", "universe", *vel_cols,
        safe_ratio("eur_sum", "qty_sum").alias("eur_per_qty"),
        elapsed_days_clipped("last_txn", "first_txn").alias("product_age_days"),
        elapsed_days_clipped("__ref", "last_txn").alias("days_since_sold"),
    )


# ---------------------------------------------------------------------------
# F10-F11 RFM
# ---------------------------------------------------------------------------
def user_rfm(interactions: DataFrame, cutoff: str | None = None) -> DataFrame:
    """frequency, monetary, recency (``recency_days``), tenure, basket."""
    df = _keys_not_null(apply_cutoff(interactions, cutoff), ["ClientID"])
    g = df.groupBy("ClientID").agg(
        F.count("txn_date").alias("freq_txns"),
        _zsum(F.col("Quantity")).alias("qty_sum"),
        _zmoney("SalesNetAmountEuro").alias("eur_sum"),
        F.min("txn_date").alias("first_txn"),
        F.max("txn_date").alias("last_txn"),
    )
    g = with_ref_date(g, df, cutoff)
    return g.select(
        "ClientID", "freq_txns", "qty_sum", "eur_sum",
        elapsed_days_clipped("__ref", "last_txn").alias("recency_days"),
        elapsed_days_clipped("last_txn", "first_txn").alias("tenure_days"),
        safe_ratio("eur_sum", "freq_txns").alias("avg_basket_eur"),
    )


def client_product_recency(interactions: DataFrame, cutoff: str | None = None) -> DataFrame:
    """per (client, product) counts, sums, recency and tenure."""
    df = _keys_not_null(apply_cutoff(interactions, cutoff), ["ClientID", "ProductID"])
    g = df.groupBy("ClientID", "ProductID").agg(
        F.count("txn_date").alias("cp_txns"),
        _zsum(F.col("Quantity")).alias("cp_qty_sum"),
        _zmoney("SalesNetAmountEuro").alias("cp_eur_sum"),
        F.min("txn_date").alias("cp_first_txn"),
        F.max("txn_date").alias("cp_last_txn"),
    )
    g = with_ref_date(g, df, cutoff)
    return g.select(
        "ClientID", "ProductID", "cp_txns", "cp_qty_sum", "cp_eur_sum",
        elapsed_days_clipped("__ref", "cp_last_txn").alias("days_since_last_cp"),
        elapsed_days_clipped("cp_last_txn", "cp_first_txn").alias("cp_tenure_days"),
    )


# ---------------------------------------------------------------------------
# F12-F13 category features
# ---------------------------------------------------------------------------
def category_popularity(interactions: DataFrame, cutoff: str | None = None) -> DataFrame:
    """per category txns, buyers, qty, eur, share of ALL rows, eur/txn."""
    df = apply_cutoff(interactions, cutoff)
    total = df.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("__total"))
    pairs = (df.where(F.col("Category").isNotNull())
               .groupBy("Category", "ClientID")
               .agg(F.count("txn_date").alias("t"), F.sum("Quantity").alias("q"),
                    F.sum(F.col("SalesNetAmountEuro").cast("decimal(18,2)")).alias("e")))
    cat = pairs.groupBy("Category").agg(
        F.sum("t").alias("cat_txns"),
        F.count("ClientID").alias("cat_buyers"),
        _zsum(F.col("q")).alias("cat_qty"),
        F.coalesce(F.sum("e").cast("double"), F.lit(0.0)).alias("cat_eur"),
    )
    cat = cat.crossJoin(F.broadcast(total))  # single-row scalar
    return cat.select(
        "Category", "cat_txns", "cat_buyers", "cat_qty", "cat_eur",
        (F.col("cat_txns") / F.col("__total")).alias("cat_txn_share"),
        safe_ratio("cat_eur", "cat_txns").alias("cat_eur_per_txn"),
    )


def category_features(interactions: DataFrame, cutoff: str | None = None) -> DataFrame:
    """product attributes joined with their category's popularity."""
    df = _keys_not_null(apply_cutoff(interactions, cutoff), ["ProductID"])
    prod = product_attributes(df, {c: c for c in ("Category", "FamilyLevel1", "FamilyLevel2", "Universe")})
    # the category table has one row per category (catalog-sized)
    return prod.join(category_popularity(interactions, cutoff), "Category", "left").select(
        "ProductID", "Category", "FamilyLevel1", "FamilyLevel2", "Universe",
        "cat_txns", "cat_buyers", "cat_qty", "cat_eur", "cat_txn_share", "cat_eur_per_txn")


def feature_builders() -> dict[str, Callable[..., DataFrame]]:
    """what builds each feature table from interactions and a cutoff."""
    return {"user": user_features, "product": product_features, "rfm": user_rfm, "cp": client_product_recency,
            "category": category_features}


def build_all_features(interactions: DataFrame, cutoff: str | None = None) -> dict[str, DataFrame]:
    """the five feature tables for one cutoff (lazy)."""
    return {name: build(interactions, cutoff) for name, build in feature_builders().items()}


def clip_nonnegative_prefixed(df: DataFrame, prefixes: Sequence[str] = ("u_", "p_", "cp_", "cat_")) -> DataFrame:
    """Clip every numeric column with a feature prefix at 0 (NULL kept)."""
    from fairrank.functions.columns import is_numeric
    return df.select([
        clip_lower0(F.col(f.name)).alias(f.name)
        if f.name.startswith(tuple(prefixes)) and is_numeric(f.dataType) else F.col(f.name)
        for f in df.schema.fields])
