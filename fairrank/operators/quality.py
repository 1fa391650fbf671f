"""Data-quality reports and gates (Q2, Q6-Q11, Q19).

Each report is a single aggregation pass producing a small DataFrame; callers
write it as JSON/CSV (S7).  Nothing is collected to the driver here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairrank.config import DESCRIBE_PERCENTILES, WARNINGS
from fairrank.functions.columns import is_numeric
from fairrank.operators.dedupe import exact_duplicate_rows, key_duplicate_rows
from fairrank.operators.order import exact_quantiles


def _unpivot(row: DataFrame, names: Sequence[str], key: str, value: str) -> DataFrame:
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias(key), F.col(f"`{n}`").alias(value))
                                         for n in names])))


def null_percent(df: DataFrame) -> DataFrame:
    """Q2: percentage of NULLs per column, rounded half-even to 2 places."""
    aggs = [F.bround(F.avg(F.col(f"`{c}`").isNull().cast("double")) * 100, 2).alias(c) for c in df.columns]
    row = df.agg(*aggs)
    return _unpivot(row, df.columns, "column", "null_percent")


def table_report(df: DataFrame, name: str, pk: Sequence[str] | None, cleaned: DataFrame | None = None) -> DataFrame:
    """Q6 per table: rows before/after, columns, full and primary-key duplicates."""
    base = df.agg(F.count(F.lit(1)).alias("rows_before"))
    dup_full = exact_duplicate_rows(df)
    dup_pk = key_duplicate_rows(df, list(pk)) if pk else df.sparkSession.range(1).select(
        F.lit(0).cast("bigint").alias("duplicate_rows_on_pk"))
    after = (cleaned if cleaned is not None else df).agg(F.count(F.lit(1)).alias("rows_after"))
    return (base.crossJoin(dup_full).crossJoin(dup_pk).crossJoin(after)  # single-row parts
                .select(F.lit(name).alias("table"), "rows_before", "rows_after",
                        F.lit(len(df.columns)).alias("cols"), "duplicate_rows_full", "duplicate_rows_on_pk",
                        (F.col("rows_before") - F.col("rows_after")).alias("rows_removed_dedup")))


def canonical_report(tables: dict[str, DataFrame], pks: dict[str, Sequence[str] | None],
                     cleaned: dict[str, DataFrame] | None = None) -> DataFrame:
    """Q6: union of per-table one-row reports."""
    out = None
    for name, df in tables.items():
        r = table_report(df, name, pks.get(name), (cleaned or {}).get(name))
        out = r if out is None else out.unionByName(r)
    return out


def canonical_checks(tables: dict[str, DataFrame], top: int = 15) -> DataFrame:
    """Q6, the rest of the report, in long form (section, table, item, value): rows of transactions and stocks
    whose keys no dimension knows, transactions that share client, product, time and store (reported, not
    dropped), and each table's ``top`` columns by NULL %, ties by name."""
    from fairrank.operators.interactions import orphan_counts
    tx = tables["transactions"]
    orphans = orphan_counts(tx, tables["clients"], tables["products"], tables["stores"], tables["stocks"])
    keys = ["ClientID", "ProductID", "SaleTransactionDate", "StoreID"]
    parts = [_unpivot(orphans, orphans.columns, "item", "value").select(F.lit("key_consistency").alias("section"),
                                                                         F.lit("transactions").alias("table"), "item", F.col("value").cast("double").alias("value")),
             key_duplicate_rows(tx, keys, "n").select(F.lit("suspicious_duplicates"), F.lit("transactions"), F.lit("+".join(keys)), F.col("n").cast("double"))]
    for name, df in tables.items():
        worst = null_percent(df).orderBy(F.desc("null_percent"), "column").limit(top)
        parts.append(worst.select(F.lit("top_nulls"), F.lit(name), "column", F.col("null_percent").cast("double")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Q7: count, mean, std (ddof=1), min, p1..p99 (linear interpolation), max
    per numeric column (honours ``cols``; all numeric columns when None)."""
    cols = list(cols) if cols else [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    ps = list(DESCRIBE_PERCENTILES)
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("grp"), F.col(c).cast("double").alias("value")) for c in cols])))
    stats = cells.groupBy(F.col("grp").alias("column")).agg(
        F.count("value").cast("double").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    out = stats.join(exact_quantiles(cells, ps, "__p"), F.col("column") == F.col("grp"), "left")
    names = [f"p{int(round(p * 100))}" for p in ps]
    return out.select("column", "count", "mean", "std", "min",
                      *[F.col("__p")[i].alias(n) for i, n in enumerate(names)], "max")


def availability_report(df: DataFrame, flags=("AvailableInStoreCountry", "AvailableInClientCountry")) -> DataFrame:
    """Q8: mean and value counts of the availability flags (long format)."""
    out = None
    for c in flags:
        r = (df.groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
               .withColumn("flag", F.lit(c)))
        share = df.agg(F.avg(F.col(c).cast("double")).alias("share")).withColumn("flag", F.lit(c))
        r = r.join(share, "flag")
        out = r if out is None else out.unionByName(r)
    return out


def interactions_report(df: DataFrame) -> DataFrame:
    """Q9: one row - shape, date range, distinct keys, key-level duplicate
    rows and warnings (negative quantity / amount, >5 % missing dates)."""
    k1 = ["ClientID", "ProductID", "txn_date", "StoreID"]
    k2 = ["ClientID", "ProductID", "txn_date"]
    main = df.agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("cols"),
        F.min("txn_date").alias("date_min"), F.max("txn_date").alias("date_max"),
        F.count_distinct("ClientID").alias("ClientID_nunique"),
        F.count_distinct("ProductID").alias("ProductID_nunique"),
        F.count_distinct("StoreID").alias("StoreID_nunique"),
        F.count_if(F.col("Quantity") < 0).alias("__neg_q"),
        F.count_if(F.col("SalesNetAmountEuro") < 0).alias("__neg_a"),
        F.avg(F.col("txn_date").isNull().cast("double")).alias("__null_d"))
    d1 = key_duplicate_rows(df, k1, "dup_rows_c_p_d_s")
    d2 = key_duplicate_rows(df, k2, "dup_rows_c_p_d")
    warnings = F.array_compact(F.array(
        F.when(F.col("__neg_q") > 0, F.lit(WARNINGS["quantity"])),
        F.when(F.col("__neg_a") > 0, F.lit(WARNINGS["amount"])),
        F.when(F.col("__null_d") > 0.05, F.lit(WARNINGS["dates"]))))
    return (main.crossJoin(d1).crossJoin(d2)  # single-row parts
                .withColumn("warnings", warnings).drop("__neg_q", "__neg_a", "__null_d"))


def _check(name: str, passed: Column, message: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), passed.alias("passed"), message.alias("message"))


def feature_table_checks(df: DataFrame, table: str, keys: Sequence[str],
                         nonneg: Sequence[str] = (), nonneg_or_null: Sequence[str] = ()) -> DataFrame:
    """Q10: unique key, no NULL keys, non-negativity (a NULL fails a plain
    check and passes an ``_or_null`` check).  Rows: table, name, passed, message."""
    present = [c for c in nonneg if c in df.columns]
    present_n = [c for c in nonneg_or_null if c in df.columns]
    aggs = [F.count(F.lit(1)).alias("__rows")]
    aggs += [F.count_if(F.col(k).isNull()).alias(f"__null_{k}") for k in keys]
    aggs += [F.count_if(~F.coalesce(F.col(c) >= 0, F.lit(False))).alias(f"__neg_{c}") for c in present]
    aggs += [F.count_if(F.col(c) < 0).alias(f"__negn_{c}") for c in present_n]
    row = df.agg(*aggs).crossJoin(df.select(*keys).distinct().agg(F.count(F.lit(1)).alias("__distinct")))
    checks = [_check(f"{'_'.join(keys)}_unique", F.col("__distinct") == F.col("__rows"),
                     F.concat(F.lit("rows="), F.col("__rows").cast("string"), F.lit(" distinct="),
                              F.col("__distinct").cast("string")))]
    checks += [_check(f"{k}_not_null", F.col(f"__null_{k}") == 0,
                      F.concat(F.lit("nulls="), F.col(f"__null_{k}").cast("string"))) for k in keys]
    checks += [_check(f"{c}_non_negative", F.col(f"__neg_{c}") == 0,
                      F.concat(F.lit("violations="), F.col(f"__neg_{c}").cast("string"))) for c in present]
    checks += [_check(f"{c}_non_negative_or_null", F.col(f"__negn_{c}") == 0,
                      F.concat(F.lit("violations="), F.col(f"__negn_{c}").cast("string"))) for c in present_n]
    return row.select(F.lit(table).alias("table"), F.inline(F.array(*checks)))


# Table -> key, columns that must be >= 0, columns that must be >= 0 or NULL.
FEATURE_CHECKS = {
    "user_features": (["ClientID"], ["txns", "qty_sum", "eur_sum", "recency_days", "n_products",
                                     "customer_age_days"], ["basket_mean", "basket_median"]),
    "product_features": (["ProductID"], ["txns", "buyers", "qty_sum", "product_age_days", "days_since_sold"],
                         ["eur_per_qty"]),
    "user_rfm": (["ClientID"], ["recency_days", "tenure_days", "freq_txns", "qty_sum", "eur_sum"],
                 ["avg_basket_eur"]),
    "client_product_recency": (["ClientID", "ProductID"], ["days_since_last_cp", "cp_tenure_days", "cp_txns",
                                                           "cp_qty_sum", "cp_eur_sum"], []),
    "category_features": (["ProductID"], ["cat_txns", "cat_qty", "cat_eur", "cat_buyers", "cat_txn_share"],
                          ["cat_eur_per_txn"]),
}


def feature_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """Q10: the validators of all given feature tables (names as in FEATURE_CHECKS)."""
    parts = [feature_table_checks(df, name, *FEATURE_CHECKS[name]) for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def feature_gates(tables: dict[str, DataFrame]) -> DataFrame:
    """Q11 (features stage): every feature table has rows."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.inline(F.array(_check(
            f"{name}_non_empty", F.col("rows") > 0, F.concat(F.lit("rows="), F.col("rows").cast("string"))))))
        out = row if out is None else out.unionByName(row)
    return out


def interim_profile(tables: dict[str, DataFrame], top: int = 5, samples: int = 10) -> DataFrame:
    """Q19: profile of the five canonical tables in long form (table, metric,
    item, value, text): rows, columns and NULL % per column of each table;
    date range, negative quantities and amounts and orphan keys of
    transactions; stock products that do not exist; the ``top`` genders by
    count (ties by name) and the first ``samples`` categories by name."""
    from fairrank.operators.interactions import orphan_counts
    none = F.lit(None).cast("string")

    def line(src, table, metric, item=none, value=F.lit(None), text=none):
        return src.select(F.lit(table).alias("table"), F.lit(metric).alias("metric"), item.alias("item"),
                          value.cast("double").alias("value"), text.alias("text"))

    parts = []
    for name, df in tables.items():
        parts.append(line(df.agg(F.count(F.lit(1)).alias("n")), name, "rows", value=F.col("n")))
        parts.append(line(df.sparkSession.range(1), name, "columns", value=F.lit(len(df.columns))))
        parts.append(line(null_percent(df), name, "null_percent", F.col("column"), F.col("null_percent")))
    tx = tables["transactions"]
    stats = tx.agg(F.min("SaleTransactionDate").alias("lo"), F.max("SaleTransactionDate").alias("hi"),
                   F.count_if(F.col("Quantity") < 0).alias("Quantity"),
                   F.count_if(F.col("SalesNetAmountEuro") < 0).alias("SalesNetAmountEuro"))
    parts.append(line(stats, "transactions", "date_min", text=F.date_format("lo", "yyyy-MM-dd HH:mm:ss")))
    parts.append(line(stats, "transactions", "date_max", text=F.date_format("hi", "yyyy-MM-dd HH:mm:ss")))
    parts.append(line(_unpivot(stats, ["Quantity", "SalesNetAmountEuro"], "c", "n"), "transactions", "negative",
                      F.col("c"), F.col("n")))
    orphans = orphan_counts(tx, tables["clients"], tables["products"], tables["stores"], tables["stocks"])
    for key in ("clients", "products", "stores"):
        parts.append(line(orphans, "transactions", "orphans", F.lit(key), F.col(f"orphan_{key}")))
    parts.append(line(orphans, "stocks", "orphans", F.lit("products"), F.col("stocks_products_not_in_products")))
    genders = (tables["clients"].groupBy("ClientGender").agg(F.count(F.lit(1)).alias("n"))
               .orderBy(F.desc("n"), F.asc_nulls_last("ClientGender")).limit(top))
    parts.append(line(genders, "clients", "gender", F.col("ClientGender"), F.col("n")))
    categories = tables["products"].select("Category").dropna().distinct().orderBy("Category").limit(samples)
    parts.append(line(categories, "products", "category", F.col("Category")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def interactions_gates(df: DataFrame) -> DataFrame:
    """Q11 (interactions stage): rows > 0, key NULL ratio < 1 %, valid dates > 95 %."""
    a = df.agg(F.count(F.lit(1)).alias("rows"),
               F.avg(F.col("ClientID").isNull().cast("double")).alias("c_null"),
               F.avg(F.col("ProductID").isNull().cast("double")).alias("p_null"),
               F.avg(F.col("txn_date").isNotNull().cast("double")).alias("d_ok"))
    fmt = lambda c: F.format_number(F.coalesce(F.col(c), F.lit(0.0)), 4)
    checks = [
        _check("interactions_non_empty", F.col("rows") > 0, F.concat(F.lit("rows="), F.col("rows").cast("string"))),
        _check("ClientID_null_ratio_lt_1pct", F.coalesce(F.col("c_null") < 0.01, F.lit(False)),
               F.concat(F.lit("ClientID_null_ratio="), fmt("c_null"))),
        _check("ProductID_null_ratio_lt_1pct", F.coalesce(F.col("p_null") < 0.01, F.lit(False)),
               F.concat(F.lit("ProductID_null_ratio="), fmt("p_null"))),
        _check("txn_date_valid_ratio_gt_95pct", F.coalesce(F.col("d_ok") > 0.95, F.lit(False)),
               F.concat(F.lit("txn_date_valid_ratio="), fmt("d_ok"))),
    ]
    return a.select(F.inline(F.array(*checks)))


def split_gates(split: DataFrame, name: str) -> DataFrame:
    """Q11 (training stage): split rows > 0 and labels within {0, 1}."""
    a = split.agg(F.count(F.lit(1)).alias("rows"),
                  F.count_if(F.col("label").isNotNull() & ~F.col("label").isin(0, 1)).alias("bad"))
    checks = [_check(f"{name}_rows_gt_0", F.col("rows") > 0, F.concat(F.lit("rows="), F.col("rows").cast("string"))),
              _check(f"{name}_label_binary", F.col("bad") == 0, F.lit("label must be {0,1}"))]
    return a.select(F.inline(F.array(*checks)))


def gate_outcome(checks: DataFrame) -> DataFrame:
    """Q11: all gates must pass."""
    return checks.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed"),
                      F.count(F.lit(1)).alias("checks"))
