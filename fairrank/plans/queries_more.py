"""Registered queries: quarantine, audits, folds, snapshot and enriched lists."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fairrank.operators import cooccur, labels, ml, monitoring, quality, ranking, scoring
from fairrank.plans.queries_ops import _as_of, _catalog, _log, _report_history, q_cart_recs, q_gates, transactions_csv
from fairrank.plans.queries_reco import LABEL_DAYS, TOP_K, _run, _split, _splits
from fairrank.plans.registry import Context, query
from fairrank.sources.contracts import CONTRACTS, coerce_bool, ingest_with_quarantine
from fairrank.sources.tables import table_path

MODES = ("binary", "count_txn", "sum_qty")


@query("quarantined_rows")
def q_quarantine(ctx: Context):
    """Rows of the transactions CSV that break their contract, with what they break."""
    raw = ctx.spark.read.csv(transactions_csv(ctx), header=True)
    path = table_path(ctx.spark, ctx.sf_dir, f"quarantine_{uuid.uuid4().hex}")
    _, rejected, _ = ingest_with_quarantine(raw, CONTRACTS["transactions"], path)
    return rejected.select("ClientID", "ProductID", "StoreID", "SaleTransactionDate", "Quantity", "SalesNetAmountEuro",
                           F.array_join("violations", "; ").alias("violations"))


@query("canonical_checks")
def q_canonical_checks(ctx: Context):
    """Q6: key consistency, suspicious duplicates and top NULL shares of the canonical tables."""
    return quality.canonical_checks(ctx.canonical)


@query("quality_gate_outcome")
def q_gate_outcome(ctx: Context):
    """Q11: all gates in one row."""
    return quality.gate_outcome(q_gates(ctx))


@query("target_audit")
def q_target_audit(ctx: Context):
    """The binary targets of the three splits against the targets of all three modes."""
    out = None
    for name, rows in _splits(ctx).items():
        window = labels.history_window(ctx.history, ctx.cutoffs.for_split(name), LABEL_DAYS)[1]
        for mode in MODES:
            r = labels.target_differences(rows, window, mode)
            r = r.select(F.lit(name).alias("split"), F.lit(mode).alias("mode"), "*")
            out = r if out is None else out.unionByName(r)
    return out


@query("balanced_folds")
def q_balanced_folds(ctx: Context):
    """M9: three size-balanced folds of the test split's clients."""
    return ml.balanced_folds(_split(ctx).select("ClientID"), 3)


@query("labelled_top_k")
def q_labelled(ctx: Context):
    """The base lists without their labels, joined with the split's labels again; top-10 with positions."""
    return ranking.prepare_top_k(_run(ctx).base.select("ClientID", "ProductID", "hybrid_score"), _split(ctx), TOP_K).select(
        "ClientID", "ProductID", "hybrid_score", "label", "pos")


@query("enriched_cart_recommendations")
def q_enriched(ctx: Context):
    """Cart recommendations with catalog attributes, as a user sees them."""
    return cooccur.enrich_with_catalog(q_cart_recs(ctx), _catalog(ctx)).select(
        "cart_id", "rank", "ProductID", "ProductName", "Category", "FamilyLevel1", "score", "co_users")


@query("monitoring_snapshot")
def q_snapshot(ctx: Context):
    """Summary, paths and drift of one snapshot, in long form."""
    frames = monitoring.monitoring_snapshot(_log(ctx), _report_history(ctx), _as_of(ctx), 24)

    def lines(section, item, frame, columns):
        cells = F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns]))
        return frame.select(F.lit(section).alias("section"), item.alias("item"), cells)

    return (lines("api", F.lit("all"), frames["api"], ("events", "p50_latency_ms", "p95_latency_ms", "error_rate"))
            .unionByName(lines("paths", F.col("path"), frames["paths"], ("requests", "p95_latency_ms", "error_rate")))
            .unionByName(lines("drift", F.col("report"), frames["drift"], ("pre_max_gap", "post_max_gap", "pre_min_max_ratio", "post_min_max_ratio"))))


@query("appended_request_log")
def q_appended(ctx: Context):
    """The request log appended method by method, read back."""
    path = table_path(ctx.spark, ctx.sf_dir, f"appended_log_{uuid.uuid4().hex}")
    late = F.pmod(F.hash("path"), F.lit(2)) == 0
    for part in (_log(ctx).where(~late), _log(ctx).where(late)):
        monitoring.append_requests(part, path)
    log = ctx.spark.read.schema(monitoring.LOG_SCHEMA).parquet(path)
    return log.groupBy("path", "method", "status_code").agg(
        F.count(F.lit(1)).alias("requests"), F.min("timestamp_utc").alias("first_seen"), F.max("latency_ms").alias("slowest_ms"))


@query("coerced_flags")
def q_flags(ctx: Context):
    """The clients' opt-in flags from several spellings, and one that is none."""
    n = F.pmod("ClientID", F.lit(5))
    email = (F.when(n == 4, F.lit("maybe")).when(n == 3, F.when(F.col("ClientOptINEmail") == 1, "Y").otherwise("N"))
              .when(n == 2, F.when(F.col("ClientOptINEmail") == 1, "yes").otherwise("no"))
              .when(n == 1, F.when(F.col("ClientOptINEmail") == 1, "true").otherwise("false"))
              .otherwise(F.col("ClientOptINEmail").cast("string")))
    return ctx.domain["clients"].select("ClientID", coerce_bool(email).alias("email"))


@query("selected_features")
def q_selected(ctx: Context):
    """The ten numeric features of the test split that vary most, by a ranking of all numeric ones."""
    split = _split(ctx)
    numeric = scoring.select_feature_columns(split)
    row = split.agg(*[F.var_pop(F.col(c).cast("double")).alias(c) for c in numeric]).first()  # a number per column
    ranked = sorted(numeric, key=lambda c: (-(row[c] or 0.0), c))
    chosen = scoring.select_feature_columns(split, ranked, 10)
    return ctx.spark.createDataFrame([(i + 1, c) for i, c in enumerate(chosen)], "place int, feature string")
