"""Request-log monitoring and fairness drift history.

``as_of`` is always an argument (never ``now()``), so results are
reproducible; the log is an append-only table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairrank.operators.order import exact_quantiles

LOG_SCHEMA = "timestamp_utc timestamp_ntz, path string, method string, status_code int, latency_ms double"


def append_requests(rows: DataFrame, path: str) -> None:
    """Append request records (timestamp_utc, path, method, status_code, latency_ms)."""
    rows.select("timestamp_utc", "path", "method", F.col("status_code").cast("int"),
                F.col("latency_ms").cast("double")).write.mode("append").parquet(path)


def _window(log: DataFrame, as_of, window_hours: int) -> DataFrame:
    lo = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(window_hours)} HOURS")
    return log.where(F.col("timestamp_utc") >= lo)


def monitoring_summary(log: DataFrame, as_of, window_hours: int = 24) -> DataFrame:
    """Events, p50 / p95 latency (linear interpolation), error rate (status >= 400)."""
    w = _window(log, as_of, window_hours)
    cells = w.select(F.lit(0).alias("grp"), F.col("latency_ms").cast("double").alias("value"))
    q = exact_quantiles(cells, (0.5, 0.95)).agg(F.first("q").alias("q"))  # one row, also without events
    row = w.agg(F.lit(window_hours).alias("window_hours"), F.count(F.lit(1)).alias("events"),
                F.avg((F.col("status_code") >= 400).cast("double")).alias("error_rate"))
    return row.crossJoin(q).select("window_hours", "events", F.col("q")[0].alias("p50_latency_ms"),
                                   F.col("q")[1].alias("p95_latency_ms"), "error_rate")


def path_breakdown(log: DataFrame, as_of, window_hours: int = 24) -> DataFrame:
    """Per path requests, p95 latency and error rate."""
    w = _window(log, as_of, window_hours)
    g = w.groupBy("path").agg(F.count(F.lit(1)).alias("requests"),
                              F.avg((F.col("status_code") >= 400).cast("double")).alias("error_rate"))
    q = exact_quantiles(w.select(F.col("path").alias("grp"), F.col("latency_ms").cast("double").alias("value")), (0.95,))
    return g.join(q, F.col("path").eqNullSafe(F.col("grp")), "left").select(
        "path", "requests", F.col("q")[0].alias("p95_latency_ms"), "error_rate")


def fairness_drift(reports: DataFrame, limit: int = 20) -> DataFrame:
    """Newest ``limit`` fairness reports with pre/post gap and ratio,
    the focus view preferred over the full one.  ``reports`` columns:
    report, generated_at, pre, post, focus_pre, focus_post (structs with
    max_gap and min_max_ratio; focus_* may be NULL)."""
    pre = F.coalesce(F.col("focus_pre"), F.col("pre"))
    post = F.coalesce(F.col("focus_post"), F.col("post"))
    return (reports.orderBy(F.desc("generated_at"), F.asc("report")).limit(limit)
                   .select("report", "generated_at",
                           pre["max_gap"].alias("pre_max_gap"), post["max_gap"].alias("post_max_gap"),
                           pre["min_max_ratio"].alias("pre_min_max_ratio"),
                           post["min_max_ratio"].alias("post_min_max_ratio")))


REPORT_SCHEMA = ("report string, generated_at timestamp_ntz, pre struct<max_gap:double,min_max_ratio:double>, "
                 "post struct<max_gap:double,min_max_ratio:double>, focus_pre struct<max_gap:double,min_max_ratio:double>, "
                 "focus_post struct<max_gap:double,min_max_ratio:double>")


def report_row(name: str, generated_at: str, pre: DataFrame, post: DataFrame,
               focus_pre: DataFrame | None = None, focus_post: DataFrame | None = None) -> DataFrame:
    """One report of the history from one-row audit summaries; without focus audits those stay NULL."""
    out = pre.sparkSession.range(1).select(F.lit(name).alias("report"),
                                           F.lit(generated_at).cast("timestamp_ntz").alias("generated_at"))
    for col, summary in (("pre", pre), ("post", post), ("focus_pre", focus_pre), ("focus_post", focus_post)):
        if summary is None:
            out = out.withColumn(col, F.lit(None).cast("struct<max_gap:double,min_max_ratio:double>"))
        else:
            out = out.crossJoin(summary.select(F.struct("max_gap", "min_max_ratio").alias(col)))  # one row each
    return out


def append_report(row: DataFrame, path: str) -> None:
    """Append a report to the stored history."""
    row.write.mode("append").parquet(path)


def read_reports(spark, path: str) -> DataFrame:
    """The stored report history."""
    return spark.read.schema(REPORT_SCHEMA).parquet(path)


def read_report_files(spark, pattern: str | list[str]) -> DataFrame:
    """S9 backfill: JSON summary files -> reports table, file mtime as generated_at."""
    df = spark.read.option("multiLine", True).json(pattern).select("*", "_metadata.file_name",
                                                                     "_metadata.file_modification_time")
    cols = set(df.columns)
    none = F.lit(None).cast("struct<max_gap:double,min_max_ratio:double>")
    return df.select(F.col("file_name").alias("report"),
                     F.col("file_modification_time").cast("timestamp_ntz").alias("generated_at"),
                     F.col("pre"), F.col("post"),
                     F.col("focus_pre") if "focus_pre" in cols else none.alias("focus_pre"),
                     F.col("focus_post") if "focus_post" in cols else none.alias("focus_post"))


def backfill_reports(spark, folder: str, table: str) -> int:
    """The summary files of ``folder`` that the history at ``table`` doesn't have yet (by name and modification
    time) become rows of it; returns how many.  Only the new files are opened: the listing comes from file metadata."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path", "modificationTime")
    listed = listed.select("path", F.element_at(F.split("path", "/"), -1).alias("report"),
                           F.col("modificationTime").cast("timestamp_ntz").alias("generated_at"))
    try:
        known = read_reports(spark, table).select("report", "generated_at")
        listed = listed.join(known, ["report", "generated_at"], "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    new = [r.path for r in listed.select("path").collect()]  # names of new files, one per job that ran
    if new:
        append_report(read_report_files(spark, new), table)
    return len(new)


def monitoring_snapshot(log: DataFrame, reports: DataFrame | None, as_of, window_hours: int = 24) -> dict:
    """The three monitoring frames of one snapshot."""
    return {"api": monitoring_summary(log, as_of, window_hours),
            "paths": path_breakdown(log, as_of, window_hours),
            "drift": fairness_drift(reports) if reports is not None else None}
