"""Structured Streaming variant of request-log monitoring.

Reads the append-only request log as a stream, assigns event-time windows
with a watermark for late records and keeps per-window, per-path counts,
error rate and latency sketches in state.  Finished windows go to a table:
a micro-batch replaces its own folder (its number is in the path) and then
writes its line in the ledger, so that a batch repeated after a failure
neither loses nor doubles a window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairrank.operators.monitoring import LOG_SCHEMA
from fairrank.operators.order import exact_quantiles


def request_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(LOG_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def windowed_path_stats(log: DataFrame, window: str = "1 hour", watermark: str = "2 hours",
                        exact_percentiles: bool = True) -> DataFrame:
    """Per (event-time window, path): requests, error rate, p50/p95 latency.
    Works on a streaming or a batch frame; event time must be a zoned
    timestamp for the watermark, so the NTZ log time is cast first.  Without
    ``exact_percentiles`` the state holds mergeable sketches of bounded size
    instead of every latency."""
    ts = F.col("timestamp_utc").cast("timestamp")
    df = log.withColumn("event_time", ts).withWatermark("event_time", watermark)
    counts = (F.count(F.lit(1)).alias("requests"), F.avg((F.col("status_code") >= 400).cast("double")).alias("error_rate"))
    if exact_percentiles and not log.isStreaming:
        # a busy path's latencies are not gathered: places in the global order
        cells = df.select(F.window("event_time", window).alias("w"), "path", "status_code", F.col("latency_ms").cast("double").alias("value"))
        q = exact_quantiles(cells.select(F.struct("w", "path").alias("grp"), "value"), (0.5, 0.95))
        out = cells.groupBy("w", "path").agg(*counts).join(q, F.struct("w", "path").eqNullSafe(F.col("grp")), "left")
        out = out.withColumns({"p50_latency_ms": F.col("q")[0], "p95_latency_ms": F.col("q")[1]})
    else:
        pct = ((lambda p: F.percentile("latency_ms", p)) if exact_percentiles
               else (lambda p: F.percentile_approx("latency_ms", p, 10000).cast("double")))
        out = df.groupBy(F.window("event_time", window).alias("w"), "path").agg(
            *counts, pct(0.5).alias("p50_latency_ms"), pct(0.95).alias("p95_latency_ms"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                      "path", "requests", "error_rate", "p50_latency_ms", "p95_latency_ms")


def _batch_path(out: str, what: str, batch: int) -> str:
    return f"{out.rstrip('/')}/{what}/batch={batch:012d}"


def write_batch(rows: DataFrame, batch: int, out: str) -> None:
    """One micro-batch of finished windows: its rows, then its line in the ledger."""
    rows.coalesce(1).write.mode("overwrite").parquet(_batch_path(out, "windows", batch))
    n = rows.sparkSession.read.schema(rows.schema).parquet(_batch_path(out, "windows", batch)).count()
    line = rows.sparkSession.createDataFrame([(batch, n)], "batch_id bigint, rows bigint")
    line.coalesce(1).write.mode("overwrite").parquet(_batch_path(out, "ledger", batch))


def read_windows(spark: SparkSession, out: str) -> DataFrame:
    """The windows of the batches that the ledger lists."""
    done = spark.read.parquet(f"{out.rstrip('/')}/ledger").select("batch")
    return spark.read.parquet(f"{out.rstrip('/')}/windows").join(done, "batch", "left_semi").drop("batch")


def start_monitoring(spark: SparkSession, log_path: str, checkpoint: str, out: str, window: str = "1 hour",
                     watermark: str = "2 hours", max_files_per_trigger: int | None = None, available_now: bool = False,
                     write: Callable[[DataFrame, int, str], None] = write_batch):
    """Run the windowed stats into the table ``out`` (append mode: a window is
    emitted once the watermark passes its end).  ``checkpoint`` and ``out`` must be
    on the shared file system, so that the query goes on after it is stopped anywhere."""
    stats = windowed_path_stats(request_stream(spark, log_path, max_files_per_trigger), window, watermark, False)
    sink = (stats.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
                 .foreachBatch(lambda rows, batch: write(rows, batch, out)))
    return (sink.trigger(availableNow=True) if available_now else sink).start()
