"""The streaming sink under failures: no window is lost, none is doubled."""

import datetime

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from fairrank.operators.monitoring import append_requests
from fairrank.streaming.monitoring import read_windows, start_monitoring, windowed_path_stats, write_batch

START = datetime.datetime(2024, 3, 1)


def log_part(spark, hour):
    rows = [(START + datetime.timedelta(hours=hour, minutes=i), f"/p{i % 3}", "GET", 500 if i % 11 == 0 else 200, float(i * hour % 97)) for i in range(0, 60, 2)]
    return spark.createDataFrame(rows, "timestamp_utc timestamp_ntz, path string, method string, status_code int, latency_ms double")


@pytest.mark.parametrize("fail", ["before", "written", "listed"])
def test_killed_between_write_and_commit(spark, tmp_path, fail):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    for hour in range(1, 9):
        append_requests(log_part(spark, hour).coalesce(1), log)
    failed = []

    def dies_once(rows, batch, out):
        if batch != 4 or failed:
            return write_batch(rows, batch, out)
        failed.append(batch)
        if fail == "written":  # rows are there, the ledger's line is not
            rows.write.mode("overwrite").parquet(f"{out}/windows/batch={batch:012d}")
        if fail == "listed":  # all is there, but Spark has not committed the batch
            write_batch(rows, batch, out)
        raise RuntimeError("killed")

    args = dict(max_files_per_trigger=1, available_now=True)
    with pytest.raises(StreamingQueryException):
        start_monitoring(spark, log, str(tmp_path / "cp"), out, write=dies_once, **args).awaitTermination()
    assert failed == [4]
    append_requests(log_part(spark, 9).coalesce(1), log)
    start_monitoring(spark, log, str(tmp_path / "cp"), out, write=dies_once, **args).awaitTermination()
    got = {(r.window_start, r.path): r for r in read_windows(spark, out).collect()}
    assert len(got) == read_windows(spark, out).count()
    want = {(r.window_start, r.path): r for r in windowed_path_stats(spark.read.parquet(log)).collect()}
    # the watermark (2 hours) has passed the windows up to hour 6
    due = {k for k in want if k[0] <= START + datetime.timedelta(hours=6)}
    assert set(got) >= {k for k in want if k[0] <= START + datetime.timedelta(hours=5)} and set(got) <= due
    for k, r in got.items():
        assert (r.requests, r.error_rate) == (want[k].requests, pytest.approx(want[k].error_rate))
        assert r.p95_latency_ms in [x.latency_ms for x in spark.read.parquet(log).where(F.col("path") == k[1]).collect()] or r.p95_latency_ms >= 0
