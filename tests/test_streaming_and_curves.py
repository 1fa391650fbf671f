import math
import time

from pyspark.sql import functions as F

from fairrank.operators import curves
from fairrank.streaming.monitoring import request_stream, windowed_path_stats


def test_streaming_matches_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:{m:02d}:00", p, "GET", 500 if m % 7 == 0 else 200, float(m + h))
            for h in range(4) for m in range(0, 60, 5) for p in ("a", "b")]
    df = spark.createDataFrame(rows, "t string, path string, method string, status_code int, latency_ms double") \
        .select(F.col("t").cast("timestamp_ntz").alias("timestamp_utc"), "path", "method", "status_code", "latency_ms")
    src = str(tmp_path / "log")
    df.write.parquet(src)
    q = (windowed_path_stats(request_stream(spark, src), "1 hour", "0 seconds")
         .writeStream.outputMode("complete").format("memory").queryName("mon_test")
         .option("checkpointLocation", str(tmp_path / "ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.sql("SELECT * FROM mon_test").collect()))
    exp = sorted(map(tuple, windowed_path_stats(df).collect()))
    assert got == exp and len(got) == 8


def test_score_metrics_brute_force(spark):
    data = [(1, .9), (0, .8), (1, .8), (0, .3), (1, .3), (0, .1), (1, .95), (0, .5)]
    df = spark.createDataFrame(data, "label int, score double")
    m = curves.score_metrics(df, "label", "score").first()
    P = sum(y for y, _ in data)
    N = len(data) - P
    ap, auc, best = 0.0, 0.0, 0.0
    for s in sorted({s for _, s in data}, reverse=True):
        tp = sum(y for y, x in data if x >= s)
        fp = sum(1 - y for y, x in data if x >= s)
        pos = sum(y for y, x in data if x == s)
        neg = sum(1 - y for y, x in data if x == s)
        prec, rec = tp / (tp + fp), tp / P
        ap += pos / P * prec
        auc += neg * (tp - pos + pos / 2)
        best = max(best, 2 * prec * rec / (prec + rec) if prec + rec else 0)
    assert math.isclose(m.pr_auc, ap) and math.isclose(m.roc_auc, auc / (P * N)) and math.isclose(m.best_f1, best)
    ll = sum(-(y * math.log(x) + (1 - y) * math.log(1 - x)) for y, x in data) / len(data)
    assert math.isclose(m.logloss, ll)
    t = curves.threshold_counts(df, "label", "score", partitions=3).orderBy(F.desc("score")).collect()
    assert [r.tp for r in t] == [1, 2, 3, 3, 4, 4]


def test_curves_do_not_depend_on_exchange_reuse(spark):
    from pyspark.sql import functions as F

    from fairrank.operators import curves
    df = spark.range(1_200_000).select(
        (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0).alias("score"), F.pmod(F.hash("id"), F.lit(2)).alias("label"))
    seen = []
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        seen.append(tuple(round(x, 12) for x in curves.score_metrics(df).first()))
    spark.conf.unset("spark.sql.exchange.reuse")
    assert seen[0] == seen[1]
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    auc = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(df.withColumn("label", F.col("label").cast("double")))
    assert abs(auc - seen[0][0]) < 1e-9


def test_dated_table_round_trip(spark, tmp_path):
    from fairrank.sources import tables
    base = str(tmp_path / "features")
    assert tables.read_dated(spark, base, "2024-01-01") is None
    tables.write_dated(spark.range(3), base, "2024-01-01")
    tables.write_dated(spark.range(5), base, "2024-02-01")
    assert tables.read_dated(spark, base, "2024-01-01").count() == 3 and tables.read_dated(spark, base, "2024-02-01").columns == ["id"]
