"""Ordered write, hash sample, one-real-row collapse and the settings of the model helpers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fairrank.operators import dedupe, ml, quality
from fairrank.sources.tables import write_ordered


def test_ordered_write_has_disjoint_sorted_files(spark, tmp_path):
    path = str(tmp_path / "ordered")
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.col("id").alias("v"))
    write_ordered(df, path, ["k"])
    back = spark.read.parquet(path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    files = back.groupBy(F.input_file_name()).agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("lo").collect()
    assert all(a.hi < b.lo for a, b in zip(files, files[1:]))
    rows = back.select("k", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).orderBy("i").collect()
    assert all(a.k <= b.k for a, b in zip(rows, rows[1:]) if a.f == b.f)


def test_hash_sample_keeps_keys_whole_and_nests(spark):
    df = spark.range(4000).select((F.col("id") % 400).alias("k"), "id").unionByName(
        spark.createDataFrame([(None, 1), (None, 2)], "k bigint, id bigint"))
    half = dedupe.sample_by_hash(df, ["k"], 0.5)
    sizes = {r.k: r["count"] for r in half.groupBy("k").count().collect()}
    assert all(n == (2 if k is None else 10) for k, n in sizes.items())
    assert 140 < len(sizes) < 260
    small = {r.k for r in dedupe.sample_by_hash(df, ["k"], 0.1).select("k").distinct().collect()}
    assert small <= set(sizes)
    assert dedupe.sample_by_hash(df, ["k"], 0.0).count() == 0
    assert dedupe.sample_by_hash(df, ["k"], 1.0).count() == df.count()
    with pytest.raises(ValueError):
        dedupe.sample_by_hash(df, ["k"], 1.5)


COLLAPSE_SCHEMA = ("ClientID int, ProductID int, txn_date timestamp_ntz, StoreID int, StoreCountry string, "
                   "Quantity int, SalesNetAmountEuro double")


def test_collapse_keeps_one_real_row(spark):
    d = dt.datetime(2024, 1, 1)
    rows = [(1, 1, d, None, "FR", 2, 5.0), (1, 1, d, 9, "IT", 2, 5.0), (1, 1, d, 9, "IT", 2, 5.0),  # collapses
            (2, 1, d, 9, "IT", 2, 5.0), (2, 1, d, 8, "IT", 2, 5.0),  # two stores: kept
            (3, None, d, 9, "IT", 2, 5.0), (3, None, d, 9, "IT", 2, 5.0)]  # NULL key: kept
    out, metrics = dedupe.collapse_duplicates(spark.createDataFrame(rows, COLLAPSE_SCHEMA), "c_p_d")
    got = sorted(map(tuple, out.select("ClientID", "StoreID", "StoreCountry", "dup_count").collect()))
    assert got == [(1, 9, "IT", 3), (2, 8, "IT", 1), (2, 9, "IT", 1), (3, 9, "IT", 1), (3, 9, "IT", 1)]
    m = metrics.first()
    assert (m.rows_before, m.rows_after, m.rows_removed) == (7, 5, 2)
    empty, _ = dedupe.collapse_duplicates(spark.createDataFrame([], COLLAPSE_SCHEMA), "c_p_d")
    assert empty.count() == 0


def test_feature_gates_fail_on_an_empty_table(spark):
    full, empty = spark.range(3).toDF("a"), spark.range(0).toDF("a")
    got = {r.name: r.passed for r in quality.feature_gates({"x": full, "y": empty}).collect()}
    assert got == {"x_non_empty": True, "y_non_empty": False}


def test_curve_grid():
    assert ml.curve_grid(3) == [3]
    assert ml.curve_grid(23) == [5, 10, 15, 20]
    assert ml.curve_grid(80) == list(range(5, 51, 5))


def test_logreg_penalty_follows_the_total_weight():
    lr = ml.build_pipeline("logreg", ["a"], total_weight=200.0).getStages()[-1]
    assert lr.getRegParam() == pytest.approx(1 / 200)
    assert ml.build_pipeline("logreg", ["a"], regParam=0.3).getStages()[-1].getRegParam() == 0.3
    with pytest.raises(ValueError):
        ml.build_pipeline("logreg", ["a"])
