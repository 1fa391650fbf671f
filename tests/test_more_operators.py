"""Quarantine, size-balanced folds, target differences and report backfill on odd rows."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from fairrank.operators import labels, ml, monitoring
from fairrank.sources.contracts import CONTRACTS, ingest_with_quarantine


def test_quarantine_keeps_every_row(spark, tmp_path):
    rows = [("1", "2", "2024-01-05 10:00:00", "3", "4", "5.5"), (" 7 ", "8.0", " 2024-01-06 ", "9", "", None), ("x", None, "soon", "1.5", "n/a", "1e2"),
            (None, None, None, None, None, None), ("1", "2", "2024-01-05", "3", "nan", "NaN")]
    cols = ["ClientID", "ProductID", "SaleTransactionDate", "StoreID", "Quantity", "SalesNetAmountEuro"]
    raw = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    valid, rejected, seen = ingest_with_quarantine(raw, CONTRACTS["transactions"], str(tmp_path / "q"))
    assert seen == {"rows": 5, "rejected": 2} and valid.columns == cols and valid.count() == 3 and rejected.count() == 2
    assert {(r.ClientID, r.Quantity, r.SalesNetAmountEuro) for r in valid.collect()} == {(1, 4, 5.5), (7, None, None), (1, None, None)}
    by = {json.loads(r.as_read).get("ClientID"): r for r in rejected.collect()}
    assert by["x"].violations == ["ClientID: not a int64", "ProductID: missing", "SaleTransactionDate: not a datetime64[ns]",
                                  "StoreID: not a int64", "Quantity: not a int64"]
    assert by["x"].SalesNetAmountEuro == 100.0 and by[None].violations == [f"{c}: missing" for c in cols[:4]]
    none = ingest_with_quarantine(raw.where("false"), CONTRACTS["transactions"], str(tmp_path / "none"))
    assert none[0].count() == none[1].count() == 0 and none[2] == {"rows": 0, "rejected": 0}


@pytest.mark.parametrize("seed", range(4))
def test_balanced_folds_against_dealing_one_by_one(spark, seed):
    rnd = random.Random(seed)
    sizes = {i: (rnd.choice([1, 1, 1, 2, 3, 7, 40]) if seed else 1) for i in range(120)}
    if seed == 3:
        sizes[500] = 900  # one client with most rows
    df = spark.createDataFrame([(c,) for c, n in sizes.items() for _ in range(n)], "ClientID long").repartition(5)
    got = {r.ClientID: (r.rows, r.fold) for r in ml.balanced_folds(df, 4).collect()}
    loads, want = [0] * 4, {}
    for c, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        f = loads.index(min(loads))
        want[c] = (n, f)
        loads[f] += n
    assert got == want and max(loads) - min(loads) <= max(sizes.values())
    assert ml.balanced_folds(df.where("false"), 4).count() == 0


def test_target_differences(spark):
    window = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (1, 2, 1), (2, 5, -1), (3, 3, 1), (None, 4, 9)], "ClientID long, ProductID long, Quantity long").withColumn("txn_date", F.lit(1))
    ds = spark.createDataFrame([(1, 1, 1, 2), (1, 2, 1, 1), (2, 5, 1, 1), (9, 9, 1, 1), (8, 8, 0, 0)], "ClientID long, ProductID long, label int, target long")
    def of(mode):
        return sorted(map(tuple, labels.target_differences(ds, window, mode).collect()))
    assert of("count_txn") == [(3, 3, "missing", None, 1), (9, 9, "surplus", 1, None)]
    assert of("sum_qty") == [(1, 1, "changed", 2, 5), (2, 5, "surplus", 1, None), (3, 3, "missing", None, 1), (9, 9, "surplus", 1, None)]
    assert of("binary") == [(1, 1, "changed", 2, 1), (3, 3, "missing", None, 1), (9, 9, "surplus", 1, None)]


def report(path, gap, focus=None):
    body = {"pre": {"max_gap": gap, "min_max_ratio": 0.5}, "post": {"max_gap": gap / 2, "min_max_ratio": 0.8}}
    if focus is not None:
        body["focus_pre"] = {"max_gap": focus, "min_max_ratio": 0.1}
        body["focus_post"] = {"max_gap": focus / 2, "min_max_ratio": 0.2}
    with open(path, "w") as f:
        json.dump(body, f, indent=1)


def test_backfill_reads_only_new_files(spark, tmp_path):
    files, table = tmp_path / "reports", str(tmp_path / "history")
    os.makedirs(files)
    report(files / "a.json", 0.4)
    report(files / "b.json", 0.6, focus=0.9)
    assert monitoring.backfill_reports(spark, str(files), table) == 2
    assert monitoring.backfill_reports(spark, str(files), table) == 0
    report(files / "c.json", 0.2)
    os.remove(files / "a.json")  # what has been read isn't needed again
    assert monitoring.backfill_reports(spark, str(files), table) == 1
    history = monitoring.read_reports(spark, table)
    assert sorted(r.report for r in history.collect()) == ["a.json", "b.json", "c.json"]
    drift = {r.report: (r.pre_max_gap, r.post_max_gap) for r in monitoring.fairness_drift(history).collect()}
    assert drift == {"a.json": (0.4, 0.2), "b.json": (0.9, 0.45), "c.json": (0.2, 0.1)}
    # a file that was written anew is a new version of its report
    report(files / "c.json", 0.3)
    os.utime(files / "c.json", (2_000_000_000, 2_000_000_000))
    assert monitoring.backfill_reports(spark, str(files), table) == 1
