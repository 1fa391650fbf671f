"""The three splits are built side by side, after what they share."""

import threading
from types import SimpleNamespace

from pyspark.sql import functions as F

from fairrank.plans import queries_reco


def test_splits_meet_while_they_are_built(spark, monkeypatch):
    met = threading.Barrier(3, timeout=20)
    seen = []

    class Shared(SimpleNamespace):
        @property
        def history(self):
            seen.append("history")

        @property
        def cutoffs(self):
            seen.append("cutoffs")
            return SimpleNamespace(for_split=lambda name: "2020-01-01")

    def split_at(ctx, name):
        assert seen[:2] == ["history", "cutoffs"]
        met.wait()  # breaks if the others are not being built
        return spark.createDataFrame([(name,)], "split string")

    monkeypatch.setattr(queries_reco, "_split_at", split_at)
    out = queries_reco._each_split(Shared(spark=spark), lambda rows, cfg: rows.withColumn("of", F.lit(cfg.name)))
    assert [tuple(r) for r in out.collect()] == [(n, n) for n in ("train", "val", "test")]
