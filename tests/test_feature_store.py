"""Build-if-missing with a marker that is written last."""

from pyspark.sql import functions as F

from fairrank.sources.store import FeatureStore
from fairrank.sources.tables import write_dated


def test_half_written_versions_are_built_again(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "s"))
    built = []

    def build(n):
        built.append(n)
        return spark.range(n).select("id", (F.col("id") * 2).alias("x"))
    assert store.get("t", "2024-01-01", lambda: build(5)).count() == 5
    assert store.get("t", "2024-01-01", lambda: build(99)).columns == ["id", "x"] and built == [5]
    # a run that died after the rows, before the marker
    write_dated(spark.range(3).select("id", F.lit(0).alias("x")), str(tmp_path / "s" / "t"), "2024-02-01")
    assert store.marker("t", "2024-02-01") is None
    assert store.get("t", "2024-02-01", lambda: build(7)).count() == 7 and built == [5, 7]
    # other versions stay as they are
    assert store.get("t", "2024-01-01", lambda: build(99)).count() == 5
    assert sorted(map(tuple, store.listing("t").collect())) == [("2024-01-01", 5, "id,x"), ("2024-02-01", 7, "id,x")]
    # an empty table is a version too
    assert store.get("t", "2024-03-01", lambda: build(0)).count() == 0
    assert store.get("t", "2024-03-01", lambda: build(99)).count() == 0
