"""Feature store: tables versioned by cutoff, built when they are missing.

A table of a cutoff counts as there only if its marker is: the marker is written last, so what an
interrupted run has left is built again.  Markers hold the table's row count and columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairrank.sources.tables import read_dated, write_dated


class FeatureStore:
    def __init__(self, spark: SparkSession, base_path: str):
        self.spark, self.base = spark, base_path.rstrip("/")

    def _markers(self, name: str) -> str:
        return f"{self.base}/_done/{name}"

    def marker(self, name: str, cutoff: str):
        """The marker's row (rows, columns), None if the table isn't finished."""
        found = read_dated(self.spark, self._markers(name), cutoff)
        return found.first() if found is not None else None

    def get(self, name: str, cutoff: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table of this cutoff, from the store or built and stored."""
        if self.marker(name, cutoff) is None:
            write_dated(build(), f"{self.base}/{name}", cutoff)
            table = read_dated(self.spark, f"{self.base}/{name}", cutoff)
            line = table.agg(F.count(F.lit(1)).alias("rows"), F.lit(",".join(table.columns)).alias("columns"))
            write_dated(line.coalesce(1), self._markers(name), cutoff)
        return read_dated(self.spark, f"{self.base}/{name}", cutoff)

    def listing(self, name: str) -> DataFrame:
        """(cutoff, rows, columns) of every finished version of a table."""
        return self.spark.read.option("basePath", self._markers(name)).parquet(self._markers(name)).select(
            F.col("cutoff").cast("string").alias("cutoff"), "rows", "columns")
