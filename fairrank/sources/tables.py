"""Materialised stage tables (S5/S6) in the cluster's shared checkpoint folder.

Stages hand each other parquet tables, which also cuts lineage: a lost
executor recomputes from the last written table, never from raw input.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from fairrank.session import ensure_checkpoint_dir


def table_root(spark: SparkSession) -> str:
    # per application: two of them that share the folder never overwrite each other
    return os.path.join(ensure_checkpoint_dir(spark), "fairrank-tables", spark.sparkContext.applicationId)


def table_path(spark: SparkSession, namespace: str, name: str) -> str:
    tag = hashlib.md5(namespace.encode()).hexdigest()[:10]
    return os.path.join(table_root(spark), tag, name)


def materialize(df: DataFrame, namespace: str, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as parquet (overwrite) and return a fresh scan of it."""
    spark = df.sparkSession
    path = table_path(spark, namespace, name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.parquet(path)


#: Rows a bucket should hold, and the most buckets of a table.
BUCKET_ROWS, MOST_BUCKETS = 50_000, 1_000


def bucket_count(rows: int) -> int:
    return max(1, min(MOST_BUCKETS, -(-rows // BUCKET_ROWS)))


def materialize_bucketed(df: DataFrame, namespace: str, name: str, key: str, buckets: int) -> DataFrame:
    """As ``materialize``, in buckets of ``key``: aggregations, windows and distinct rows whose keys hold
    it need no shuffle when they read the table."""
    spark = df.sparkSession
    path = table_path(spark, namespace, name)
    table = "fairrank_" + hashlib.md5(path.encode()).hexdigest()
    (df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).option("path", path)
       .format("parquet").saveAsTable(table))
    return spark.table(table)


def write_dated(df: DataFrame, base_path: str, cutoff: str) -> None:
    """Feature table versioned by cutoff (``cutoff=YYYY-MM-DD`` partition); replaces only that
    cutoff, and an empty table is a version too."""
    df.write.mode("overwrite").parquet(f"{base_path.rstrip('/')}/cutoff={cutoff}")


def read_dated(spark: SparkSession, base_path: str, cutoff: str) -> DataFrame | None:
    """The cutoff's partition if it exists (partition pruning), else None."""
    try:  # asked of Spark, which reaches every store
        return spark.read.parquet(f"{base_path.rstrip('/')}/cutoff={cutoff}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_ordered(df: DataFrame, path: str, keys: list[str]) -> None:
    """Parquet in key order (files hold disjoint key ranges, rows are sorted
    inside each), so that min/max statistics prune reads by key.  The range
    bounds are sampled by Spark; nothing is gathered into one task."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
