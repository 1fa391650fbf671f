"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairrank.session import ensure_checkpoint_dir

#: Rows per Arrow batch of the Python operators: a batch of long documents stays small.
ARROW_ROWS = 500
#: White space of the contracts (space, tab, line feed, vertical tab, form feed, return).
ASCII_SPACE = r"\x20\x09-\x0D"


def pick(df: DataFrame, names: list[str]) -> DataFrame:
    """Exactly these columns, found by exact name; extra columns whose names differ only in
    case (or that repeat a name) neither disturb nor survive."""
    cols = df.columns
    flat = df.toDF(*[f"_c{i}" for i in range(len(cols))])
    return flat.select(*[F.col(f"_c{cols.index(n)}").alias(n) for n in names])


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """All columns renamed by position, and where each (first) name went; undo with
    ``toDF(*df.columns)``.  Operators that return their input's columns work on this."""
    cols = df.columns
    return (df.toDF(*[f"_c{i}" for i in range(len(cols))]),
            {n: f"_c{i}" for i, n in reversed(list(enumerate(cols)))})


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Lower the session's Arrow batch size so that Python workers hold few long texts at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared checkpoint folder and read it back.

    Cuts lineage so that a lost executor never recomputes from raw text, and fixes the
    values of anything computed once (row order, random keys).
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/fairrank-llm/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
