"""The corpus pipeline: five operators of ``fairrank.llm`` in a row, each stage written as Parquet
and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairrank.llm import decontaminate, line_dedup, mixing, quality, simhash
from fairrank.llm.common import positional, read_table
from fairrank.session import ensure_checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the multi-line chunks that occur earlier in the corpus."""
    # n_chars describes the text that is left; without the old one, both joins of the operator
    # read the same columns and share one exchange
    flat, at = positional(docs)
    rest = [f"_c{i}" for i, c in enumerate(docs.columns) if c != "n_chars"]
    out = line_dedup.dedup_lines(flat.select(*rest), at["doc_id"], at["text"])
    return out.select(*[F.length(at["text"]).cast("bigint") if c == "n_chars" else F.col(f"_c{i}")
                        for i, c in enumerate(docs.columns)]).toDF(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document, whole, as often as it is taken."""
    return mixing.mix_documents(docs)


STAGES = [("quality", quality_stage), ("line_dedup", line_dedup_stage), ("simhash", simhash_stage),
          ("decontamination", decontamination_stage), ("mixing", mixing_stage)]

#: SQL has neither the classifier nor XXH64; tests check the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    top = f"{ensure_checkpoint_dir(spark).rstrip('/')}/fairrank-llm/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return docs
