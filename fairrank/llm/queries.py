"""One registered query per operator, over its whole tables, and the whole pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fairrank.llm import (ann, chat, decontaminate, html_extract, line_dedup, lz_fingerprint, mixing, quality,
                          repair, simhash, substring_dedup, url_filter, whitening)
from fairrank.llm.common import pick, read_table
from fairrank.llm.oracle import ORACLE


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read_table(spark, sf_dir, "pages"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(pick(read_table(spark, sf_dir, "documents"), ["doc_id", "text"]))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_pages(read_table(spark, sf_dir, "pages"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(pick(read_table(spark, sf_dir, "documents"), ["doc_id", "text"]))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read_table(spark, sf_dir, "conversations"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.compare_with_neighbours(read_table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_components(read_table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(read_table(spark, sf_dir, "conversations")), gone_col="gone")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_html_extract, op2_substring_dedup, op3_quality_classifier, op4_source_mixing, op5_ann_search,
           op6_url_filter, op7_simhash_dedup, op8_line_dedup, op9_chat_format, op10_decontamination, op11_lz_fingerprint,
           op12_embedding_whitening, op13_conversation_repair)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
