"""The registered queries of the operators in this subpackage, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from carecheck.llm import (
    byte_bpe, html_extract, kd_search, near_dedup, packing, periodic_runs, pitman_yor, quality, ring, rmq_search, rule_ledger, suffix_dedup,
    word_table,
)
from carecheck.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(read(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.with_classes(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.classify(docs, docs, read(spark, sf_dir, "labels"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_decode(read(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)


def op6_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ledger.judge(read(spark, sf_dir, "documents"))


def op7_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return kd_search.top_k(vectors, vectors.filter("vec_id % 100 = 0"))


def op8_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.assign(read(spark, sf_dir, "documents"))


def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(read(spark, sf_dir, "documents"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(read(spark, sf_dir, "pages"))


def op11_rmq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rmq_search.top_k(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.runs(read(spark, sf_dir, "documents"), rewrite=periodic_runs.repeated_tail)


def op13_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_table.encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_suffix_dedup, op2_packing, op3_near_dedup, op4_quality, op5_byte_bpe, op6_rule_ledger, op7_kd_search,
    op8_ring_sharding, op9_pitman_yor, op10_html_extract, op11_rmq_search, op12_periodic_runs, op13_word_table_bpe,
)}
ORACLES: dict[str, str] = {"op6_rule_ledger": rule_ledger.ORACLE_SQL, "op7_kd_search": kd_search.ORACLE_SQL, "op11_rmq_search": rmq_search.ORACLE_SQL}
