"""The registered queries of this subpackage: each operator over its whole table, with
production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concourse.llm import (bpe_merge, compression_quality, hnsw, imatch, licenses, mixing, order_minhash, quotation,
                           records, reversed_search, sharding, toxicity, whitening)
from concourse.llm.common import table

SHARDS = 40
NEAREST = 5
QUERY_EVERY = 50


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "source", "size", "source_size", "target",
                       (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licences(table(spark, sf_dir, "documents"))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


def op4_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.conversations(quotation.quoting_messages(table(spark, sf_dir, "conversations")))


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_fingerprints(table(spark, sf_dir, "documents"))


def op6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.record_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_merge.encode_documents(table(spark, sf_dir, "documents"),
                                      public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0, NEAREST)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reversed_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_licence_scan, op3_shards, op4_quotation, op5_imatch, op6_records, op7_byte_bpe,
    op8_order_minhash, op9_hnsw, op10_toxicity, op11_whitening, op12_compression_quality, op13_reversed_search)}
ORACLE_SQL = {"op2_licence_scan": licenses.scan_sql(), "op5_imatch": imatch.edited_sql(),
              "op13_reversed_search": reversed_search.ranked_sql()}
