"""A training corpus from ``documents``: toxic documents go, one document of each class of
near-duplicates stays, sources are mixed to their target weights, and what is left is
encoded. Each stage is written as Parquet and read again by the next.

``run`` returns the last stage's rows: one per copy of a document that the mix takes.
SQL cannot express the stages (nearest-neighbour votes, minimum hashes, random rounding);
tests hold each against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from concourse.llm.bpe_merge import encode_documents
from concourse.llm.common import staged, table
from concourse.llm.mixing import mix_sources
from concourse.llm.order_minhash import drop_near_duplicates
from concourse.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("encoding", encoding)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
