"""The training-data pipeline: five operators in a row over the documents.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns documents, but
for the last, which returns the encoding of each document. Each stage's rows are written as Parquet in the
shared checkpoint folder and read again, which also cuts the lineage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioflow.llm.bpe_codec import encode_documents
from folioflow.llm.common import prepare_checkpoints, table
from folioflow.llm.decontamination import drop_contaminated
from folioflow.llm.language_id import drop_undetermined
from folioflow.llm.line_dedup import drop_repeated_chunks
from folioflow.llm.near_dedup import keep_dissimilar


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return drop_undetermined(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks of lines that an earlier document has; one that loses all goes."""
    return drop_repeated_chunks(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    return keep_dissimilar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("bpe_encoding", bpe_encoding)]

#: SQL cannot express the model and the tokenizer; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents table."""
    prepare_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
