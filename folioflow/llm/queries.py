"""The registered queries opN_<name> of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import clustering, decontamination, hard_negatives, minhash_dedup, quality_rules, url_filter
from .bpe_codec import encode_documents
from .common import table
from .language_id import predict_languages
from .line_dedup import repeated_chunks
from .simhash_dedup import near_duplicates
from .substring_dedup import remove_repeats
from .suffix_dedup import remove_repeated_bytes
from .token_counts import count_tokens

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"), keep_spans=False)


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_chunks(table(spark, sf_dir, "documents"), keep_text=False)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(table(spark, sf_dir, "embeddings")).drop("n_looked")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine_negatives(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_bpe_codec,
        op3_language_id,
        op4_line_dedup,
        op5_simhash_dedup,
        op6_decontamination,
        op7_token_counts,
        op8_url_filter,
        op9_substring_dedup,
        op10_quality_rules,
        op11_minhash_dedup,
        op12_clustering,
        op13_hard_negatives,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op6_decontamination": decontamination.ORACLE,
    "op8_url_filter": url_filter.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
    "op11_minhash_dedup": minhash_dedup.ORACLE,
    "op12_clustering": clustering.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
