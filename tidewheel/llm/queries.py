"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm import decontaminate, htmltext, langid, mixing, pii, quality, secrets, tokens, toxicity, trie, vectors
from tidewheel.llm.neardup import near_duplicates
from tidewheel.llm.session import read


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_held_out(read(spark, sf_dir, "documents"))


def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=4, percent=80)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_held_out(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read(spark, sf_dir, "pages"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_held_out(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(read(spark, sf_dir, "embeddings"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(read(spark, sf_dir, "conversations"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_minhash_neardup": op2_minhash_neardup,
    "op3_personal_data": op3_personal_data,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_mixing": op6_mixing,
    "op7_html_text": op7_html_text,
    "op8_secrets": op8_secrets,
    "op9_quality": op9_quality,
    "op10_nearest_vectors": op10_nearest_vectors,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_token_counts": op12_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": decontaminate.ORACLE_SQL,
    "op6_mixing": mixing.ORACLE_SQL,
    "op11_prefix_trie": trie.ORACLE_SQL,
}
