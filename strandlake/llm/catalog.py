"""The registered corpus queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chat_formatting, compact_windows, language_id, merkle, minhash_dedup, quality_rules, suffix_dedup, token_files, token_packing
from .common import table

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_formatting.op1_chat_formatting(spark, table(spark, sf_dir, "conversations"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.op2_fingerprints(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op3_suffix_dedup(table(spark, sf_dir, "documents"))


def op4_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.op4_compact_windows(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op5_quality_rules(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.op6_token_files(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.op7_byte_bpe(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op8_language_id(table(spark, sf_dir, "documents"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.op9_minhash_dedup(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_packing.op10_packing(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_formatting, op2_fingerprints, op3_suffix_dedup, op4_compact_windows, op5_quality_rules, op6_token_files, op7_byte_bpe, op8_language_id, op9_minhash_dedup, op10_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": chat_formatting.ORACLE, "op5_quality_rules": quality_rules.ORACLE}
