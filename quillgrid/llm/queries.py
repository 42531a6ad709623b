"""The registered queries of the operators, over their whole tables, and SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, neardup, quality, topk
from .common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hmm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import predicted

    return predicted(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .extract import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judged

    return judged(table(spark, sf_dir, "pages"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_hmm_score": op2_hmm_score,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_language": op4_language,
    "op5_html_text": op5_html_text,
    "op6_url_filter": op6_url_filter,
    "op7_exact_topk": op7_exact_topk,
    "op8_chat_format": op8_chat_format,
    "op9_quality_rules": op9_quality_rules,
    "op10_minhash_neardup": op10_minhash_neardup,
}

ORACLE: dict[str, str] = {"op7_exact_topk": topk.ORACLE_SQL, "op8_chat_format": chat.ORACLE_SQL, "op9_quality_rules": quality.ORACLE_SQL, "op10_minhash_neardup": neardup.ORACLE_SQL}
