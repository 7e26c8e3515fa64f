"""The queries of this subpackage, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    chat, decontaminate, exact_dedup, fill_middle, language_model, licenses, line_dedup, merkle, minhash_dedup, quality, sentence_pieces, substring_dedup, toxicity
)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.piece_report(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_groups(table(spark, sf_dir, "documents")).drop("text_hash", "component")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeat_report(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(chat.format_chat(chat.with_marked(table(spark, sf_dir, "conversations"))))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fim_report(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(table(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        op1_sentencepiece, op2_license_scan, op3_exact_dedup, op4_minhash_dedup, op5_toxicity, op6_lm_score, op7_line_dedup, op8_substring_dedup,
        op9_chat_format, op10_decontaminate, op11_fill_in_middle, op12_merkle_manifest, op13_quality
    )
}
SQL: dict[str, str] = {
    "op3_exact_dedup": exact_dedup.SQL,
    "op4_minhash_dedup": minhash_dedup.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op9_chat_format": chat.SQL,
    "op10_decontaminate": decontaminate.SQL,
    "op11_fill_in_middle": fill_middle.SQL,
    "op12_merkle_manifest": merkle.SQL,
}
