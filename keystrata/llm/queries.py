"""The registered queries: thin adapters from each operator's output to its digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, licenses, lm_score, mixing, packing, pii, quality, simhash, substrings, topk
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.neighbours(table(spark, sf_dir, "embeddings"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.deduplicated(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decisions(table(spark, sf_dir, "documents")).withColumns({k: F.round(k, 6) for k in ("probability", "residual")})


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumn("notices", F.array_join("notices", ","))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lm_score.scored(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 5).alias("mean_log_score"))


QUERIES: dict[str, Query] = {
    "op1_html": op1_html,
    "op2_topk": op2_topk,
    "op3_packing": op3_packing,
    "op4_simhash": op4_simhash,
    "op5_quality": op5_quality,
    "op6_substrings": op6_substrings,
    "op7_pii": op7_pii,
    "op8_mixing": op8_mixing,
    "op9_licenses": op9_licenses,
    "op10_lm": op10_lm,
}

ORACLES: dict[str, str] = {
    "op2_topk": topk.ORACLE_SQL,
    "op5_quality": quality.ORACLE_SQL,
    "op6_substrings": substrings.ORACLE_SQL,
    "op7_pii": pii.ORACLE_SQL,
    "op8_mixing": mixing.ORACLE_SQL,
    "op9_licenses": licenses.ORACLE_SQL,
    "op10_lm": lm_score.ORACLE_SQL,
}
