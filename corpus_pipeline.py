"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its rows are written as Parquet in the
shared folder and read again as the next stage's ``docs``.  All but the last return the columns of documents.

Null, empty and short texts fail the quality rules; a stage called by itself takes them too: they are near-duplicates
of each other, hold no personal data, have no words to mix and pack as the closing id alone.  Rows without an id are
kept like others (one of a component beside the one with an id), repeated rows become one at near-duplicates, very
long texts go whole through every stage, an empty table gives no rows, and extra columns travel along unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import mixing, packing, pii, quality, simhash
from keystrata.llm.common import table, written
from keystrata.shipping import ship


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.passing(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays: the one with the smallest id."""
    return simhash.deduplicated(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced in the text, and ``n_chars`` follows it."""
    masked = pii.redacted(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in masked.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by probabilities raked to the target marginals."""
    return mixing.sampled(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is cut and packed into token windows."""
    return packing.pack(docs)


STAGES = [
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: SimHash components and byte-level BPE are beyond SQL; tests/llm/test_pipeline.py holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
