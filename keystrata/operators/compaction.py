"""Compaction planning over run metadata, and checks of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .resolve import fresh


def plan_level0(files: Sequence[dict], threshold: int = 4) -> list[dict]:
    """All files of level 0 if there are at least ``threshold`` (4 if it isn't positive), else none."""
    threshold = threshold if threshold > 0 else 4
    out = [f for f in files if f["level"] == 0]
    return out if len(out) >= threshold else []


def plan(files: Sequence[dict]) -> list[dict]:
    """Level 0 if it has two files or more, else the first two files, else none."""
    return plan_level0(files, 2) or (list(files[:2]) if len(files) >= 2 else [])


def plan_level0_frame(files: DataFrame, threshold: int = 4) -> DataFrame:
    """``plan_level0`` over a DataFrame of file metadata."""
    threshold = threshold if threshold > 0 else 4
    low, n = files.filter(F.col("level") == 0), fresh("_n", files)
    return low.withColumn(n, F.count("*").over(Window.partitionBy("level"))).filter(F.col(n) >= threshold).drop(n)


def plan_frame(files: DataFrame, order: str = "name") -> DataFrame:
    """``plan`` over a DataFrame of file metadata, whose rows come in the order of ``order``.

    Metadata has a row a run, so one task for it is no bottleneck.
    """
    n, low, at = fresh("_n", files), fresh("_low", files), fresh("_at", files)
    whole = Window.partitionBy()
    ranked = files.withColumns({n: F.count("*").over(whole), low: F.count(F.when(F.col("level") == 0, 1)).over(whole), at: F.row_number().over(Window.orderBy(order))})
    taken = F.when(F.col(low) >= 2, F.col("level") == 0).otherwise((F.col(n) >= 2) & (F.col(at) <= 2))
    return ranked.filter(taken).drop(n, low, at)


def pick_by_size(files: DataFrame, n: int, size: str = "file_size", name: str = "name") -> DataFrame:
    """The ``n`` smallest files; ties by name.  A top-k, not a sort."""
    return files.orderBy(size, name).limit(max(0, n))


def run_stats(versions: DataFrame, run: str = "run", key: str = "key", seq: str = "seq") -> DataFrame:
    """Per run: least and greatest key, greatest sequence number, entries."""
    return versions.groupBy(run).agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.max(seq).alias("max_seq"), F.count("*").alias("entries"))


def unsorted_pairs(rows: DataFrame, key: str, order: str, partitions: int | None = None) -> DataFrame:
    """One row ``n_unsorted``: how many rows have a smaller key than the row before; 0 means sorted (equal keys may repeat).

    The rows are range-partitioned by ``order``; each partition checks its own neighbours, and only the first
    and last row of each partition meet in one task.
    """
    dealt = (rows.repartitionByRange(partitions, order) if partitions else rows.repartitionByRange(order)).select(F.col(order).alias("o"), F.col(key).alias("k"), F.spark_partition_id().alias("p"))
    w = Window.partitionBy("p").orderBy("o")
    inner = dealt.withColumn("before", F.lag("k").over(w)).groupBy("p").agg(
        F.sum((F.col("before") > F.col("k")).cast("long")).alias("bad"), F.min(F.struct("o", "k")).alias("first"), F.max(F.struct("o", "k")).alias("last")
    )
    seams = inner.withColumn("before", F.lag("last").over(Window.orderBy("first.o")))
    return seams.agg(F.coalesce(F.sum(F.coalesce("bad", F.lit(0)) + F.coalesce((F.col("before")["k"] > F.col("first")["k"]).cast("long"), F.lit(0))), F.lit(0)).cast("long").alias("n_unsorted"))
