"""Last-write-wins resolution: the one definition that every read goes through.

``row_number() = 1`` per key compiles to a partial and a final ``WindowGroupLimit`` around one exchange: each
task keeps one version of a key before the shuffle, so a key with a third of all versions sends a row per
task.  Key filters above it are pushed to the scan; filters on values and tombstones never are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name like ``name`` that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def newest(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    n = fresh("_rn", rows)
    return rows.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(n) == 1).drop(n)


def resolve(versions: DataFrame, key: str | Sequence[str] = "key", seq: str = "seq", src: str | None = None) -> DataFrame:
    """The version with the greatest ``seq`` of each key, tombstones included; on ties the least ``src``."""
    return newest(versions, [key] if isinstance(key, str) else list(key), F.col(seq).desc(), *([F.col(src).asc()] if src else []))


def visible(versions: DataFrame, key: str | Sequence[str] = "key", seq: str = "seq", deleted: str = "deleted", src: str | None = None) -> DataFrame:
    """Live versions: tombstones are hidden after resolution, or older values would reappear."""
    return resolve(versions, key, seq, src).filter(~F.col(deleted))


def merge(runs: Sequence[DataFrame], drop_tombstones: bool = False, key: str = "key", seq: str = "seq", deleted: str = "deleted") -> DataFrame:
    """Runs merged to one version a key; on equal ``seq`` the earlier run wins."""
    if not runs:
        raise ValueError("nothing to merge")
    out, src = None, fresh("_src", *runs)
    for i, r in enumerate(runs):
        r = r.withColumn(src, F.lit(i))
        out = r if out is None else out.unionByName(r)
    out = resolve(out, key, seq, src).drop(src)
    return out.filter(~F.col(deleted)) if drop_tombstones else out


def merge_metrics(versions: DataFrame, drop_tombstones: bool = False, key: str | Sequence[str] = "key", seq: str = "seq", deleted: str = "deleted") -> DataFrame:
    """One row: ``kept_tombstones``, and ``dropped_obsolete`` (older versions, and tombstones if they are dropped)."""
    # one pass: each task sends a count and the newest flag of a key; versions with one seq are one version stored twice
    keys = [key] if isinstance(key, str) else list(key)
    per_key = versions.groupBy(*keys).agg(F.count("*").alias("_n"), F.max_by(deleted, seq).alias("_dead"))
    dead = F.coalesce(F.sum(F.col("_dead").cast("long")), F.lit(0))
    older = F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))
    return per_key.agg(
        (F.lit(0) if drop_tombstones else dead).cast("long").alias("kept_tombstones"),
        (older + dead if drop_tombstones else older).cast("long").alias("dropped_obsolete"),
    )


def as_of(versions: DataFrame, at: int, **how) -> DataFrame:
    """What was visible when ``at`` was the last sequence number."""
    return visible(versions.filter(F.col(how.get("seq", "seq")) <= at), **how)
