"""Reads over a version log: gets, existence, seeks, ranges, prefixes, ordered scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bytesx import has_prefix, in_range
from .resolve import resolve, visible


def get(versions: DataFrame, key, name: str = "key", **how) -> DataFrame:
    """The live version of one key, or no row.  The key filter stands below resolution, at the scan."""
    return visible(versions.filter(F.col(name) == F.lit(key)), key=name, **how)


def get_raw(versions: DataFrame, key, name: str = "key", **how) -> DataFrame:
    """The newest version of one key, a tombstone too."""
    return resolve(versions.filter(F.col(name) == F.lit(key)), key=name, **how)


def has(versions: DataFrame, key, name: str = "key", **how) -> bool:
    return not get(versions, key, name, **how).isEmpty()


def multi_get(versions: DataFrame, keys: DataFrame, name: str = "key", **how) -> DataFrame:
    """Live versions of many keys: the log is reduced to the keys before it is resolved.

    Spark chooses between broadcasting the keys and a shuffled join by their measured size.
    """
    return visible(versions.join(keys.select(name).distinct(), name, "left_semi"), key=name, **how)


def has_many(versions: DataFrame, keys: DataFrame, name: str = "key", found: str = "found", **how) -> DataFrame:
    """Each row of ``keys`` with whether its key is live."""
    live = multi_get(versions, keys, name, **how).select(name, F.lit(True).alias(found))
    return keys.join(live, name, "left").withColumn(found, F.coalesce(found, F.lit(False)))


def scan(versions: DataFrame, name: str = "key", **how) -> DataFrame:
    """All live versions in key order."""
    return visible(versions, key=name, **how).orderBy(name)


def snapshot(versions: DataFrame, name: str = "key", **how) -> DataFrame:
    """The newest version of every key in key order, tombstones included."""
    return resolve(versions, key=name, **how).orderBy(name)


def seek(versions: DataFrame, target, limit: int | None = None, name: str = "key", **how) -> DataFrame:
    """Live versions from the first key at or after ``target`` on; with ``limit`` a top-k, not a sort of all."""
    out = visible(versions.filter(F.col(name) >= F.lit(target)), key=name, **how).orderBy(name)
    return out if limit is None else out.limit(limit)


def first_at_or_after(keys: DataFrame, target, name: str = "key", none: str | None = "") -> DataFrame:
    """One row: the least key at or after ``target``, or ``none`` past the last."""
    low = F.min(name)
    return keys.filter(F.col(name) >= F.lit(target)).agg((F.coalesce(low, F.lit(none)) if none is not None else low).alias(name))


def key_range(versions: DataFrame, low=None, high=None, raw: bool = True, name: str = "key", **how) -> DataFrame:
    """Keys in ``[low, high)`` (None: open) in order; ``raw`` keeps tombstones."""
    kept = versions.filter(in_range(name, low, high))
    return (resolve(kept, key=name, **how) if raw else visible(kept, key=name, **how)).orderBy(name)


def prefix_scan(versions: DataFrame, prefix, name: str = "key", **how) -> DataFrame:
    """Live versions whose key begins with ``prefix``, in order."""
    return visible(versions.filter(has_prefix(name, prefix)), key=name, **how).orderBy(name)
