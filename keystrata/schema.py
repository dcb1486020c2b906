"""Schemas, options and errors."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T

VERSION_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("seq", T.LongType(), False),
        T.StructField("deleted", T.BooleanType(), False),
    ]
)
MUTATION_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("deleted", T.BooleanType(), False),
        T.StructField("ord", T.LongType(), False),
    ]
)
FILE_META_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("level", T.IntegerType(), False),
        T.StructField("min_key", T.BinaryType(), True),
        T.StructField("max_key", T.BinaryType(), True),
        T.StructField("max_seq", T.LongType(), False),
        T.StructField("entries", T.LongType(), False),
        T.StructField("file_size", T.LongType(), False),
    ]
)
LOG_SCHEMA = T.StructType(
    [
        T.StructField("writer", T.StringType(), False),
        T.StructField("frame", T.LongType(), False),
        T.StructField("ord", T.LongType(), False),
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("deleted", T.BooleanType(), False),
    ]
)
STATS_SCHEMA = T.StructType([T.StructField(n, T.LongType(), False) for n in ("memtable_bytes", "memtable_keys", "sst_files", "wal_size")])


class KeystrataError(Exception):
    """Base of all errors of a table."""


class Closed(KeystrataError):
    pass


class NotFound(KeystrataError):
    pass


class Invalid(KeystrataError):
    pass


class ReadOnly(KeystrataError):
    pass


class Conflict(KeystrataError):
    """Another writer has committed the manifest version that this one wanted."""


class Damaged(KeystrataError):
    """The log has a broken frame that isn't its torn tail."""


class SyncPolicy(Enum):
    """When the log of single mutations is durable: at once, every ``sync_every_n`` of them, or at ``sync`` only."""

    FULL = 0
    BATCH = 1
    NONE = 2


@dataclass(frozen=True)
class Options:
    memtable_bytes: int = 4 << 20
    sync_policy: SyncPolicy = SyncPolicy.FULL
    sync_every_n: int = 32
    compact_threshold: int = 2
    read_only: bool = False

    def normalized(self) -> Options:
        """Values that aren't positive take their defaults."""
        return Options(
            self.memtable_bytes if self.memtable_bytes > 0 else 4 << 20,
            self.sync_policy,
            self.sync_every_n if self.sync_every_n > 0 else 32,
            self.compact_threshold if self.compact_threshold > 0 else 2,
            self.read_only,
        )
