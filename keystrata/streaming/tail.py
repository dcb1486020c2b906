"""A last-write-wins tail over a stream of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.table import Table


def latest(stream: DataFrame) -> DataFrame:
    """The newest version of each key so far (``update`` mode), tombstones included.

    State holds one version a key, whatever comes late or twice; a tombstone must stay in it, as an older put
    could still arrive.
    """
    won = F.max_by(F.struct("value", "seq", "deleted"), "seq")
    return stream.groupBy("key").agg(won.alias("v")).select("key", "v.value", "v.seq", "v.deleted")


def into_table(stream: DataFrame, table: Table, checkpoint: str, order: str = "seq", name: str | None = None, **trigger) -> StreamingQuery:
    """Append each micro-batch of ``key, value, deleted, <order>`` to a table as one run, reduced to its newest versions.

    ``order`` becomes the sequence number, so a version that comes late doesn't beat a newer one.  The number of
    the last batch is committed with its run under ``name`` (the checkpoint's place by default): a batch that is
    delivered again after a failure is passed over.
    """

    def append(batch: DataFrame, number: int) -> None:
        rows = batch.select("key", "value", "deleted", F.col(order).cast("long").alias("seq"))
        table.append_versions(rows, name or checkpoint, number)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
