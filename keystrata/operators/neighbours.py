"""Neighbours in a total order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .resolve import fresh


def with_previous(rows: DataFrame, value: str, order: Sequence[str], name: str, partitions: int | None = None) -> DataFrame:
    """``rows`` with ``name``: ``value`` of the row before in ``order``; null for the first.

    Rows are range-partitioned by ``order``, so a partition knows all but its first row's neighbour; only the last
    row of each partition meets the others (as many rows as partitions, so their broadcast is bounded).
    """
    part, last = fresh("_part", rows), fresh("_last", rows)
    dealt = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    dealt = dealt.withColumn(part, F.spark_partition_id())
    inner = dealt.withColumn(name, F.lag(value).over(Window.partitionBy(part).orderBy(*order))).withColumn(last, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    ends = dealt.groupBy(F.col(part).alias("_p")).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_end"))
    seams = ends.withColumn("_before", F.lag("_end").over(Window.orderBy("_p"))).select("_p", "_before")
    joined = inner.join(F.broadcast(seams), inner[part] == seams["_p"])
    return joined.withColumn(name, F.when(F.col(last) == 1, F.col("_before")["v"]).otherwise(F.col(name))).select(*rows.columns, name)
