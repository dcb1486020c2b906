"""Shared pieces: table access, durable intermediates, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or in local mode one of our own where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='keystrata-')}"
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Intermediate tables that cut the lineage, in the shared folder: ``drop`` deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self._spark, self._paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """The rows written as Parquet and read again.  What isn't dropped goes when the session's JVM ends (``deleteOnExit``)."""
        path = f"{shared_dir(self._spark)}/keystrata/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        self._paths.append(path)
        self._at(path, lambda fs, at: fs.deleteOnExit(at))
        return self._spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        for path in self._paths:
            self._at(path, lambda fs, at: (fs.delete(at, True), fs.cancelDeleteOnExit(at)))
        self._paths = []

    def _at(self, path: str, act) -> None:
        at = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        act(at.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()), at)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: written to the shared folder and read again, kept while the session lives."""
    return Scratch(df.sparkSession).written(df, name)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with these settings for the jobs run inside."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def arrow_batches(spark: SparkSession, size: str):
    """Bounds the bytes of an Arrow batch for the jobs run inside: rows that are blocks of columns weigh megabytes."""
    return settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": size})


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(u, v)`` links to ``(node, root)``: the smallest node that each linked node reaches.

    Alternating large-star and small-star rounds.  Minima are taken by ``groupBy`` (combined before the
    shuffle) and joined back, so a hub with a third of all nodes is split by the adaptive skew join
    rather than gathered.  Null ends and self-links are dropped; roots and nodes without links don't appear.
    """
    spark = edges.sparkSession
    old, new = Scratch(spark), Scratch(spark)
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), F.col("u").isNotNull().alias("_a"), F.col("v").isNotNull().alias("_b"))
    e = old.written(e.filter("_a and _b and u <> v").select("u", "v").distinct(), "edges")
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    last = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = old.written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "low")
        large = both.join(low, both["u"] == low["k"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = old.written(large, "large")
        low = old.written(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"), "low")
        moved = large.join(low, large["u"] == low["k"]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = new.written(moved.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        old.drop()  # of the round only its edges are read again
        old, new = new, Scratch(spark)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = now
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")
