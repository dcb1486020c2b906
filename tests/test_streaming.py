from keystrata.sources.table import Table
from keystrata.streaming.tail import into_table, latest

SCHEMA = "key binary, value binary, seq long, deleted boolean"


def feed(spark, at, rows, n):
    spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v), s, d) for k, v, s, d in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/b{n}")


def test_latest_with_late_versions(spark, tmp_path):
    src, ck = f"{tmp_path}/in", f"{tmp_path}/ck"
    got = {}

    def keep(batch, _):
        got.update({bytes(r.key): (r.seq, r.deleted) for r in batch.collect()})

    def run():
        s = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(src)
        latest(s).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()

    feed(spark, src, [(b"a", b"1", 1, False), (b"b", b"2", 5, False), (b"c", None, 9, True)], 1)
    run()
    feed(spark, src, [(b"a", b"3", 7, False), (b"b", b"late", 2, False), (b"c", b"late", 8, False)], 2)
    run()
    assert got == {b"a": (7, False), b"b": (5, False), b"c": (9, True)}


def test_stream_into_table(spark, tmp_path):
    src = f"{tmp_path}/in"
    t = Table.open(spark, f"file://{tmp_path}/t")
    for n, rows in enumerate([[(b"a", b"1", 1, False), (b"a", b"2", 2, False), (b"b", b"x", 3, False)], [(b"b", None, 4, True), (b"c", b"y", 5, False)]]):
        feed(spark, src, rows, n)
        s = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(src)
        into_table(s, t, f"{tmp_path}/ck").awaitTermination()
    assert [(bytes(r.key), bytes(r.value)) for r in t.scan().collect()] == [(b"a", b"2"), (b"c", b"y")]


def test_late_and_repeated_batches(spark, tmp_path):
    src = f"{tmp_path}/in"
    t = Table.open(spark, f"file://{tmp_path}/t")

    def run():
        s = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(src)
        into_table(s, t, f"{tmp_path}/ck", name="feed").awaitTermination()

    feed(spark, src, [(b"a", b"new", 9, False)], 0)
    run()
    feed(spark, src, [(b"a", b"late", 2, False), (b"b", b"x", 3, False), (b"b", b"y", 3, False)], 1)
    run()
    assert {bytes(r.key): (bytes(r.value), r.seq) for r in t.scan().collect()} == {b"a": (b"new", 9), b"b": (b"y", 3)}
    again = spark.createDataFrame([(bytearray(b"a"), bytearray(b"again"), 99, False)], SCHEMA)
    assert not t.append_versions(again, "feed", 1) and t.get(b"a") == b"new"
    assert t.append_versions(again, "feed", 2) and t.get(b"a") == b"again"
    t.put(b"a", b"after")
    assert t.get(b"a") == b"after" and t.max_seq() == 100
