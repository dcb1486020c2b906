import random

import pytest
from pyspark.sql import functions as F

from keystrata.operators import compaction
from keystrata.schema import Closed, Conflict, Damaged, Invalid, NotFound, Options, ReadOnly, SyncPolicy
from keystrata.sources.log import FRAME_OVERHEAD, OP_OVERHEAD, Frame, decode, encode
from keystrata.sources.table import MAX_SEQ, Table, WriteBatch


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/t"


def test_basic_put_get(spark, root):
    with Table.open(spark, root) as t:
        t.put(b"a", b"1")
        t.put(b"b", b"2")
        assert t.get(b"a") == b"1" and t.get(b"b") == b"2"
        with pytest.raises(NotFound):
            t.get(b"missing")


def test_persistence_across_reopen(spark, root):
    t = Table.open(spark, root)
    t.put(b"persist", b"yes")
    t.flush()
    t.close()
    assert Table.open(spark, root).get(b"persist") == b"yes"


def test_tombstone_survives_flush_and_compaction(spark, root):
    t = Table.open(spark, root, Options(memtable_bytes=1 << 20))
    t.put(b"k", b"old")
    t.flush()
    t.delete(b"k")
    t.flush()
    done = t.compact()
    assert done["kept_tombstones"] == 1 and done["dropped_obsolete"] == 1
    with pytest.raises(NotFound):
        t.get(b"k")
    t.close()
    t = Table.open(spark, root)
    with pytest.raises(NotFound):
        t.get(b"k")
    assert [tuple(r) for r in t.snapshot().select("deleted").collect()] == [(True,)]


def test_unreferenced_and_partial_files_are_ignored(spark, root, tmp_path):
    t = Table.open(spark, root)
    t.put(b"ok", b"v")
    t.sync()
    t.close()
    (tmp_path / "t/runs/999999-x").mkdir()
    (tmp_path / "t/runs/999999-x/part-0.parquet").write_bytes(b"\x01\x02\x03\x04\x05")
    (tmp_path / "t/_manifest/.half.tmp").write_bytes(b"{")
    t = Table.open(spark, root)
    assert t.get(b"ok") == b"v" and t.scan().count() == 1
    assert t.vacuum() == ["999999-x"]
    assert t.get(b"ok") == b"v"


def test_compaction_reduces_files(spark, root):
    t = Table.open(spark, root)
    for i in range(3):
        t.put(b"key-%d" % i, b"v")
        t.flush()
    before = t.scan()
    assert t.files().count() == 3
    t.compact()
    assert t.files().count() == 1 and t.manifest()["files"][0]["level"] == 1
    assert [t.get(b"key-%d" % i) for i in range(3)] == [b"v"] * 3
    assert before.count() == 3  # a reader's DataFrame outlives the compaction
    assert len(t.vacuum()) == 3 and t.scan().count() == 3
    assert t.compact() is None


def test_write_batch_and_cursor(spark, root):
    t = Table.open(spark, root)
    b = WriteBatch().put(b"x", b"1").put(b"y", b"2").delete(b"x")
    assert len(b) == 3
    t.write(b)
    assert not t.has(b"x") and t.has(b"y")
    c = t.cursor()
    assert not c.valid() and c.key() is None
    c.next()
    assert not c.valid()
    c.seek_to_first()
    assert c.key() == b"y" and c.value() == b"2"
    c.next()
    assert not c.valid()
    c.next()
    b.clear()
    assert len(b) == 0
    t.write(b)
    t.write(None)


def test_close_flushes(spark, root):
    t = Table.open(spark, root)
    t.put(b"mem", b"only")
    t.sync()
    t.close()
    t.close()
    assert Table.open(spark, root).get(b"mem") == b"only"
    with pytest.raises(Closed):
        t.get(b"mem")
    with pytest.raises(Closed):
        t.put(b"a", b"")


def test_seek_is_inclusive_and_pages(spark, root):
    t = Table.open(spark, root)
    for k in (b"ab", b"abc", b"b", b"\x80", b"\xff", b"\xff\xff", b"a\x00"):
        t.put(k, k)
    c = t.cursor(page=2)
    c.seek(b"ab")
    assert c.key() == b"ab"
    assert [k for k, _ in c] == [b"ab", b"abc", b"b", b"\x80", b"\xff", b"\xff\xff"]
    c.seek(b"\xff\xff\x00")
    assert not c.valid()
    assert [bytes(r.key) for r in t.seek(b"ac", 2).collect()] == [b"b", b"\x80"]
    assert [bytes(r.key) for r in t.prefix_scan(b"\xff").collect()] == [b"\xff", b"\xff\xff"]
    assert [bytes(r.key) for r in t.prefix_scan(b"a").collect()] == [b"a\x00", b"ab", b"abc"]
    assert t.prefix_scan(b"").count() == 7
    assert [bytes(r.key) for r in t.key_range(b"ab", b"b").collect()] == [b"ab", b"abc"]


def test_edges(spark, root):
    t = Table.open(spark, root, Options(memtable_bytes=-1))
    assert t.options.memtable_bytes == 4 << 20
    for bad in (b"", None):
        with pytest.raises(Invalid):
            t.put(bad, b"x")
        with pytest.raises(Invalid):
            t.delete(bad)
        with pytest.raises(Invalid):
            t.write(WriteBatch().put(b"ok", b"1").put(bad, b"x"))
    with pytest.raises(Invalid):
        Table.open(spark, "")
    assert not t.has(b"ok") and t.scan().count() == 0 and t.compact() is None
    t.delete(b"never")
    t.put(b"empty", b"")
    t.flush()
    assert t.get(b"empty") == b"" and t.has(b"empty") and not t.has(b"never") and not t.has(b"")
    t.put(b"again", b"1")
    t.delete(b"again")
    t.put(b"again", b"2")
    assert t.get(b"again") == b"2"
    logged = 3 * (FRAME_OVERHEAD + OP_OVERHEAD + len(b"again")) + len(b"12")  # since the flush: put, delete, put
    assert tuple(t.stats().first()) == (len(b"again2") + 16, 1, 1, logged)
    assert "runs=1" in repr(t) and t.path_for("x") == f"{root}/x"
    assert t.approximate_bytes().first()[0] == sum(len(k) + v + 16 for k, v in ((b"never", 0), (b"empty", 0), (b"again", 1)))


def test_auto_flush(spark, root):
    t = Table.open(spark, root, Options(memtable_bytes=100))
    for k in range(5):
        t.put(b"k%d" % k, b"x" * 20)
    assert t.files().count() == 1 and t.stats().first().memtable_keys == 2


def test_read_only(spark, root):
    t = Table.open(spark, root)
    t.put(b"a", b"1")
    t.close()
    r = Table.open(spark, root, Options(read_only=True))
    assert r.get(b"a") == b"1"
    r.sync()
    for act in (lambda: r.put(b"a", b"2"), lambda: r.delete(b"a"), r.flush, r.compact, lambda: r.write(WriteBatch().put(b"b", b"")), r.vacuum):
        with pytest.raises(ReadOnly):
            act()
    r.close()


def test_frames_and_lookups(spark, root):
    t = Table.open(spark, root)
    t.put(b"k1", b"before")
    rows = [(b"k%d" % k, b"v%d" % k, False, k) for k in range(50)] + [(b"k7", None, True, 60), (b"k8", b"new", False, 61), (b"k9", b"old", False, 0)]
    t.write_frame(spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v), d, o) for k, v, d, o in rows], "key binary, value binary, deleted boolean, ord long"))
    assert t.get(b"k1") == b"v1" and not t.has(b"k7") and t.get(b"k8") == b"new" and t.get(b"k9") == b"v9"
    keys = spark.createDataFrame([(bytearray(k),) for k in (b"k1", b"k7", b"zz", b"k1")], "key binary")
    assert sorted((bytes(r.key), r.found) for r in t.has_many(keys).collect()) == [(b"k1", True), (b"k1", True), (b"k7", False), (b"zz", False)]
    assert [bytes(r.value) for r in t.multi_get(keys).collect()] == [b"v1"]
    t.put(b"k1", b"after")
    assert t.get(b"k1") == b"after"
    with pytest.raises(Invalid):
        t.write_frame(spark.createDataFrame([(bytearray(b""), None, True, 1)], "key binary, value binary, deleted boolean, ord long"))


def test_writers_that_meet(spark, root):
    a, b = Table.open(spark, root), Table.open(spark, root)
    a.put(b"k", b"first")
    b.put(b"k", b"second")
    b.put(b"other", b"x")
    a.flush()
    b.flush()  # commits after a, so it wins
    c = Table.open(spark, root)
    assert c.get(b"k") == b"second" and c.get(b"other") == b"x" and c.files().count() == 2
    seqs = [r.seq for r in c.versions().collect()]
    assert len(set(seqs)) == len(seqs)
    a.refresh()
    b.refresh()
    a.compact()
    with pytest.raises(Conflict):
        b.compact()
    assert Table.open(spark, root).get(b"k") == b"second"


def test_mixed_level_compaction_and_dropping(spark, root):
    t = Table.open(spark, root)
    for v in (b"1", b"2"):
        t.put(b"k", v)
        t.flush()
    t.compact()
    t.delete(b"k")
    t.flush()
    assert {f["level"] for f in t.manifest()["files"]} == {0, 1}
    out = t.compact()  # one file of level 0: falls back to the first two
    assert len(out["removed"]) == 2 and not t.has(b"k")
    t.put(b"z", b"1")
    t.flush()
    out = t.compact(drop_tombstones=True)
    assert out["dropped_obsolete"] == 1 and t.snapshot().count() == 1


def test_plans():
    f = [{"name": n, "level": v} for n, v in (("a", 1), ("b", 0), ("c", 0))]
    assert compaction.plan_level0(f, 2) == f[1:] and compaction.plan_level0(f, 3) == [] and compaction.plan_level0(f, 0) == []
    assert compaction.plan(f) == f[1:] and compaction.plan(f[:2]) == f[:2] and compaction.plan(f[:1]) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_model(spark, root, seed):
    """Random mutations against a dict; compaction changes nothing that is visible."""
    rng = random.Random(seed)
    t, model = Table.open(spark, root, Options(memtable_bytes=600)), {}
    keys = [bytes([rng.choice(b"ab\x00\x7f\x80\xff") for _ in range(rng.randint(1, 3))]) for _ in range(25)]
    for step in range(90):
        k, op = rng.choice(keys), rng.random()
        if op < 0.5:
            v = rng.randbytes(rng.randint(0, 5))
            t.put(k, v)
            model[k] = v
        elif op < 0.75:
            t.delete(k)
            model.pop(k, None)
        elif op < 0.85:
            b = WriteBatch()
            for _ in range(4):
                k = rng.choice(keys)
                if rng.random() < 0.5:
                    b.put(k, b"b")
                    model[k] = b"b"
                else:
                    b.delete(k)
                    model.pop(k, None)
            t.write(b)
        elif op < 0.9:
            t.flush()
        elif op < 0.94:
            t.compact()
        elif op < 0.97:
            t.close()
            t = Table.open(spark, root, Options(memtable_bytes=600))
    got = [(bytes(r.key), bytes(r.value)) for r in t.scan().collect()]
    assert got == sorted(model.items())
    t.compact()
    assert [(bytes(r.key), bytes(r.value)) for r in t.scan().collect()] == got
    assert t.snapshot().filter(~F.col("deleted")).count() == len(got)


MUTATIONS = "key binary, value binary, deleted boolean, ord long"


def frame(spark, rows, schema=MUTATIONS):
    return spark.createDataFrame([tuple(bytearray(x) if isinstance(x, bytes) else x for x in r) for r in rows], schema)


def test_ties_of_a_frame_do_not_depend_on_row_order(spark, tmp_path):
    rows = [(b"k", b"a", False, 1), (b"k", b"z", False, 1), (b"m", None, True, 2), (b"m", b"v", False, 2), (b"n", b"old", False, 0), (b"n", None, True, 3), (b"e", None, False, 0)]
    for n, part in enumerate((rows, rows[::-1])):
        t = Table.open(spark, f"file://{tmp_path}/t{n}")
        t.write_frame(frame(spark, part))
        assert {bytes(r.key): bytes(r.value) for r in t.scan().collect()} == {b"k": b"z", b"m": b"v", b"e": b""}
        assert t.versions().count() == 4 and t.manifest()["files"][0]["entries"] == 4


def test_frames_that_are_refused(spark, root):
    t = Table.open(spark, root)
    t.put(b"k", b"1")
    for bad in ((None, b"v", False, 1), (b"k", b"v", None, 1), (b"k", b"v", False, None), (b"k", b"v", False, -1), (b"k", b"v", False, MAX_SEQ)):
        with pytest.raises(Invalid):
            t.write_frame(frame(spark, [(b"ok", b"v", False, 0), bad]))
    t.write_frame(frame(spark, []))
    assert [bytes(r.key) for r in t.scan().collect()] == [b"k"] and t._store.runs() == [f["name"] for f in t.manifest()["files"]]


def test_mutations_are_durable_when_they_return(spark, root):
    t = Table.open(spark, root)
    t.put(b"a", b"1")
    t.put(b"b", b"2")
    t.delete(b"a")
    t.write(WriteBatch().put(b"c", b"3").put(b"c", b"4").delete(b"d"))
    del t  # never flushed, never closed
    u = Table.open(spark, root)
    assert u.files().count() == 0 and not u.has(b"a") and u.get(b"b") == b"2" and u.get(b"c") == b"4"
    assert [(r.frame, r.ord, bytes(r.key), r.deleted) for r in u.log_frames().collect()] == [(1, 0, b"a", False), (2, 0, b"b", False), (3, 0, b"a", True), (4, 0, b"c", False), (4, 1, b"c", False), (4, 2, b"d", True)]
    r = Table.open(spark, root, Options(read_only=True))
    assert r.get(b"b") == b"2"
    u.put(b"b", b"5")
    u.flush()
    assert u._store.logs() == [] and Table.open(spark, root).get(b"b") == b"5"


def test_what_a_run_holds_is_not_replayed(spark, root):
    t = Table.open(spark, root)
    t.put(b"a", b"1")
    name, = t._store.logs()
    data = t._store.read_log(name)
    t.flush()
    t.write_frame(frame(spark, [(b"a", b"2", False, 0)]))
    t._store.write_log(name, data)  # as if the writer had stopped before it deleted the segment
    u = Table.open(spark, root)
    assert u.get(b"a") == b"2" and u.stats().first().memtable_keys == 0
    u.vacuum()
    assert u._store.logs() == []


def test_torn_and_damaged_logs(spark, root):
    t = Table.open(spark, root)
    for k in (b"ok", b"also"):
        t.put(k, b"v")
    first, last = t._store.logs()
    whole = t._store.read_log(last)
    t._store.delete_log(last)
    t._store.write_log(last, whole + b"\x01\x02\x03\x04\x05")
    assert Table.open(spark, root).get(b"also") == b"v"
    t._store.delete_log(last)
    t._store.write_log(last, whole[:-1])
    u = Table.open(spark, root)
    assert u.get(b"ok") == b"v" and not u.has(b"also")
    data = t._store.read_log(first)
    t._store.delete_log(first)
    t._store.write_log(first, data[:-1])
    with pytest.raises(Damaged):
        Table.open(spark, root)


def test_frames_of_the_log():
    frames = [Frame(1, 7, [(b"k", b"", False)]), Frame(2, 8, [(b"k", None, True), (b"\xff", b"x" * 300, False)])]
    data = b"".join(map(encode, frames))
    assert list(decode(data)) == frames
    for cut in range(len(data)):
        assert list(decode(data[:cut])) == frames[: (cut >= len(encode(frames[0])))]
    body = b"\x00" * 3
    import struct, zlib  # noqa: E401

    with pytest.raises(Damaged):
        list(decode(struct.pack("<II", zlib.crc32(body), 3) + body))


def test_sync_policies(spark, tmp_path):
    seen = {}
    for policy in SyncPolicy:
        root = f"file://{tmp_path}/{policy.name}"
        t = Table.open(spark, root, Options(sync_policy=policy, sync_every_n=4))
        for k in range(10):
            t.put(b"k%d" % k, b"v")
        before = Table.open(spark, root).stats().first().memtable_keys
        t.sync()
        seen[policy.name] = before, Table.open(spark, root).stats().first().memtable_keys
    assert seen == {"FULL": (10, 10), "BATCH": (8, 10), "NONE": (0, 10)}


def test_log_segments_are_merged(spark, root, monkeypatch):
    from keystrata.sources import log

    monkeypatch.setattr(log, "MERGE_AT", 4)
    t = Table.open(spark, root)
    for k in range(10):
        t.put(b"k%d" % k, b"v")
    assert len(t._store.logs()) < 4 and Table.open(spark, root).stats().first().memtable_keys == 10


def test_cursor_past_its_first_page(spark, root):
    t = Table.open(spark, root)
    t.write_frame(frame(spark, [(b"%03d" % k, b"v", k % 5 == 0, k) for k in range(60)]))
    want = [b"%03d" % k for k in range(60) if k % 5]
    for page in (1, 7, 48, 49, 100):
        c = t.cursor(page)
        assert [k for k, _ in c] == want and not c.valid()
        c.seek(b"030")
        assert c.key() == b"031"


def test_metrics_of_a_compaction_without_reading_twice(spark, root):
    t = Table.open(spark, root)
    for n in range(3):
        t.write_frame(frame(spark, [(b"%03d" % k, b"v", (k + n) % 4 == 0, k) for k in range(40)]))
    out = t.compact()
    assert (out["kept_tombstones"], out["dropped_obsolete"]) == (10, 80) and out["output"]["entries"] == 40


def test_columns_with_clashing_names(spark):
    from keystrata.operators import resolve

    a = spark.createDataFrame([("k", 1, False, "x", 5)], "key string, seq long, deleted boolean, _src string, _rn int")
    assert resolve.merge([a, a]).columns == a.columns and resolve.merge([a, a]).first()["_src"] == "x"
    f = spark.createDataFrame([("a", 0, 7), ("b", 0, 8)], "name string, level int, _n int")
    assert [r["_n"] for r in compaction.plan_level0_frame(f, 2).orderBy("name").collect()] == [7, 8]
    assert compaction.plan_frame(f).count() == 2 and compaction.plan_frame(f.limit(1)).count() == 0
