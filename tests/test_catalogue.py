"""Every query against its SQL counterpart, and the plans behind the main ones."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from keystrata.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = c.execute(ORACLES[name])
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    want = Counter(tuple(plain(r[cols.index(k)]) for k in order) for r in cur.fetchall())
    assert Counter(tuple(plain(r[k]) for k in order) for r in rows) == want


def test_tombstones_hide_only_after_resolution(spark):
    from keystrata.operators import resolve
    from keystrata.plans.catalogue import version_log

    log = version_log(spark, "/root/testdata/sf0.01")
    right = resolve.visible(log, key="k", deleted="d").count()
    wrong = resolve.resolve(log.filter("NOT d"), key="k").count()
    assert right != wrong


def test_lookups_by_the_keys_of_all_customers(spark):
    d = "/root/testdata/sf0.01"
    got = {r.k for r in QUERIES["q_multi_get_all"](spark, d).collect()}
    live = {r.k for r in QUERIES["q_live"](spark, d).collect()}
    customers = {r[0] for r in spark.read.parquet(f"{d}/customer.parquet").select("c_custkey").collect()}
    assert got == {k for k in live if k.endswith("/view") and int(k[1:].split("/")[0]) in customers}
    assert max(got) > "u000041" and len(got) > 41


def test_lookups_by_skewed_keys(spark):
    from keystrata.operators import scan

    log = spark.createDataFrame([("a", s, False) for s in range(500)] + [("b", 1, False), ("c", 1, False), ("c", 2, True)], "k string, seq long, d boolean")
    keys = spark.createDataFrame([("a",)] * 2000 + [("b",), ("c",), ("x",), (None,)], "k string")
    got = scan.multi_get(log, keys, "k", seq="seq", deleted="d").select("k", "seq").collect()
    assert sorted(map(tuple, got)) == [("a", 499), ("b", 1)]


def test_bloom_merge_takes_every_language(spark, tmp_path):
    langs = ["en", "de", "nl", None, "", None, "ja"]
    rows = [(k, lang) for k, lang in enumerate(langs)] + [(None, "en")]
    for part in (rows, []):
        spark.createDataFrame(part, "doc_id long, lang string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        got = QUERIES["q_bloom_merge"](spark, str(tmp_path)).collect()
        assert [r.n_added for r in got] == ([7] if part else [0])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    from keystrata.operators import scan

    got = plan_of(QUERIES["q_live"](spark, SF))
    assert got.count("Exchange hashpartitioning") == 1 and got.count("WindowGroupLimit") == 2
    log = spark.read.parquet(f"{SF}/pages.parquet").selectExpr("url AS key", "page_id AS seq", "false AS deleted")
    assert "GreaterThanOrEqual(url,https" in plan_of(scan.seek(log, "https://c", 5)) and "TakeOrderedAndProject" in plan_of(scan.seek(log, "https://c", 5))
    assert "EqualTo(url,x)" in plan_of(scan.get(log, "x"))
    assert "StringStartsWith(url,https" in plan_of(scan.prefix_scan(log, "https://m."))
    assert "ReadSchema: struct<user_id:bigint,event_type:string" not in plan_of(QUERIES["q_url_seek"](spark, SF))
