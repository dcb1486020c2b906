import numpy as np
import pytest

from keystrata.llm import topk


def brute(rows, k, every=1):
    out = []
    for qi, q in rows:
        if qi % every == 0:
            s = sorted(((-sum(a * b for a, b in zip(q, x)), i) for i, x in rows if i != qi and len(x) == len(q)))[:k]
            out += [(qi, r + 1, i, -v) for r, (v, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("n,d,spread,k", [(1, 3, 5, 5), (2, 1, 2, 5), (500, 2, 3, 5), (700, 8, 1000, 3), (400, 4, 0, 4), (300, 16, 2**40, 5)])
def test_search(n, d, spread, k):
    rng = np.random.default_rng(n)
    x = rng.integers(-spread, spread + 1, (n, d))
    x[: n // 3] = x[0]
    ids = rng.permutation(n) * 7
    t = topk.build(x.astype(float), leaf=8)
    assert sorted(t.order.tolist()) == list(range(n))
    got = topk.search(t, x, ids, x, ids, np.full(n, -np.inf), k)
    want = brute([(int(i), [int(c) for c in v]) for i, v in zip(ids, x)], k)
    if spread < 2**30:
        assert sorted((a, b, c) for a, b, c in got) == sorted((q, i, s) for q, _, i, s in want)
    else:
        clip = lambda s: max(topk.LONG_MIN, min(topk.LONG_MAX, s))
        assert sorted(c for _, _, c in got) == sorted(clip(s) for _, _, _, s in want)


@pytest.mark.parametrize("shard_rows", [30, 1000])
def test_frame(spark, shard_rows):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(c) for c in v], int(i) % 3) for i, v in enumerate(rng.normal(size=(300, 6)))]
    rows += [(i, rows[0][1], 0) for i in range(300, 380)]
    odd = [(400, None, 1), (450, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (500, [float("nan")] * 6, 1), (550, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (600, [1.0, 2.0], 1), (601, [2.0, 2.0], 1), (650, [], 2)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in topk.neighbours(df, shard_rows=shard_rows).collect())
    ints = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v, _ in rows] + [(600, [256, 512]), (601, [512, 512]), (650, [])]
    assert got == brute(ints, 5, 50)


def test_empty_and_repeats(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.neighbours(df).count() == 0
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [1.0]), (1, [1.0])], df.schema)
    assert sorted(tuple(r) for r in topk.neighbours(df).collect()) == [(0, 1, 1, 65536), (0, 2, 1, 65536)]


def test_repeated_ids_in_sql_and_code(spark, tmp_path):
    import duckdb

    rows = [(0, [1.0, 2.0]), (0, [3.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (50, [2.0, 2.0]), (50, [2.0, 2.0]), (None, [9.0, 9.0]), (2, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/e.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e.parquet/*.parquet'")
    want = sorted(c.execute(topk.ORACLE_SQL).fetchall())
    got = topk.neighbours(spark.read.parquet(f"{tmp_path}/e.parquet"))
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == want and len(want) == 8


def test_queries_travel_only_where_they_can_score(spark):
    """Far apart clusters: after its own cell a query reaches few others; blocks of queries and sub-shards change nothing."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 6)) * 50
    rows = [(i, [float(c) for c in centres[i % 8] + rng.normal(size=6)]) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = topk.quantised(df)
    ints = [(r.vec_id, list(r.v)) for r in q.collect()]
    want = brute(ints, 5, 10)
    for shard_rows, query_rows in ((200, 10_000), (60, 3)):
        got = topk.top_k(q, q.filter("vec_id % 10 = 0"), shard_rows=shard_rows, query_rows=query_rows).collect()
        assert sorted(tuple(r) for r in got) == want
    balls = [topk._balls(__import__("pandas").DataFrame({"v": [np.array(v, "<i8").tobytes() for i, v in ints if i % 8 == c], "shard": c, "dim": 6})) for c in range(8)]
    import pandas as pd
    import pyarrow as pa

    kth = {i: min(s for qi, _, _, s in want if qi == i) for i, _ in ints if i % 10 == 0}
    rows = [(i, 6, np.array(v, "<i8").tobytes(), float(kth[i]), i % 8) for i, v in ints if i % 10 == 0]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["vec_id", "dim", "v", "kth", "home"])
    pairs = sum(b.num_rows for b in topk._reached(list(pd.concat(balls).itertuples()))(iter([batch])))
    assert pairs < 2 * len(rows)  # of seven other shards each
