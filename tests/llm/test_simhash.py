from collections import Counter

import numpy as np
import pytest
import xxhash

from keystrata.llm import simhash
from keystrata.llm.common import connected_components


def brute_fp(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, d=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= d:
                root[find(i)] = find(j)
    low = {}
    for k, i in enumerate(ids):
        if i is not None:
            r = find(k)
            low[r] = min(low.get(r, i), i)
    return [low.get(find(k)) for k in range(len(ids))]


def test_fingerprint():
    for t in [None, "", "  \n", "a", "A b", "a b c d", "The cat \x0b sat on the mat and sat on the mat", "é x y z ü " * 50]:
        assert simhash.fingerprint(None if t is None else t.encode()) == brute_fp(t)


def test_gray_rank():
    g = np.arange(1 << 12, dtype=np.uint64)
    assert (simhash.gray_rank(g ^ (g >> np.uint64(1))) == g).all()


@pytest.mark.parametrize("n,bits,d", [(1, 64, 4), (2, 64, 4), (300, 12, 1), (700, 40, 4), (3000, 20, 3), (900, 64, 4), (9, 64, 0)])
def test_index_against_brute_force(n, bits, d):
    rng = np.random.default_rng(n)
    centre = rng.integers(0, 1 << bits, max(1, n // 30), dtype=np.uint64, endpoint=False) if bits < 64 else rng.integers(0, 2**63, max(1, n // 30), dtype=np.uint64)
    v = centre[rng.integers(0, len(centre), n)]
    for _ in range(6):
        v = v ^ np.where(rng.random(n) < 0.5, np.uint64(1) << rng.integers(0, bits, n).astype(np.uint64), np.uint64(0))
    b = np.sort(rng.integers(0, 3, n))
    order = np.lexsort((simhash.gray_rank(v), b))
    v = v[order]
    label = simhash.index_links(b, v, d)
    near = (np.bitwise_count(v[:, None] ^ v[None]) <= d) & (b[:, None] == b[None])
    want = np.arange(n)
    while True:
        new = np.where(near, want[None], n).min(axis=1)
        if (new == want).all():
            break
        want = new
    assert (label == want).all()


def test_components(spark):
    rng = np.random.default_rng(1)
    e = [(int(a), int(b)) for a, b in rng.integers(-300, 300, (350, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(e, "u long, v long")).collect()}
    root = {}
    for a, b in e:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(700):
        done = True
        for a, b in e:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                done = False
        if done:
            break
    linked = {x for a, b in e if a != b for x in (a, b)}
    assert got == {k: v for k, v in root.items() if k in linked and k != v}


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 500, 120)) for _ in range(30)]
    docs = []
    for k, t in enumerate(base):
        docs.append((k, t))
        for c in range(k % 4):
            w = t.split()
            for p in rng.integers(0, 120, c):
                w[p] = "edit"
            docs.append((100 + 10 * k + c, " ".join(w)))
    docs += [(900, None), (901, ""), (902, " \n"), (None, base[0]), (None, "quite alone here"), (0, base[0]), (903, "A"), (904, "a")]
    df = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, fp long")
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    fps = [brute_fp(t) for _, t in docs]
    comp = brute_components([i for i, _ in docs], fps)
    assert got == Counter((i, f"{f:016x}", c) for (i, _), f, c in zip(docs, fps, comp))


@pytest.mark.parametrize("rows", [3, 40, 100_000])
def test_hot_buckets_lose_no_link(spark, rows):
    rng = np.random.default_rng(7)
    centre = int(rng.integers(0, 2**62))
    fps = sorted({centre ^ sum(1 << int(b) for b in rng.integers(0, 62, rng.integers(0, 9))) for _ in range(400)})
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    cc = {r.node: r.root for r in connected_components(simhash.links(nodes, bucket_rows=rows)).collect()}
    got = [cc.get(f, f) for f in fps]
    assert got == brute_components(fps, fps)


def test_empty_and_deduplicated(spark):
    schema = "doc_id long, text string, lang string, _nth string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(3, "a b c d e f", "x", "1"), (2, "a b c d e f", "y", "2"), (2, "a b c d e f", "y", "2"), (9, "other words stand here now", None, None)], schema)
    out = simhash.deduplicated(df)
    assert sorted(r.doc_id for r in out.collect()) == [2, 9]
    assert simhash.deduplicated(spark.createDataFrame([], schema)).count() == 0


def test_deduplicated_by_component(spark):
    a, b, c = ("the %s of a distant shore was seen by no one else on that day" % w for w in ("first light of lamps", "grey stones and old nets", "captain who lost his way"))
    rows = [(1, a), (2, a), (2, b), (2, b), (None, c), *[(None, c)] * 50, (None, b), (3, b)]
    assert len({brute_fp(t) for t in (a, b, c)}) == 3
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame([(i, t, "x") for i, t in some], "doc_id long, text string, _key string")
        out = simhash.deduplicated(df)
        assert out.columns == df.columns
        # a stays under 1; the other text of id 2 stays although its namesake went; c's copies are one row
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, a), (2, b), (None, b), (None, c)], key=str)
