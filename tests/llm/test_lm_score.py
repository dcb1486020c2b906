import math
from collections import Counter

import numpy as np
import pytest

from keystrata.llm import lm_score


def brute(texts):
    words = [(t or "").encode().split() for t in texts]
    one = Counter(w for d in words for w in d)
    two = Counter(p for d in words for p in zip(d, d[1:]))
    n = sum(one.values())
    out = []
    for d in words:
        o1, o2 = Counter(d), Counter(zip(d, d[1:]))
        s = 0.0
        for k, w in enumerate(d):
            p = max(one[w] - o1[w], lm_score.UNSEEN) / n
            if k:
                v = d[k - 1]
                both, before = two[v, w] - o2[v, w], one[v] - o1[v]
                p = both / before if both > 0 and before > 0 else lm_score.BACKOFF * p
            s += math.log(p)
        out.append((len(d), s))
    return out


@pytest.mark.parametrize("pack", [1 << 24, 300])
def test_against_brute_force(spark, pack):
    rng = np.random.default_rng(2)
    v = ["the", "of", "cat", "é", "A", "a"] + [f"w{k}" for k in range(60)]
    texts = [" ".join(v[int(abs(k)) % len(v)] for k in rng.normal(0, 12, int(rng.integers(0, 80)))) for _ in range(80)]
    texts += [texts[4], texts[4], None, "", " \n", "only once", "the", "x\x0by\x1cz", "the of " * 400]
    df = spark.createDataFrame([(k if k % 9 else None, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, digest string").repartition(3)
    got = sorted((str(r.doc_id), r.n_words, round(r.log_score, 6), r.mean_log_score is None) for r in lm_score.scored(df, pack).collect())
    assert got == sorted((str(k if k % 9 else None), n, round(s, 6), n == 0) for k, (n, s) in enumerate(brute(texts)))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.scored(df).count() == 0
    df = spark.createDataFrame([(1, None), (2, "one word")], df.schema)
    assert {r.doc_id: r.n_words for r in lm_score.scored(df).collect()} == {1: 0, 2: 2}


def test_planes_round_trip():
    for x in (np.zeros(0, np.int64), np.arange(-5, 300, dtype=np.int64)):
        assert lm_score._opened(lm_score._squeezed(x), "<i8").tolist() == x.tolist()
