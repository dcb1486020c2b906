import hashlib
from collections import defaultdict

import pytest

from keystrata.llm import mixing


def brute(rows, targets, budget, rounds):
    cells = defaultdict(float)
    key = {}
    for k, (d, text, lang, source) in enumerate(rows):
        words = (text or "").encode().lower().split()
        n = len(words)
        votes = [hashlib.md5(w).hexdigest()[0] for w in words if len(w) >= 6]
        topic = "t" + min(set(votes), key=lambda c: (-votes.count(c), c)) if votes else "none"
        key[k] = (source or mixing.UNKNOWN, lang or mixing.UNKNOWN, topic)
        cells[key[k]] += n
    total = sum(cells.values())
    p = dict.fromkeys(cells, budget)
    want = []
    for a, d in enumerate(mixing.DIMS):
        s = defaultdict(float)
        for c, t in cells.items():
            s[c[a]] += t / total
        t = targets[d]
        if isinstance(t, dict):
            rest = sum(v for k, v in s.items() if k not in t)
            want.append({k: t[k] if k in t else v * (1 - sum(t.values())) / rest for k, v in s.items()})
        else:
            norm = sum(v**t for v in s.values() if v)
            want.append({k: v**t / norm if v else 0 for k, v in s.items()})
    for _ in range(rounds):
        for a in range(3):
            now = defaultdict(float)
            for c, t in cells.items():
                now[c[a]] += t * p[c]
            p = {c: min(1, p[c] * want[a][c[a]] * total * budget / now[c[a]]) if now[c[a]] else p[c] for c in p}
    return key, p


ROWS = [(k, "word | bar " * 60 if k % 7 == 0 else "some plain words " * (k * 13 % 300), ["en", "de", None, "en", "en"][k % 5], f"s{k % 3}" if k % 11 else None) for k in range(120)]
ROWS += [(500, None, "en", "s0"), (None, "no id at all", "fr", "s1"), (3, ROWS[3][1], ROWS[3][2], ROWS[3][3])]


@pytest.mark.parametrize("targets", [mixing.TARGETS, {"source": 0.0, "lang": {"en": 0.5, "zz": 0.1}, "topic": 1.0}])
def test_probabilities_and_samples(spark, targets):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, lang string, source string, _mix_p string")
    key, p = brute(ROWS, targets, 0.7, 8)
    got = {(r.source, r.lang, r.topic): r.probability for r in mixing.probabilities(df, targets).collect()}
    assert got.keys() == p.keys()
    assert all(got[c] == pytest.approx(p[c], rel=1e-9, abs=1e-12) for c in p)

    def uniform(d, t):
        name = str(d) if d is not None else hashlib.md5((t or "").encode()).hexdigest()
        return int(hashlib.md5(f"{mixing.SEED}:{name}".encode()).hexdigest()[:8], 16) / 2**32

    want = sorted((str(d), uniform(d, t) < p[key[k]]) for k, (d, t, _, _) in enumerate(ROWS))
    assert sorted((str(r.doc_id), r.sampled) for r in mixing.decisions(df, targets).collect()) == want
    out = mixing.sampled(df, targets)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(d for d, s in want if s)


def test_margins_are_met(spark):
    rows = [(k, "w " * 200, "en" if k % 3 else "de", f"s{k % 2}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    p = mixing.probabilities(df, {"source": {"s0": 0.3, "s1": 0.7}, "lang": {"de": 0.4, "en": 0.6}, "topic": 1.0}, budget=0.3, rounds=10).collect()
    total = sum(r.tokens * r.probability for r in p)
    assert total == pytest.approx(0.3 * 400 * 200, rel=1e-6)
    assert sum(r.tokens * r.probability for r in p if r.lang == "de") / total == pytest.approx(0.4, rel=1e-6)
    assert sum(r.tokens * r.probability for r in p if r.source == "s0") / total == pytest.approx(0.3, rel=1e-6)


@pytest.mark.parametrize("targets", [mixing.TARGETS, {"source": 0.0, "lang": {"en": 0.5, "zz": 0.1}, "topic": 1.0}])
def test_distributed_raking_is_the_same(spark, targets):
    cells = mixing._summed(*mixing._described(spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string"), None))
    here = {tuple(r)[:5]: (r.probability, r.residual) for r in mixing._raked(cells, targets, 0.7, 3).collect()}
    there = {tuple(r)[:5]: (r.probability, r.residual) for r in mixing._raked(cells, targets, 0.7, 3, local_cells=0).collect()}
    assert here.keys() == there.keys() and all(there[k] == pytest.approx(here[k], rel=1e-9, abs=1e-12) for k in here)


def test_residuals(spark):
    rows = [(k, "harbour " * 200, "en" if k % 3 else "de", f"s{k % 2}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    met = mixing.probabilities(df, {"source": {"s0": 0.3, "s1": 0.7}, "lang": {"de": 0.4, "en": 0.6}, "topic": 1.0}, budget=0.3, rounds=10).collect()
    assert all(r.residual < 1e-6 for r in met)
    # nine tenths of all tokens cannot come from a third of them
    missed = mixing.probabilities(df, {"source": 1.0, "lang": {"de": 0.9, "en": 0.1}, "topic": 1.0}, budget=0.9, rounds=10).collect()
    assert all(r.residual > 0.5 for r in missed if r.lang == "de")


def test_topics(spark):
    sea = [(k, "The harbour and the lighthouse: harbour, harbour harbour " + "a of to " * k, "en", "s") for k in range(20)]
    law = [(100 + k, "Statute after statute, a statute and a statute " + "in by " * k, "en", "s") for k in range(20)]
    df = spark.createDataFrame([(*r, "own") for r in sea + law] + [(500, "a b c", "en", "s", None)], "doc_id long, text string, lang string, source string, mine string")
    got = {r.doc_id: r.topic for r in mixing.decisions(df).collect()}
    assert len({got[r[0]] for r in sea}) == 1 and len({got[r[0]] for r in law}) == 1 and got[500] == "none"
    assert {r.topic for r in mixing.decisions(df, topic="mine").collect()} == {"own", "none"}


def test_a_hot_source_and_very_long_texts(spark):
    rows = [(k, "some harbour words " * 40, "en", "hot" if k % 3 else f"s{k}") for k in range(300)] + [(900, "harbour " * 300_000, "en", "hot")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r for r in mixing.decisions(df).collect()}
    assert len(out) == 301 and out[900].n_words == 300_000


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mixing.decisions(df).count() == 0 and mixing.sampled(df).count() == 0
    blank = spark.createDataFrame([(1, None, None, None)], df.schema)
    assert [r.probability for r in mixing.decisions(blank).collect()] == [0.7]
