from collections import Counter

import numpy as np
import pytest

from keystrata.llm import substrings


def brute(texts):
    words = [(t or "").encode().split() for t in texts]
    n = substrings.WINDOW
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def passages(seed=1, docs=120):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["é", "ß", "漢", "#"]
    some = lambda n: [vocabulary[k] for k in rng.integers(0, len(vocabulary), n)]
    shared = [some(n) for n in (34, 35, 36, 60, 200)]
    out = []
    for k in range(docs):
        w = some(int(rng.integers(0, 150)))
        for _ in range(int(rng.integers(0, 3))):
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = shared[int(rng.integers(0, len(shared)))]
        out.append(" ".join(w))
    out += [out[3], out[3], out[5] + " tail", None, "", " \t ", "a " * 34, "a " * 35, "b " * 36, "b " * 200, "x y " * 60, " ".join(f"u{k}" for k in range(3000)), "c\x0bd\x1ce " * 40]
    return out


def test_run_hashes_are_of_content():
    x = np.array([5, 6, 7, 8, 5, 6, 7, 9, 5, 6, 7], np.uint64)
    h = substrings._run_hashes(x, 3)
    assert h[0] == h[4] == h[8] and len(set(h.tolist())) == 7
    assert substrings._least(np.array([5, 3, 4, 1, 9, 9, 9]), 3).tolist() == [3, 1, 1, 1, 9]


def test_clashing_hashes(monkeypatch):
    """Should two windows have one hash, words decide."""
    texts = [t.encode() for t in passages(2, 40) if t and len(t.split()) >= substrings.WINDOW]
    monkeypatch.setattr(substrings, "_run_hashes", lambda x, w: np.zeros(max(0, len(x) - w + 1), np.uint64))
    got = substrings._repeated([b" ".join(t.split()) for t in texts], np.zeros(len(texts), bool))
    n = substrings.WINDOW
    seen = Counter(tuple(t.split()[i : i + n]) for t in texts for i in range(len(t.split()) - n + 1))
    assert [g.tolist() for g in got] == [[seen[tuple(t.split()[i : i + n])] > 1 for i in range(len(t.split()) - n + 1)] for t in texts]


@pytest.mark.parametrize("bucket_bytes,pack_bytes,share", [(1 << 24, 1 << 24, 0.005), (2000, 900, 0.0001)])
def test_against_brute_force(spark, monkeypatch, bucket_bytes, pack_bytes, share):
    monkeypatch.setattr(substrings, "COMMON_SHARE", share)
    texts = passages()
    df = spark.createDataFrame([(k if k % 17 else None, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(5)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substrings.deduplicated(df, bucket_bytes, pack_bytes).collect())
    assert got == Counter((k if k % 17 else None, *b) for k, b in enumerate(brute(texts)))


def test_common_runs_do_not_change_the_result():
    words = [w.encode() for w in " ".join(t or "" for t in passages()).split()]
    common = np.sort(substrings._mer_hashes(words, np.zeros(0, np.uint64))[::3])
    for c in (np.zeros(0, np.uint64), common):
        m, first, windows, _ = substrings.super_kmers(words, c)
        assert first[0] == 0 and (first[1:] == (first + windows)[:-1]).all() and (first + windows)[-1] == len(words) - substrings.WINDOW + 1


def test_empty(spark):
    assert substrings.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def hot_texts(n=400):
    """Every text holds one run of words whose hash is least, amid words of its own; some windows repeat."""
    rng = np.random.default_rng(4)
    runs = [[f"r{k}a", f"r{k}b", f"r{k}c", f"r{k}d"] for k in range(30_000)]
    hashes = [int(substrings._mer_hashes([w.encode() for w in r], np.zeros(0, np.uint64))[0]) for r in runs]
    run = runs[int(np.argmin(np.array(hashes, np.uint64)))]
    own = lambda k: [f"v{x}" for x in rng.integers(0, 10**6, k)]
    texts = [" ".join(own(40) + run + own(40)) for _ in range(n)]
    texts[7] = " ".join(own(5)) + " " + texts[3]
    return texts + [texts[11]]


def test_a_minimiser_in_every_text_is_split(monkeypatch):
    import pyarrow as pa

    held = []
    spans = substrings._spans
    monkeypatch.setattr(substrings, "_spans", lambda head, source, text: held.append(sum(map(len, text))) or spans(head, source, text))
    texts = hot_texts()
    bucket_bytes, hold, pack_bytes = 4000, 12_000, 4000

    def dealt(batches):
        rows = sorted((b, x) for batch in batches for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        return iter([pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "blob"])])

    source = pa.RecordBatch.from_arrays([pa.array([t.encode() for t in texts], pa.binary())], names=["text"])
    blobs = substrings._pack(50, np.zeros(0, np.uint64), pack_bytes)(iter([source]))
    found, levels = [], 0
    for mer in (*substrings.FINER, None):
        out = list(substrings._count(None if mer is None else hold)(dealt(blobs)))
        found += [tuple(r.values())[:3] for b in out for r in b.to_pylist() if r["blob"] is None]
        hot = [r["blob"] for b in out for r in b.to_pylist() if r["blob"] is not None]
        if not hot:
            break
        levels += 1
        size = sum(r["raw"] for b in out for r in b.to_pylist() if r["raw"])
        blobs = substrings._cut_again(2 * size // bucket_bytes + 1, mer, pack_bytes)(iter([pa.RecordBatch.from_arrays([pa.array(hot, pa.binary())], names=["blob"])]))
    assert levels and max(held) <= hold and sum(map(len, map(str.encode, texts))) > 10 * hold
    want = {substrings._digest(t.encode()) for t, b in zip(texts, brute(texts)) if b[1]}
    assert {d for d, _, _ in found} == want and len(want) == 3


def test_hot_texts_in_a_frame(spark):
    texts = hot_texts(150)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = sorted(tuple(r) for r in substrings.deduplicated(df, 4000, 4000).collect())
    assert got == [(k, *b) for k, b in enumerate(brute(texts))]
