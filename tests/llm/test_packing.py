import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from keystrata.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.VOCABULARY)


TEXTS = [None, "", " ", "\n\n  \t x", "Hello, world! it's <|endoftext|> é漢字 🙂 12345", "a" * 3000, "word " * 5000, " " * 5000, "\x00\x0b\x1c", "don't we'll x y"]


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids(tokenizer, text):
    want = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
    assert packing.encode(text).tolist() == want


def test_added_tokens(tokenizer):
    text = "a <|endoftext|> b<|endoftext|><|endoftext|>\n <|endoftext| >x"
    assert packing.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [1]
    assert packing.encode(text).tolist().count(50256) == 3 and 50256 not in packing.encode(text, special=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|", "|>", " ", "\n", "a", "don't", "é", "漢", "  \t", "12", "word"]), max_size=25).map("".join))
def test_same_ids_of_any_text(tokenizer, text):
    assert packing.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [1]


def brute_best_fit(lengths, window):
    left, where = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fit = [b for b in range(len(left)) if left[b] >= lengths[i]]
        if fit:
            b = min(fit, key=lambda b: left[b])
        else:
            b = len(left)
            left.append(window)
        where[i] = window - left[b]
        left[b] -= lengths[i]
    return left


@pytest.mark.parametrize("n,window", [(0, 8), (1, 1), (50, 7), (400, 64), (300, 100)])
def test_best_fit(n, window):
    lengths = np.random.default_rng(n).integers(1, window + 1, n)
    bins, offsets = packing.best_fit_decreasing(lengths, window)
    used = defaultdict(list)
    for b, o, k in zip(bins, offsets, lengths):
        used[b].append((o, o + k))
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= window
    assert sorted(window - s[-1][1] for s in used.values()) == sorted(brute_best_fit(lengths.tolist(), window))


@pytest.mark.parametrize("shard_rows", [4, 50_000])
def test_pack(spark, tokenizer, shard_rows):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "y"), (None, "no id", None), (None, None, None)] + [(100 + k, "some words " * (k * 37 % 900), "z") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = packing.pack(df, shard_rows=shard_rows, with_ids=True).collect()
    ids = defaultdict(list)
    for d, t, _ in rows:
        ids[d].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    assert sum(r.length for r in out) == sum(len(x) for v in ids.values() for x in v)
    for r in out:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        assert any(x[r.start : r.start + r.length] == r.ids and len(x) == r.doc_tokens for x in ids[r.doc_id])
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.offset + r.length))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= packing.WINDOW
    for d, v in ids.items():
        assert sum(r.length for r in out if r.doc_id == d) == sum(map(len, v))
    assert packing.pack(spark.createDataFrame([], df.schema)).count() == 0
