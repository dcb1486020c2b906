"""Packing documents into fixed token windows: best-fit decreasing over a segment tree.

A document is its byte-level BPE ids and one closing id.  Whole windows are cut off the front first and
each is a sequence of its own; what is left (less than a window) is packed by best-fit decreasing: the
segment tree is indexed by remaining capacity and answers "tightest open window with room for n" in
log2(capacity) steps.

Remainders are dealt at random into shards of about ``shard_rows`` and each shard is packed alone: a shard
leaves about one partly filled window, so padding stays near none while no task grows with the input.
Only lengths travel; token ids don't leave the task that made them unless ``with_ids`` asks for them.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import written

#: Vocabulary files: the same merges for both libraries.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WINDOW = 2048
CLOSING_ID = 1


@lru_cache(maxsize=4)
def _encoders(vocabulary: str, ranks: str, special: bool):
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    slow = Tokenizer.from_file(vocabulary)
    slow.encode_special_tokens = not special
    added = {t.content: i for i, t in slow.get_added_tokens_decoder().items()} if special else {}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=added)
    return fast, slow, set(added)


def encode(text: str | None, vocabulary: str = VOCABULARY, ranks: str = RANKS, special: bool = True) -> np.ndarray:
    """The ids of ``vocabulary`` for one whole text, with the closing id; a null text is empty.

    ``ranks`` holds the same merges in the form of a faster library, which gives the same ids; a text that
    it refuses (a run of white space deeper than its stack) goes to the slower one.  The string of an added token
    (``<|endoftext|>``) is that token, as the named tokenizer has it, or ordinary text without ``special``.
    """
    if not text:
        return np.array([CLOSING_ID], "<u4")
    fast, slow, added = _encoders(vocabulary, ranks, special)
    try:
        ids = fast.encode_to_numpy(text, allowed_special=added, disallowed_special=())
    except BaseException as e:  # the library's panics don't derive from Exception
        if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
        ids = slow.encode(text, add_special_tokens=False).ids
    return np.append(np.asarray(ids, "<u4"), np.uint32(CLOSING_ID)).astype("<u4", copy=False)


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(window: int, with_ids: bool, vocabulary: str, ranks: str, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows: list[tuple] = []
                kept: list[np.ndarray] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    ids = encode(text.as_py(), vocabulary, ranks, special)
                    for start in range(0, len(ids), window):
                        cut = ids[start : start + window]
                        rows.append((doc, start, len(cut), zlib.crc32(cut.tobytes()), len(ids)))
                        if with_ids:
                            kept.append(cut)
                cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    cols, names = cols + [pa.array(kept, pa.list_(pa.int64()))], names + ["ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def pieces(docs: DataFrame, window: int = WINDOW, with_ids: bool = False, vocabulary: str = VOCABULARY, ranks: str = RANKS, special: bool = True) -> DataFrame:
    """Each document cut at multiples of ``window``: ``doc_id, start, length, ids_crc32, doc_tokens[, ids]``."""
    of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return of.mapInArrow(_pieces(window, with_ids, vocabulary, ranks, special), PIECE + ", ids array<long>" * with_ids)


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset for each length (1 to ``window``); equal lengths are taken in the order given."""
    size = 1 << window.bit_length()
    tree = [-1] * (2 * size)  # of each range of capacities the smallest that some open window has left
    open_at: list[list[int]] = [[] for _ in range(window + 1)]
    left: list[int] = []
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def mark(capacity: int, there: bool) -> None:
        k = capacity + size
        tree[k] = capacity if there else -1
        k >>= 1
        while k:
            low = tree[2 * k]
            tree[k] = low if low >= 0 else tree[2 * k + 1]
            k >>= 1

    def tightest(need: int) -> int:
        k = need + size
        if tree[k] >= 0:
            return need
        while k > 1:
            if not k & 1 and tree[k + 1] >= 0:
                return tree[k + 1]
            k >>= 1
        return -1

    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        c = tightest(n)
        if c < 0:
            b, c = len(left), window
            left.append(window)
        else:
            b = open_at[c].pop()
            if not open_at[c]:
                mark(c, False)
        bins[i], offsets[i] = b, window - c
        left[b] = rest = c - n
        if rest:
            open_at[rest].append(b)
            if len(open_at[rest]) == 1:
                mark(rest, True)
    return bins, offsets


def _pack_shard(window: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        bins, offsets = best_fit_decreasing(rows["length"].to_numpy(), window)
        rows["sequence_id"] = 2 * (rows["shard"].to_numpy() + bins * SHARDS)
        rows["offset"] = offsets
        return rows.drop(columns="shard")

    return run


#: Sequence ids interleave shards: below this many shards no two of them collide.
SHARDS = 1 << 24


def pack(docs: DataFrame, window: int = WINDOW, shard_rows: int = 50_000, with_ids: bool = False, vocabulary: str = VOCABULARY, ranks: str = RANKS, special: bool = True) -> DataFrame:
    """The pieces of all documents with their places: ``sequence_id, offset``.

    Null or empty texts are the closing id alone; null ids and repeated rows are packed like any other row.  A very
    long text is cut into as many windows as it fills, one text at a time in memory; an empty table gives no rows.
    Extra columns are ignored.  ``sequence_id`` is unique per sequence, not dense.
    """
    if window < 1:
        raise ValueError("window must be positive")
    cut = written(pieces(docs, window, with_ids, vocabulary, ranks, special), "pieces")
    full = cut.filter(F.col("length") == window)
    rest = cut.filter(F.col("length") < window)
    spread = F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id())
    n = rest.count()
    if with_ids:  # a row then weighs some kilobytes
        shard_rows = max(1, shard_rows // 8)
    shards = max(1, min(SHARDS, -(-n // shard_rows)))
    schema = PIECE + ", ids array<long>" * with_ids + ", sequence_id long, offset long"
    packed = rest.withColumn("shard", F.pmod(spread, F.lit(shards))).groupBy("shard").applyInPandas(_pack_shard(window), schema)
    # whole windows need no place: their ids are odd, made of partition and row as they were written
    alone = full.withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone)
