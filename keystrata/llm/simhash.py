"""SimHash near-duplicates through a Gray-order hierarchical index.

A document's fingerprint is the bitwise majority of the XXH64 values of its word shingles.  Fingerprints
that differ in at most ``max_diff`` bits link; components are the transitive closure.

1. Fingerprints are made from whole texts in Arrow batches, then reduced to distinct values, so exact
   copies meet in one row whatever their number.
2. Routing: the 64 bits are cut into ``max_diff + 1`` groups; two linked fingerprints agree on one group
   at least, so each value travels to one bucket per group.  A bucket over ``bucket_rows`` is cut again in
   the same way over the bits that are still free, which loses no link (and copies its values once a group),
   until it is small enough or has ``LEAST_FREE`` free bits, of which there are 65,536 values at most.
3. In a bucket the index: values sorted by Gray rank, runs of ``FANOUT`` neighbours factored into parent
   nodes that keep the bits all of them share.  The self-join walks pairs of nodes from the root and drops
   a pair of groups once their shared bits differ too often; a pair whose bits cannot differ too often
   any more is linked as a whole.  Only a spanning forest leaves the bucket, never all pairs.
4. Components by star rounds over these links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, fresh, written

FANOUT = 8
#: Pairs of nodes looked at in one go; bounds memory.
FRONTIER = 1 << 18


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """The fingerprint of one text, unsigned; 0 where it has no words."""
    if not text:
        return 0
    w = text.lower().split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return digest(b" ".join(w), 42)
    joined = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w)) + 1
    end = np.cumsum(size)
    start = (end - size)[: len(w) - words + 1].tolist()
    stop = (end[words - 1 :] - 1).tolist()
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(start, stop)), np.uint64, len(start))
    bits = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 14):
        part = h[k : k + (1 << 14)]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(bits * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], names=["doc_id", "fp", *b.schema.names[2:]])

    return run


def _row_key() -> Column:
    """Tells documents apart by id and whole text; never null."""
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.coalesce(F.concat(F.lit(":"), F.col("text").cast("string")), F.lit(""))), 256))


def fingerprints(docs: DataFrame, words: int = 4, keyed: bool = False) -> DataFrame:
    """``doc_id, fp[, key]`` (signed long) for each row; a null text is empty."""
    key = [_row_key().alias("key")] * keyed
    of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *key)
    return of.mapInArrow(_fingerprints(words), "doc_id long, fp long" + ", key binary" * keyed)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each value in the reflected Gray sequence."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        la, lb = label[a], label[b]
        k = la != lb
        if not k.any():
            return
        a, b = a[k], b[k]
        np.minimum.at(label, np.maximum(la[k], lb[k]), np.minimum(la[k], lb[k]))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _levels(bucket: np.ndarray, value: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """From leaves to root: shared bits, their mask, first and last bucket of each node."""
    levels = [(value, np.full(len(value), ~np.uint64(0)), bucket, bucket)]
    while len(levels[-1][0]) > 1:
        pat, mask, lo, hi = levels[-1]
        at = np.arange(0, len(pat), FANOUT)
        ones, zeros = np.bitwise_and.reduceat(pat, at), ~np.bitwise_or.reduceat(pat, at)
        shared = (ones | zeros) & np.bitwise_and.reduceat(mask, at)
        levels.append((ones & shared, shared, lo[at], hi[np.minimum(at + FANOUT - 1, len(hi) - 1)]))
    return levels


def index_links(bucket: np.ndarray, value: np.ndarray, max_diff: int = 4) -> np.ndarray:
    """Labels: rows of one bucket whose values are linked, directly or not, get one label (the first row's position).

    ``bucket`` ascends; within a bucket ``value`` is sorted by Gray rank.
    """
    label = np.arange(len(value))
    if len(value) < 2:
        return label
    levels = _levels(bucket, value)
    uniform: dict[int, np.ndarray] = {}

    def settled(level: int) -> np.ndarray:
        """Per node the label that all its rows share, else -1."""
        at = np.arange(0, len(value), FANOUT**level)
        low, high = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
        return np.where(low == high, low, -1)

    step = np.arange(FANOUT)
    square = np.repeat(step, FANOUT), np.tile(step, FANOUT)
    half = tuple(x[square[0] <= square[1]] for x in square)
    zero = np.zeros(1, np.int64)
    todo = [(len(levels) - 1, zero, zero)]
    changed = True
    while todo:
        level, i, j = todo.pop()
        if len(i) > FRONTIER:
            todo += [(level, i[FRONTIER:], j[FRONTIER:]), (level, i[:FRONTIER], j[:FRONTIER])]
            continue
        pat, mask, lo, hi = levels[level]
        both = mask[i] & mask[j]
        differ = np.bitwise_count((pat[i] ^ pat[j]) & both).astype(np.int64)
        keep = (differ <= max_diff) & (lo[j] <= hi[i])
        i, j, both, differ = i[keep], j[keep], both[keep], differ[keep]
        if level == 0:
            k = i < j
            before = label.copy()
            _union(label, i[k], j[k])
            changed |= not np.array_equal(before, label)
            continue
        if level == 1 and len(i) > FANOUT * FANOUT:
            if changed:
                uniform, changed = {1: settled(1)}, False
            k = (uniform[1][i] < 0) | (uniform[1][i] != uniform[1][j])
            i, j, both, differ = i[k], j[k], both[k], differ[k]
        whole = (lo[i] == hi[i]) & (lo[j] == hi[j]) & (lo[i] == lo[j]) & (np.bitwise_count(~both) + differ <= max_diff)
        if whole.any():
            width = FANOUT**level
            first = np.repeat(i[whole] * width, 2 * width)
            rest = np.concatenate([i[whole, None] * width + np.arange(width), j[whole, None] * width + np.arange(width)], axis=1).ravel()
            k = rest < len(value)
            _union(label, first[k], rest[k])
            changed = True
            i, j = i[~whole], j[~whole]
        n, same = len(levels[level - 1][0]), i == j
        a = np.concatenate([(i[~same, None] * FANOUT + square[0]).ravel(), (i[same, None] * FANOUT + half[0]).ravel()])
        b = np.concatenate([(j[~same, None] * FANOUT + square[1]).ravel(), (j[same, None] * FANOUT + half[1]).ravel()])
        k = (a < n) & (b < n)
        if k.any():
            todo.append((level - 1, a[k], b[k]))
    return label


def _bucket_links(max_diff: int, rows_at_once: int = 100_000):
    def links(free: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(fp), bool)
        new[1:] = (free[1:] != free[:-1]) | (key[1:] != key[:-1])
        bucket, value = np.cumsum(new), fp.view(np.uint64)
        order = np.lexsort((gray_rank(value), bucket))
        value = value[order]
        label = index_links(bucket, value, max_diff)
        k = label != np.arange(len(label))
        return pa.RecordBatch.from_arrays([pa.array(value[k].view(np.int64)), pa.array(value[label[k]].view(np.int64))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            if b.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            if sum(len(x[0]) for x in held) >= rows_at_once:
                free, key, fp = (np.concatenate(x) for x in zip(*held))
                cut = len(fp) - 1
                while cut and free[cut - 1] == free[-1] and key[cut - 1] == key[-1]:
                    cut -= 1
                if cut:
                    yield links(free[:cut], key[:cut], fp[:cut])
                held = [[free[cut:], key[cut:], fp[cut:]]]
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held)))

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _children(free: int, groups: int) -> list[int]:
    """The masks of free bits that are left when one of ``groups`` even parts of the free bits is fixed."""
    bits = [k for k in range(64) if free >> k & 1]
    parts = [bits[g * len(bits) // groups : (g + 1) * len(bits) // groups] for g in range(groups)]
    return [free & ~sum(1 << k for k in p) for p in parts]


#: Free bits at which a bucket isn't cut again.
LEAST_FREE = 16


def _recut(groups: int):
    """Values of hot buckets to the buckets of their free bits' groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[int, np.ndarray] = {}
        for b in batches:
            fp, free = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for f in np.unique(free).tolist():
                if f not in memo:
                    memo[f] = np.array([_signed(m) for m in _children(f & (1 << 64) - 1, groups)], np.int64)
                mine, below = fp[free == f], memo[f]
                value, mask = np.repeat(mine, len(below)), np.tile(below, len(mine))
                yield pa.RecordBatch.from_arrays([pa.array(mask), pa.array(value & ~mask), pa.array(value)], names=["free", "key", "fp"])

    return run


def links(nodes: DataFrame, max_diff: int = 4, bucket_rows: int = 100_000) -> DataFrame:
    """``u, v``: links that connect all distinct values ``fp`` of ``nodes`` within ``max_diff`` bits of each other."""

    below = F.array(*(F.lit(_signed(m)) for m in _children((1 << 64) - 1, max_diff + 1)))
    rows = nodes.select("fp", F.explode(below).alias("free")).select("free", F.col("fp").bitwiseAND(F.bitwise_not("free")).alias("key"), "fp")
    while True:
        hot = rows.groupBy("free", "key").count().filter((F.col("count") > bucket_rows) & (F.bit_count("free") > LEAST_FREE))
        hot = written(hot.select(F.col("free").alias("f"), F.col("key").alias("k")), "hot")
        if hot.isEmpty():
            break
        on = (rows["free"] == hot["f"]) & (rows["key"] == hot["k"])
        cut = rows.join(hot, on, "left_semi").select("fp", "free").mapInArrow(_recut(max_diff + 1), "free long, key long, fp long")
        rows = written(rows.join(hot, on, "left_anti").unionByName(cut), "buckets")
    return rows.repartition("free", "key").sortWithinPartitions("free", "key").mapInArrow(_bucket_links(max_diff), "u long, v long")


def _roots(rows: DataFrame, max_diff: int) -> DataFrame:
    """``fp, low, root``: the smallest id of each distinct fingerprint and its component."""
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    root = connected_components(links(nodes.select("fp"), max_diff))
    return written(nodes.join(root, nodes["fp"] == root["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "named")


def near_duplicates(docs: DataFrame, words: int = 4, max_diff: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``.

    Null and blank texts have fingerprint zero and link like any other.  Repeated rows each return a row; very long
    texts are read whole, one at a time; an empty table gives no rows.
    ``component_id`` is the smallest ``doc_id`` of the component; a null ``doc_id`` never is one, so a
    component of null ids alone has a null.  Extra columns are ignored.
    """
    rows = written(fingerprints(docs, words), "fingerprints")
    named = _roots(rows, max_diff)
    # written too, so that the join can split a component that holds very many fingerprints
    low = written(named.groupBy("root").agg(F.min("low").alias("component_id")), "components")
    of = named.select("fp", "root").join(low, "root").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(of, rows["fp"] == of["_fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, words: int = 4, max_diff: int = 4) -> DataFrame:
    """The rows of ``docs`` less all but one of each near-duplicate component (the smallest ``doc_id`` stays).

    Where rows of a component share that id, the least by fingerprint and digest of the text stays, so a
    ``doc_id`` stays once for each component it is the smallest of.  Of a component's rows without an id
    one stays too.
    """
    rows = written(fingerprints(docs, words, keyed=True), "fingerprints")
    of = _roots(rows, max_diff).select(F.col("fp").alias("_fp"), "root")
    # first per fingerprint, so that a hot one is a few rows where it meets its component
    least = F.min(F.struct("doc_id", "fp", "key")).alias("least")
    first = rows.groupBy("fp", F.col("doc_id").isNull().alias("unnamed")).agg(least)
    first = first.join(of, first["fp"] == of["_fp"]).groupBy("root", "unnamed").agg(F.min("least").alias("least"))
    key, nth = fresh(docs, "_key"), fresh(docs, "_nth")
    stays = first.select(F.col("least.key").alias("_stays"))
    kept = docs.withColumn(key, _row_key())
    kept = kept.join(stays, kept[key] == stays["_stays"], "left_semi")
    return kept.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(key))).filter(F.col(nth) == 1).drop(key, nth)
