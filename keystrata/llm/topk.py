"""Exact top-k inner-product search: a ball tree per shard, branch and bound.

Vectors are dealt to cells around pivots (a few Lloyd steps over a bounded sample, which has no part in the result)
and a large cell, such as one of a vector's many copies, by a hash of the id into shards of about ``shard_rows``.
Each shard builds a ball tree (median splits, so its depth is bounded whatever the data).  A search pops nodes by
the largest inner-product upper bound ``q.c + |q| r`` and drops the queries whose k-th score so far the bound cannot
reach.

The k-th score is shared between shards: in the first round each query searches the shard of its own cell.  The top
balls of every shard are known, so a query then travels only to shards with a ball whose bound reaches its k-th
score; they meet it in blocks of ``query_rows`` queries, so no group grows with the table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE, EVERY, K = 256, 50, 5
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


class BallTree(NamedTuple):
    order: np.ndarray  # rows, so that each node holds a slice
    begin: np.ndarray
    end: np.ndarray
    left: np.ndarray  # -1 in leaves; the right child follows the left one's number in ``right``
    right: np.ndarray
    centre: np.ndarray
    radius: np.ndarray


def build(x: np.ndarray, leaf: int = 64) -> BallTree:
    """A tree over the rows of ``x`` (float64)."""
    order = np.arange(len(x))
    begin, end, left, right, centre, radius = [], [], [], [], [], []

    def node(a: int, b: int) -> int:
        part = x[order[a:b]]
        c = part.mean(axis=0)
        begin.append(a), end.append(b), left.append(-1), right.append(-1), centre.append(c)
        radius.append(float(np.sqrt(((part - c) ** 2).sum(axis=1).max())))
        return len(begin) - 1

    todo = [node(0, len(x))] if len(x) else []
    while todo:
        k = todo.pop()
        a, b = begin[k], end[k]
        if b - a <= leaf or radius[k] == 0:
            continue
        part = x[order[a:b]]
        far = part[np.argmax(((part - centre[k]) ** 2).sum(axis=1))]
        other = part[np.argmax(((part - far) ** 2).sum(axis=1))]
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part @ (other - far), half)]
        left[k], right[k] = node(a, a + half), node(a + half, b)
        todo += [left[k], right[k]]
    return BallTree(order, *map(np.array, (begin, end, left, right)), np.array(centre).reshape(len(begin), x.shape[1]), np.array(radius))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond 64 bits they stop at the largest long."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
    if top < 2**53:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    if top < 2**62:
        return q @ x.T
    exact = q.astype(object) @ x.astype(object).T
    return np.clip(exact, LONG_MIN, LONG_MAX).astype(np.int64)


def search(tree: BallTree, x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, k: int, block: int = 64) -> list[tuple[int, int, int]]:
    """``(query, row's id, score)``: per query its k best among ``x`` (integers), of those that reach ``floor``.

    Rows with the query's own id take no part.  Ties go to the smaller id.
    """
    out: list[tuple[int, int, int]] = []
    if not len(x):
        return out
    for at in range(0, len(q), block):
        qb, qi = q[at : at + block], q_ids[at : at + block]
        n = len(qb)
        qf = qb.astype(float)
        norm = np.sqrt((qf**2).sum(axis=1))
        best = np.full((n, k), LONG_MIN, np.int64)
        best_id = np.full((n, k), LONG_MAX, np.int64)
        there = np.zeros((n, k), bool)
        kth = floor[at : at + block].astype(float).copy()

        def bound(node: int, rows: np.ndarray) -> np.ndarray:
            c, r = tree.centre[node], tree.radius[node]
            slack = 1 + 1e-9 * norm[rows] * (np.sqrt((c**2).sum()) + r)
            return qf[rows] @ c + norm[rows] * r + slack

        heap: list[tuple[float, int, np.ndarray, np.ndarray]] = []

        def push(node: int, rows: np.ndarray) -> None:
            if len(rows):
                b = bound(node, rows)
                on = b >= kth[rows]
                if on.any():
                    heapq.heappush(heap, (-float(b[on].max()), node, rows[on], b[on]))

        push(0, np.arange(n))
        while heap:
            _, node, rows, b = heapq.heappop(heap)
            rows = rows[b >= kth[rows]]  # the k-th score may have risen since
            if not len(rows):
                continue
            if tree.left[node] >= 0:
                push(tree.left[node], rows)
                push(tree.right[node], rows)
                continue
            for lo in range(tree.begin[node], tree.end[node], 4096):  # a leaf of equal vectors can be large
                member = tree.order[lo : min(lo + 4096, tree.end[node])]
                s = _scores(qb[rows], x[member])
                own = ids[member][None] == qi[rows, None]
                ok = ~own & (s >= kth[rows, None])
                hit = ok.any(axis=1)
                if not hit.any():
                    continue
                r = rows[hit]
                all_s = np.concatenate([best[r], s[hit]], axis=1)
                all_i = np.concatenate([best_id[r], np.broadcast_to(ids[member], s.shape)[hit]], axis=1)
                all_t = np.concatenate([there[r], ok[hit]], axis=1)
                # descending score without overflow: ~s reverses the order of longs
                pick = np.lexsort((all_i, ~all_s, ~all_t), axis=1)[:, :k]
                best[r], best_id[r], there[r] = (np.take_along_axis(v, pick, axis=1) for v in (all_s, all_i, all_t))
                full = there[r].all(axis=1)
                kth[r[full]] = np.maximum(kth[r[full]], best[r[full], -1].astype(float))
        for a in range(n):
            out += [(int(qi[a]), int(best_id[a, c]), int(best[a, c])) for c in range(k) if there[a, c]]
    return out


def _stacked(packed) -> np.ndarray:
    """Vectors of one length as rows."""
    return np.frombuffer(b"".join(packed), "<i8").reshape(len(packed), -1)


def _visit(k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        if len(rows) and len(queries):
            x, q = _stacked(rows["v"]), _stacked(queries["v"])
            floor = queries["kth"].to_numpy(float, na_value=-np.inf)
            found = search(build(x.astype(float)), x, rows["vec_id"].to_numpy(np.int64), q, queries["vec_id"].to_numpy(np.int64), np.where(np.isnan(floor), -np.inf, floor), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


#: Cells, and sampled vectors for each of their pivots; balls that describe a shard; bytes of balls sent to the tasks at once.
MAX_CELLS, SAMPLE_PER_CELL, BALLS, BALL_BYTES = 256, 30, 16, 64 << 20


def _by_dim(dims: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for d in np.unique(dims):
        yield int(d), np.flatnonzero(dims == d)


def _pivots(sample: list, cells: int) -> dict[int, np.ndarray]:
    """Per length of vector up to ``cells`` centres."""
    out = {}
    dims = np.array([len(r.v) // 8 for r in sample], int)
    for d, at in _by_dim(dims):
        x = _stacked([bytes(sample[i].v) for i in at]).astype(float)
        c = np.unique(x, axis=0)
        c = c[np.linspace(0, len(c) - 1, min(cells, len(c))).astype(int)]
        for _ in range(4 * (d > 0)):
            near = _nearest(x, c)
            n = np.bincount(near, minlength=len(c))
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        out[d] = c
    return out


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c**2).sum(axis=1) - 2 * (x @ c.T), axis=1)


def _with_cells(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``vec_id, dim, v, cell``: the nearest pivot of the vector's length; 0 where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, cell = b.column(1).to_numpy(zero_copy_only=False), np.zeros(b.num_rows, np.int64)
            for d, at in _by_dim(dims):
                if d in pivots and d:
                    for lo in range(0, len(at), 4096):
                        some = at[lo : lo + 4096]
                        cell[some] = _nearest(_stacked([b.column(2)[i].as_py() for i in some.tolist()]).astype(float), pivots[d])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=["vec_id", "dim", "v", "cell"])

    return rows.mapInArrow(run, "vec_id long, dim int, v binary, cell long")


def _packed(rows: DataFrame) -> DataFrame:
    """``vec_id, dim, v`` with the vector as little-endian longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            ends = np.diff(v.offsets.to_numpy())
            flat, at = v.flatten().to_numpy(zero_copy_only=False).astype("<i8"), np.concatenate([[0], np.cumsum(ends)])
            packed = [flat[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ends, pa.int32()), pa.array(packed, pa.binary())], names=["vec_id", "dim", "v"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, dim int, v binary")


def _balls(rows: pd.DataFrame) -> pd.DataFrame:
    """The balls of the upper nodes of a shard's tree that together hold all its rows."""
    x = _stacked(rows["v"]).astype(float)
    t = build(x, leaf=max(64, -(-len(x) // BALLS)))
    leaves = np.flatnonzero(t.left < 0)
    packed = [t.centre[i].astype("<f8").tobytes() for i in leaves]
    return pd.DataFrame({"shard": rows["shard"].iloc[0], "dim": rows["dim"].iloc[0], "centre": packed, "radius": t.radius[leaves]})


def _reached(balls: list):
    """Queries with each shard, but their own, that has a ball whose bound reaches their k-th score."""
    known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
    balls = sorted(balls, key=lambda r: (r.dim, r.shard))
    for d, at in _by_dim(np.array([r.dim for r in balls], int)):
        c = np.frombuffer(b"".join(bytes(balls[i].centre) for i in at), "<f8").reshape(len(at), d)
        shard = np.array([balls[i].shard for i in at], np.int64)
        first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        known[d] = c, np.array([balls[i].radius for i in at]), shard[first], first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, home = b.column(1).to_numpy(zero_copy_only=False), b.column(4).to_numpy(zero_copy_only=False)
            kth = b.column(3).to_numpy(zero_copy_only=False).astype(float)
            kth = np.where(np.isnan(kth), -np.inf, kth)
            for d, at in _by_dim(dims):
                if d not in known:
                    continue
                c, r, shards, first = known[d]
                reach = np.sqrt((c**2).sum(axis=1)) + r
                for lo in range(0, len(at), 256):
                    some = at[lo : lo + 256]
                    q = _stacked([b.column(2)[i].as_py() for i in some.tolist()]).astype(float)
                    norm = np.sqrt((q**2).sum(axis=1))[:, None]
                    bound = np.maximum.reduceat(q @ c.T + norm * r + 1 + 1e-9 * norm * reach, first, axis=1)
                    i, j = np.nonzero((bound >= kth[some, None]) & (shards[None] != home[some, None]))
                    if len(i):
                        rows = b.take(pa.array(some[i]))
                        yield pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array(shards[j])], names=["vec_id", "dim", "v", "kth", "shard"])

    return run


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: each component floored after scaling.  Vectors that are null or hold null or non-finite components go, as do null ids."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    fine = F.forall(F.col("x"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (
        embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
        .filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine)
        .select("vec_id", F.transform("x", lambda c: F.floor(c * float(scale)).cast("long")).alias("v"))
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = 50_000, query_rows: int = 50_000, cells: int = MAX_CELLS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for integer vectors ``vec_id, v``: the k largest inner products (all, if fewer).

    A query is an id: it compares with vectors of its own length and other id.  Repeated rows of a candidate each
    count; rows that repeat a query's id are its own, so they are neither further queries (the least vector is
    taken) nor candidates.  Empty tables give no rows.
    """
    packed = written(_packed(vectors), "vectors")
    n = packed.count()
    cells = max(1, min(cells, -(-n // shard_rows)))
    pivots: dict[int, np.ndarray] = {}
    if cells > 1:
        wanted = cells * SAMPLE_PER_CELL
        pivots = _pivots(packed.sample(min(1.0, 1.2 * wanted / n), seed=11).limit(wanted).select("v").collect(), cells)
    placed = _with_cells(packed, pivots)
    subs = written(placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_rows).alias("subs")).select(F.col("dim").alias("_d"), F.col("cell").alias("_c"), "subs"), "cells")

    def dealt_of(rows: DataFrame) -> DataFrame:
        on = (F.col("dim") == F.col("_d")) & (F.col("cell") == F.col("_c"))
        sub = F.pmod(F.xxhash64("vec_id"), F.coalesce("subs", F.lit(1)))
        return rows.join(subs, on, "left").select("vec_id", "dim", "v", (F.shiftleft(F.col("cell"), 32) + sub).alias("shard"))

    # written, so that a cell that holds very many rows is split where it is read
    dealt = written(dealt_of(placed), "dealt")
    asked = written(dealt_of(_with_cells(_packed(queries.groupBy("vec_id").agg(F.min("v").alias("v"))), pivots)), "queries")
    visit, schema = _visit(k), "query_id long, vec_id long, score long"

    def round_of(pairs: DataFrame) -> DataFrame:
        """``pairs`` (vec_id, dim, v, kth, shard) against the rows of their shards, a block of queries at a time."""
        blocks = pairs.groupBy("shard", "dim").agg(F.ceil(F.count("*") / query_rows).alias("blocks")).select(F.col("shard").alias("_s"), F.col("dim").alias("_d"), "blocks")
        on = (F.col("shard") == F.col("_s")) & (F.col("dim") == F.col("_d"))
        rows = dealt.join(blocks, on).select("vec_id", "dim", "v", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        q = pairs.join(blocks, on).select("vec_id", "dim", "v", "kth", "shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).alias("block"))
        return rows.groupBy("shard", "dim", "block").cogroup(q.groupBy("shard", "dim", "block")).applyInPandas(visit, schema)

    found = written(round_of(asked.select("vec_id", "dim", "v", F.lit(None).cast("double").alias("kth"), "shard")), "round1")
    balls = written(dealt.groupBy("shard", "dim").applyInPandas(_balls, "shard long, dim int, centre binary, radius double"), "balls")
    size = balls.agg(F.sum(F.octet_length("centre") + 32)).first()[0] or 0
    kth = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("best"))  # k at most came back
    # a long as a double may round up: one step down keeps ties
    lower = F.col("best") - F.abs(F.col("best")) * 1e-15 - 1
    carried = written(asked.join(kth, asked["vec_id"] == kth["query_id"], "left").select("vec_id", "dim", "v", lower.alias("kth"), F.col("shard").alias("home")), "carried")
    chunks = max(1, -(-size // BALL_BYTES))
    for c in range(chunks):  # the balls of some shards at a time, of a bounded size
        part = balls.filter(F.pmod(F.xxhash64("shard"), F.lit(chunks)) == c).collect()
        if part:
            pairs = written(carried.mapInArrow(_reached(part), "vec_id long, dim int, v binary, kth double, shard long"), "pairs")
            found = found.unionByName(round_of(pairs))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(embeddings: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, shard_rows: int = 50_000, query_rows: int = 50_000) -> DataFrame:
    """Every ``every``-th id of ``embeddings`` against all rows; extra columns are ignored."""
    v = quantised(embeddings, scale)
    return top_k(v, v.filter(F.col("vec_id") % every == 0), k, shard_rows, query_rows)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::double) AS BIGINT)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT vec_id, min(q) AS q FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (SELECT a.vec_id AS query_id, b.vec_id,
             CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
