"""Language-model scores with stupid backoff from the corpus's own n-gram counts.

``S(w | v) = c(v w) / c(v)`` where the pair occurs in another document, else ``BACKOFF * c(w) / N``.  A document's
own counts are left out, so rare text isn't vouched for by itself; a word that nobody else has counts ``UNSEEN``.

Relational plan:

1. ``coded``: texts of a batch become word numbers, written once to the shared folder.
2. Each batch is exploded to its distinct words, then to its distinct pairs, a part of all hashes at a time:
   ``(gram, batch, n)`` rows exchanged by a 64-bit hash.  A word or pair that a third of all documents share is one row a batch.
3. The count table is a ``groupBy`` of these rows by hash, joined back to them without a further exchange.  What only
   one batch has needs no answer: its own count is the total.
4. What other batches count goes back to the batch, where the totals meet the exploded n-grams of each document and
   are summed.

Copies share a text's SHA-256, are coded once a batch with their number, and are joined to their rows at the end.
Groups by batch hold what ``PACK_BYTES`` of text (or one longer text) hold; groups by hash are only added up.

An n-gram is its 64-bit hash.  Two of n distinct n-grams share one with a chance of n * n / 2**65, and then add their
counts: some 50 million n-grams (0.5 GB of documents) have none in 15,000 such corpora, 10**13 about three million
pairs, fewer than one n-gram in a million.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, settings, written

BACKOFF, UNSEEN = 0.4, 0.5
#: Bytes of text that are coded together.
PACK_BYTES = 6 << 20
#: Of an Arrow batch of n-grams.
ROWS = 1 << 16
#: Pairs are counted in so many steps by hash, batches scored in so many: each step deletes its exchanges.
PARTS, SLICES = 2, 4

_ODD = np.uint64(0xD6E8FEB86659FD93)


def _squeezed(x: np.ndarray) -> bytes:
    """Little-endian values by byte plane, compressed: high bytes of sorted hashes and small counts are nearly free."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T) if len(x) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _opened(b: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser (that of MurmurHash3)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


CODED = "batch long, n_tokens long, digests binary, lengths binary, times binary, hashes binary, tokens binary"


def _code(batches: Iterator[pa.RecordBatch], pack_bytes: int) -> Iterator[pa.RecordBatch]:
    part, made = TaskContext.get().partitionId(), 0
    texts: dict[bytes, list] = {}

    def emit() -> pa.RecordBatch:
        nonlocal made
        number: dict[bytes, int] = {}
        ids: list[int] = []
        lengths = []
        for text, _ in texts.values():
            words = text.split()
            lengths.append(len(words))
            ids.extend([number.setdefault(w, len(number)) for w in words])
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number))
        times = np.array([t for _, t in texts.values()], np.int64)
        row = [
            (part << 32) + made, int((np.array(lengths) * times).sum()), b"".join(texts), _squeezed(np.array(lengths, np.uint32)),
            _squeezed(times), _squeezed(hashes), _squeezed(np.array(ids, np.uint32)),
        ]
        made += 1
        kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in CODED.split(", ")])

    held = 0
    for batch in batches:
        for value in batch.column(0):
            text = value.as_py()
            if not text or not text.strip():
                continue
            d = hashlib.sha256(text).digest()
            if d in texts:
                texts[d][1] += 1
                continue
            texts[d] = [text, 1]
            held += len(text)
            if held >= pack_bytes:
                yield emit()
                texts.clear()
                held = 0
    if texts:
        yield emit()


class _Batch:
    """One coded row: its tokens, and its distinct words and pairs with their hashes and counts."""

    def __init__(self, lengths: bytes, times: bytes, hashes: bytes, tokens: bytes):
        self.lengths = _opened(lengths, "<u4").astype(np.int64)
        self.times = _opened(times, "<i8")
        self.h, self.ids = _opened(hashes, "<u8"), _opened(tokens, "<u4").astype(np.int32)
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        n = np.bincount(self.ids, self.times[self.doc].astype(float), len(self.h))
        return _mixed(self.h * _ODD + np.uint64(1)), n.astype(np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Also notes the tokens that follow another, and the pair that each of them ends."""
        follows = np.ones(len(self.ids), bool)
        follows[np.cumsum(self.lengths)[:-1]] = False
        follows[:1] = False
        self.second = np.flatnonzero(follows).astype(np.int32)
        pairs = self.ids[self.second - 1].astype(np.int64) << 32
        pairs |= self.ids[self.second]
        self.pair, code = pd.factorize(pairs)
        del pairs
        n = np.bincount(self.pair, self.times[self.doc[self.second]].astype(float), len(code))
        return _mixed(_mixed(self.h[code >> 32] + np.uint64(2)) * _ODD + self.h[code & 0xFFFFFFFF]), n.astype(np.int64)

    def own(self, item: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """For each token how often its document has the item."""
        both = doc.astype(np.int64) << 32
        both |= item
        back, _ = pd.factorize(both)
        del both
        return np.bincount(back)[back]

    def scores(self, words: np.ndarray, pairs: np.ndarray, n_tokens: int) -> np.ndarray:
        word = words[self.ids] - self.own(self.ids, self.doc)
        value = np.maximum(word, UNSEEN) / n_tokens
        at = self.second
        both = pairs[self.pair] - self.own(self.pair, self.doc[at])
        before = word[at - 1]
        value[at] = np.where((both > 0) & (before > 0), both / np.maximum(before, 1), BACKOFF * value[at])
        return np.bincount(self.doc, np.log(value), len(self.lengths))


ENTRIES = "gram long, batch long, n long"


def _entries(kind: str, part: int, parts: int):
    """Of each coded row its distinct words or pairs, of one part of all hashes, and how often they occur in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in range(rows.num_rows):
                name, *cols = (rows.column(c)[row].as_py() for c in range(5))
                keys, counts = getattr(_Batch(*cols), kind)()
                if parts > 1:
                    of = (keys >> np.uint64(32)) % np.uint64(parts) == part
                    keys, counts = keys[of], counts[of]
                for at in range(0, len(keys), ROWS):
                    k = keys[at : at + ROWS].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.full(len(k), name)), pa.array(counts[at : at + ROWS])], names=["gram", "batch", "n"])

    return run


def _score(n_tokens: int):
    def run(coded: pa.Table, elsewhere: pa.Table) -> pa.Table:
        digests, *cols = (coded.column(c)[0].as_py() for c in ("digests", "lengths", "times", "hashes", "tokens"))
        b = _Batch(*cols)
        (words, n_words), (pairs, n_pairs) = b.words(), b.pairs()
        keys, totals = np.concatenate([words, pairs]), np.concatenate([n_words, n_pairs])
        sought = elsewhere.column("gram").to_numpy().view(np.uint64)
        order, by = np.argsort(keys), np.argsort(sought)  # both in order: neighbours are found side by side
        at = order[np.searchsorted(keys[order], sought[by])]
        totals[at] += elsewhere.column("n_elsewhere").to_numpy()[by]
        del keys, sought, order, by, at
        s = b.scores(totals[: len(words)], totals[len(words) :], n_tokens)
        names = [digests[k : k + 32] for k in range(0, len(digests), 32)]
        return pa.table([pa.array(names, pa.binary()), pa.array(b.lengths, pa.int64()), pa.array(s, pa.float64())], names=["digest", "n_words", "log_score"])

    return run


def ngram_counts(entries: DataFrame) -> DataFrame:
    """The count table ``(gram, total, batches)`` of ``(gram, batch, n)`` rows: words and pairs by their 64-bit hash."""
    return entries.groupBy("gram").agg(F.sum("n").alias("total"), F.count("batch").alias("batches"))


def _elsewhere(coded: DataFrame, kind: str, part: int, parts: int) -> DataFrame:
    """``(batch, gram, n_elsewhere)`` of the n-grams that other batches have too; one exchange serves count table and join."""
    entries = coded.select("batch", "lengths", "times", "hashes", "tokens").mapInArrow(_entries(kind, part, parts), ENTRIES).repartition("gram")
    shared = ngram_counts(entries).filter("batches > 1").select(F.col("gram").alias("of"), "total")
    met = entries.join(shared.hint("shuffle_hash"), entries["gram"] == shared["of"])
    return met.select("batch", "gram", (F.col("total") - F.col("n")).alias("n_elsewhere"))


def scored(docs: DataFrame, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """Per row: ``doc_id, n_words, log_score`` (natural log, summed) and ``mean_log_score``.

    Null, empty and blank texts have no words, score 0 and a null mean.  Repeated rows count for each other; very
    long texts are read whole; null ids pass through; an empty table gives no rows; extra columns are ignored.
    """
    text = F.col("text").cast("binary")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):  # each step's exchanges go with it
        coded = scratch.written(docs.select(text.alias("text")).mapInArrow(lambda batches: _code(batches, pack_bytes), CODED), "coded")
        n_tokens = coded.agg(F.sum("n_tokens")).first()[0] or 0
        steps = [("words", 0, 1)] + [("pairs", part, PARTS) for part in range(PARTS)]
        elsewhere = functools.reduce(DataFrame.unionByName, [scratch.written(_elsewhere(coded, *step), step[0]) for step in steps])
        scores = []
        for k in range(SLICES):
            here, there = (df.filter(F.pmod(F.xxhash64("batch"), F.lit(SLICES)) == k).groupBy("batch") for df in (coded.drop("n_tokens"), elsewhere))
            scored_here = here.cogroup(there).applyInArrow(_score(int(n_tokens)), "digest binary, n_words long, log_score double")
            scores.append(scratch.written(scored_here, "slice"))
        scores = functools.reduce(DataFrame.unionByName, scores).groupBy("digest").agg(F.min("n_words").alias("n_words"), F.min("log_score").alias("log_score"))
        # written, so that the join below can split the rows of a text that very many documents share
        scores = written(scores, "scores")
    scratch.drop()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("own"))
    return own.join(scores, own["own"] == scores["digest"], "left").select(
        "doc_id",
        F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"),
        F.coalesce("log_score", F.lit(0.0)).alias("log_score"),
        (F.col("log_score") / F.col("n_words")).alias("mean_log_score"),
    )


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
x AS (SELECT rid, i, words[i] AS w, CASE WHEN i > 1 THEN words[i - 1] END AS v FROM (SELECT rid, words, unnest(range(1, len(words) + 1)) AS i FROM d)),
c1 AS (SELECT w, count(*) AS n FROM x GROUP BY w),
o1 AS (SELECT rid, w, count(*) AS n FROM x GROUP BY rid, w),
c2 AS (SELECT v, w, count(*) AS n FROM x WHERE v IS NOT NULL GROUP BY v, w),
o2 AS (SELECT rid, v, w, count(*) AS n FROM x WHERE v IS NOT NULL GROUP BY rid, v, w),
t AS (SELECT count(*)::double AS n FROM x),
j AS (SELECT x.rid, x.i, c1.n - o1.n AS cw, cv.n - ov.n AS cv, c2.n - o2.n AS cb, x.v IS NULL AS head
      FROM x JOIN c1 ON x.w = c1.w JOIN o1 ON x.rid = o1.rid AND x.w = o1.w
      LEFT JOIN c1 AS cv ON x.v = cv.w LEFT JOIN o1 AS ov ON x.rid = ov.rid AND x.v = ov.w
      LEFT JOIN c2 ON x.v = c2.v AND x.w = c2.w LEFT JOIN o2 ON x.rid = o2.rid AND x.v = o2.v AND x.w = o2.w),
s AS (SELECT rid, sum(ln(CASE WHEN head THEN greatest(cw, {UNSEEN}::double) / (SELECT n FROM t)
                              WHEN cb > 0 AND cv > 0 THEN cb / cv::double
                              ELSE {BACKOFF}::double * greatest(cw, {UNSEEN}::double) / (SELECT n FROM t) END)) AS log_score FROM j GROUP BY rid)
SELECT doc_id, len(words)::bigint AS n_words, round(coalesce(log_score, 0), 3) AS log_score, round(log_score / len(words), 5) AS mean_log_score
FROM d LEFT JOIN s USING (rid)
"""
