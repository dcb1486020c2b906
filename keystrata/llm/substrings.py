"""Exact removal of repeated word windows by super-k-mer partitioning.

Every window of ``WINDOW`` words has a minimiser: the least hash among its runs of ``MER`` words.  Consecutive
windows that share it travel as one packed string (a super-k-mer) to the minimiser's bucket, so equal windows
meet in one bucket although no window is sent alone.  There they are sorted and counted exactly: by a 64-bit
hash first, then word by word among equal hashes.

Skew.  A document's removals depend on its text alone, so copies are one record under the text's digest (128 bits
of SHA-256), and equal super-k-mers of a batch are joined before the shuffle with a mark that says "seen twice": a
passage or text that a third of all rows share sends one record per batch.  Runs of words that occur in many
documents of a bounded sample (``SAMPLE_DOCS``) come last in the order of minimisers, so windows that only touch a
common passage go elsewhere; the sample balances load and has no part in what is found.  Buckets are planned for
``BUCKET_BYTES`` of packed text.  One that turns out to hold over ``HOLD`` times as much, as a minimiser that very
many texts share makes it, is handed on unread: its super-k-mers are cut again by the next wider minimiser
(``FINER``) and meet in buckets of that, up to the whole window.  So no task holds more, whatever the input's size.

Only texts that may lose something are shuffled to their spans: a Bloom filter of bounded size tells the others.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bloom
from .common import arrow_batches, written

WINDOW, MER = 35, 4
BUCKET_BYTES = 16 << 20
#: Times of ``BUCKET_BYTES`` that a task holds of one bucket; words of the minimisers that larger ones are cut by.
HOLD, FINER = 3, (10, 20, WINDOW)
#: Most bits of the filter of texts that may lose something.
FILTER_BITS = 1 << 26
#: Bounds of the sample that finds common runs: documents read, and the share of them that makes a run common.
SAMPLE_DOCS, COMMON_SHARE = 20_000, 0.005
#: Bytes of text that are packed together.
PACK_BYTES = 12 << 20
#: Of an Arrow batch of packed rows.
BATCH_BYTES = "16m"

_ODD = np.uint64(0xD6E8FEB86659FD93)
_ODD_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing of each value (the finaliser of MurmurHash3, away from zero)."""
    x = x + np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _run_hashes(x: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive values of ``x`` (wrapping sums of x[i] * odd**i, shifted back to the run's start)."""
    n = len(x)
    if n < width:
        return np.zeros(0, np.uint64)
    down = np.full(n, _ODD_INVERSE)
    down[0] = 1
    up = np.full(n, _ODD)
    up[0] = 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * np.cumprod(down), dtype=np.uint64)])
    return _mixed((total[width:] - total[:-width]) * np.cumprod(up)[: n - width + 1])


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    reach, out = 1, h
    while 2 * reach <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def _digest(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()[:16]


def _mer_hashes(words: list[bytes], common: np.ndarray, mer: int = MER) -> np.ndarray:
    h = _run_hashes(_mixed(np.fromiter(map(zlib.crc32, words), np.uint64, len(words))), mer) >> np.uint64(1)
    if len(common) and len(h):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        h = np.where(common[at] == h, h | np.uint64(1 << 63), h)
    return h


def super_kmers(words: list[bytes], common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``minimiser, first window, windows, may repeat inside`` for each run of windows with one minimiser."""
    h = _mer_hashes(words, common)
    least = _least(h, WINDOW - MER + 1)
    cut = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    minimiser = least[cut]
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    inside = np.zeros(len(cut), bool)
    if len(twice):
        inside = twice[np.minimum(np.searchsorted(twice, minimiser), len(twice) - 1)] == minimiser
    return minimiser, cut, np.diff(np.append(cut, len(least))), inside


_HEAD = np.dtype([("minimiser", "<u8"), ("flags", "u1"), ("sources", "<u4"), ("bytes", "<u4")])
_SOURCE = np.dtype([("digest", "V16"), ("start", "<u4"), ("windows", "<u4")])
_INSIDE, _TWICE = 1, 2


def _packed(texts: dict[bytes, list], buckets: int, common: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """``bucket, blob`` for texts by digest (text, times)."""
    records: dict[bytes, list] = {}
    for digest, (text, times) in texts.items():
        words = text.split()
        if len(words) < WINDOW:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        minimiser, first, windows, inside = super_kmers(words, common)
        begin = np.where(first > 0, ends[first - 1], 0).tolist()
        end = (ends[first + windows + WINDOW - 2] - 1).tolist()
        for m, a, b, s, w, i in zip(minimiser.tolist(), begin, end, first.tolist(), windows.tolist(), inside.tolist()):
            part = joined[a:b]
            r = records.get(part)
            if r is None:
                records[part] = [m, i * _INSIDE | (times > 1) * _TWICE, w, [(digest, s)]]
            else:
                r[1] |= _TWICE
                r[3].append((digest, s))
    yield from _blobs(records, buckets)


def _blobs(records: dict[bytes, list], buckets: int) -> Iterator[tuple[int, bytes]]:
    """``bucket, blob`` of records (minimiser, flags, windows, sources) by their text."""
    by_bucket: dict[int, list] = {}
    for part, r in records.items():
        by_bucket.setdefault(r[0] % buckets, []).append((part, r))
    squeeze = zstandard.ZstdCompressor(level=3)
    for bucket, held in by_bucket.items():
        for at in range(0, len(held), 20_000):
            some = held[at : at + 20_000]
            head = np.array([(r[0], r[1], len(r[3]), len(p)) for p, r in some], _HEAD)
            source = np.array([(d, s, r[2]) for _, r in some for d, s in r[3]], _SOURCE)
            yield bucket, squeeze.compress(len(some).to_bytes(4, "little") + head.tobytes() + source.tobytes() + b"".join(p for p, _ in some))


def _opened(raw: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Heads, sources and texts of an uncompressed blob."""
    n = int.from_bytes(raw[:4], "little")
    head = np.frombuffer(raw, _HEAD, n, 4)
    at = 4 + head.nbytes
    source = np.frombuffer(raw, _SOURCE, int(head["sources"].sum()), at)
    at += source.nbytes
    ends = (at + np.cumsum(head["bytes"].astype(np.int64))).tolist()
    return head, source, [raw[end - size : end] for end, size in zip(ends, head["bytes"].tolist())]


def _cut_again(buckets: int, mer: int, pack_bytes: int):
    """Blobs of hot buckets to blobs of finer ones: each super-k-mer is cut where the wider minimiser changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, none = zstandard.ZstdDecompressor(), np.zeros(0, np.uint64)
        records: dict[bytes, list] = {}
        held = 0

        def emit() -> pa.RecordBatch:
            rows = list(_blobs(records, buckets))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            for blob in batch.column(0):
                head, source, text = _opened(wide.decompress(blob.as_py()))
                first = np.cumsum(head["sources"]) - head["sources"]
                for k, t in enumerate(text):
                    words = t.split(b" ")
                    least = _least(_mer_hashes(words, none, mer), WINDOW - mer + 1)
                    cut = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
                    at = [(d, s) for d, s, _ in source[first[k] : first[k] + head["sources"][k]].tolist()]
                    for a, w in zip(cut.tolist(), np.diff(np.append(cut, len(least))).tolist()):
                        part = b" ".join(words[a : a + w + WINDOW - 1])
                        r = records.get(part)
                        if r is None:
                            records[part] = [int(least[a]), int(head["flags"][k]), w, [(d, s + a) for d, s in at]]
                            held += len(part) + 24 * len(at)
                        else:
                            r[1] |= _TWICE
                            r[3] += [(d, s + a) for d, s in at]
                            held += 24 * len(at)
                    if held >= pack_bytes:
                        yield emit()
                        records, held = {}, 0
        if records:
            yield emit()

    return run


def _pack(buckets: int, common: np.ndarray, pack_bytes: int):
    def emit(texts: dict) -> pa.RecordBatch | None:
        rows = list(_packed(texts, buckets, common))
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[bytes, list] = {}
        held = 0
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py()
                if not text:
                    continue
                d = _digest(text)
                if d in texts:
                    texts[d][1] += 1
                    continue
                texts[d] = [text, 1]
                held += len(text)
                if held >= pack_bytes:
                    yield emit(texts)
                    texts, held = {}, 0
        if texts:
            yield emit(texts)

    return run


def _repeated(text: list[bytes], twice: np.ndarray) -> list[np.ndarray]:
    """For super-k-mers that may share windows: per super-k-mer which of its windows occur twice or more in all of them."""
    number: dict[bytes, int] = {}
    lengths, ids = [], []
    for t in text:
        w = t.split(b" ")
        lengths.append(len(w))
        ids.extend([number.setdefault(x, len(number)) for x in w])
    x = np.array(ids, np.int64)
    size = np.array(lengths)
    h = _run_hashes(_mixed(x.astype(np.uint64)), WINDOW)
    begin = np.cumsum(size) - size
    count = size - WINDOW + 1
    owner = np.repeat(np.arange(len(text)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
    order = np.lexsort((at, h[at]))
    s, hs = at[order], h[at][order]
    same = hs[1:] == hs[:-1]
    for lo in range(0, len(same), 1 << 16):  # word by word among neighbours with one hash
        k = lo + np.flatnonzero(same[lo : lo + (1 << 16)])
        if len(k):
            step = np.arange(WINDOW)
            same[k] = (x[s[k][:, None] + step] == x[s[k + 1][:, None] + step]).all(axis=1)
    clash = (hs[1:] == hs[:-1]) & ~same
    found = np.zeros(len(s), bool)
    found[1:] |= same
    found[:-1] |= same
    for v in np.unique(hs[1:][clash]):  # different windows with one hash: counted by their words
        k = np.flatnonzero(hs == v)
        seen: dict[tuple, list[int]] = {}
        for j in k.tolist():
            seen.setdefault(tuple(x[s[j] : s[j] + WINDOW].tolist()), []).append(j)
        for js in seen.values():
            found[js] = len(js) > 1
    flat = np.zeros(len(s), bool)
    flat[order] = found
    flat |= twice[owner]
    return np.split(flat, np.cumsum(count)[:-1])


def _spans(head: np.ndarray, source: np.ndarray, text: list[bytes]) -> pa.RecordBatch:
    """Runs of repeated windows of a bucket: ``digest, start, windows``, each once."""
    _, group, size = np.unique(head["minimiser"], return_inverse=True, return_counts=True)
    keep = (size[group] > 1) | (head["flags"] > 0)
    out: set[tuple[bytes, int, int]] = set()
    if keep.any():
        first = np.cumsum(head["sources"]) - head["sources"]
        at = np.flatnonzero(keep)
        for k, hit in zip(at.tolist(), _repeated([text[k] for k in at], head["flags"][at] & _TWICE > 0)):
            if hit.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                for d, s, _ in source[first[k] : first[k] + head["sources"][k]].tolist():
                    out.update((d, s + a, b - a) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()))
    digest, start, windows = zip(*out) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(start, pa.int32()), pa.array(windows, pa.int32())], names=["digest", "start", "windows"])


_FOUND = "digest binary, start int, windows int, blob binary, raw long"


def _count(hold: int | None):
    """Over blobs sorted by bucket, a bucket at a time: its spans, or its blobs where they are more than ``hold`` bytes."""
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def settle(raws: list[bytes]) -> pa.RecordBatch:
        heads, sources, texts = zip(*map(_opened, raws))
        found = _spans(np.concatenate(heads), np.concatenate(sources), [t for part in texts for t in part])
        return pa.RecordBatch.from_arrays([*found.columns, *(pa.nulls(found.num_rows, k) for k in kinds[3:])], names=names)

    def passed_on(raw: bytes) -> pa.RecordBatch:
        blob = zstandard.ZstdCompressor(level=3).compress(raw)
        return pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds[:3]), pa.array([blob], kinds[3]), pa.array([len(raw)], kinds[4])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = zstandard.ZstdDecompressor()
        bucket, raws, held, hot = None, [], 0, False
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if b != bucket:
                    if raws:
                        yield settle(raws)
                    bucket, raws, held, hot = b, [], 0, False
                raw = wide.decompress(blob.as_py())
                held += len(raw)
                raws.append(raw)
                hot = hot or hold is not None and held > hold
                if hot:
                    for r in raws:
                        yield passed_on(r)
                    raws = []
        if raws:
            yield settle(raws)

    return run


def _kept(text: bytes, spans: list | None) -> tuple[int, int, str]:
    """Number of words of a text and of those that go, and the others joined."""
    words = text.split()
    n = len(words)
    if spans:
        gone = np.zeros(n + 1, np.int64)
        start = np.array([s["start"] for s in spans])
        np.add.at(gone, start, 1)
        np.add.at(gone, start + np.array([s["windows"] for s in spans]) + WINDOW - 1, -1)
        words = [w for w, k in zip(words, (np.cumsum(gone[:n]) == 0).tolist()) if k]
    return n, n - len(words), b" ".join(words).decode("utf-8", "replace")


_REMOVED = "doc_id long, n_words long, n_removed long, kept_text string"


def _rows_of(ids: pa.Array, kept: list[tuple[int, int, str]]) -> pa.RecordBatch:
    n, removed, text = zip(*kept) if kept else ((), (), ())
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(text, pa.string())], names=[c.split()[0] for c in _REMOVED.split(", ")])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _rows_of(batch.column(0), [_kept(t.as_py() or b"", s.as_py()) for t, s in zip(batch.column(1), batch.column(2))])


#: Texts looked at together.
_ROWS = 1000


def _may_lose(texts: list[bytes | None], data: bytes, bits: int, hashes: int) -> np.ndarray:
    """Which texts the filter holds; too short ones lose nothing."""
    out = np.zeros(len(texts), bool)
    at = np.array([k for k, t in enumerate(texts) if t and len(t) >= 2 * WINDOW - 1], int)
    if len(at):
        places = bloom.positions([_digest(texts[k]) for k in at.tolist()], bits, hashes)
        packed = np.frombuffer(data, np.uint8)
        out[at] = ((packed[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
    return out


def _untouched(data: bytes, bits: int, hashes: int):
    """The results of texts that lose nothing, where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                texts = part.column(1).to_pylist()
                k = np.flatnonzero(~_may_lose(texts, data, bits, hashes))
                if len(k):
                    yield _rows_of(part.column(0).take(pa.array(k)), [_kept(texts[i] or b"", None) for i in k.tolist()])

    return run


def _touched(data: bytes, bits: int, hashes: int):
    """``doc_id, text, own`` of the others, with the text's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                texts = part.column(1).to_pylist()
                k = np.flatnonzero(_may_lose(texts, data, bits, hashes))
                if not len(k):
                    continue
                some = part.take(pa.array(k))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([_digest(texts[i]) for i in k.tolist()], pa.binary())], names=["doc_id", "text", "own"])

    return run


def _commons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, np.uint64)
    for batch in batches:
        for text in batch.column(0):
            words = (text.as_py() or b"").split()
            if len(words) >= WINDOW:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_least(_mer_hashes(words, none), WINDOW - MER + 1)).view(np.int64))], names=["mer"])


def common_runs(docs: DataFrame, n_docs: int) -> np.ndarray:
    """Hashes of minimisers that ``COMMON_SHARE`` of a sample of about ``SAMPLE_DOCS`` documents hold, sorted.

    There are at most (minimisers of a document) / ``COMMON_SHARE`` of them, however large the input.
    """
    share = min(1.0, SAMPLE_DOCS / max(1, n_docs))
    sample = docs.select(F.col("text").cast("binary").alias("text"))
    if share < 1:
        sample = sample.sample(fraction=share, seed=7)
    least = max(20, int(COMMON_SHARE * min(n_docs, SAMPLE_DOCS)))
    found = sample.mapInArrow(_commons, "mer long").groupBy("mer").count().filter(F.col("count") >= least).select("mer").collect()
    return np.sort(np.array([r.mer for r in found], np.int64).view(np.uint64))


def repeated_windows(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, pack_bytes: int = PACK_BYTES, hold: int = HOLD) -> DataFrame:
    """``digest, start, windows``: for each distinct text (by digest) the runs of windows that also start elsewhere."""
    size = docs.agg(F.count("*"), F.sum(F.octet_length(F.col("text").cast("string")))).first()
    # each super-k-mer has about half as many windows as a window has minimiser places
    packed = (size[1] or 0) * (1 + 2 * WINDOW / (WINDOW - MER + 2))
    buckets = max(1, min((1 << 31) - 1, int(packed / bucket_bytes) + 1))
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    blobs = texts.mapInArrow(_pack(buckets, common_runs(docs, size[0]), pack_bytes), "bucket int, blob binary")
    found = None
    for mer in (*FINER, None):
        # only spans are written, and the blobs of buckets that were too large
        some = blobs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count(None if mer is None else hold * bucket_bytes), _FOUND)
        with arrow_batches(docs.sparkSession, BATCH_BYTES):
            some = written(some, "spans")
        found = some if found is None else found.unionByName(some)
        over = some.agg(F.sum("raw")).first()[0] if mer else None
        if not over:
            break
        buckets = max(1, min((1 << 31) - 1, 2 * over // bucket_bytes + 1))
        blobs = some.filter(F.col("blob").isNotNull()).select("blob").repartition(max(1, over // pack_bytes)).mapInArrow(_cut_again(buckets, mer, pack_bytes), "bucket int, blob binary")
    return found.filter(F.col("blob").isNull()).select("digest", "start", "windows")


def deduplicated(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, pack_bytes: int = PACK_BYTES, hold: int = HOLD) -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed, kept_text`` (kept words joined by one space).

    Null, empty and short texts lose nothing; very long ones are read whole.  Repeated rows are each other's repeats;
    null ids pass through; an empty table gives no rows; extra columns are ignored.
    """
    spans = repeated_windows(docs, bucket_bytes, pack_bytes, hold).groupBy("digest").agg(F.collect_set(F.struct("start", "windows")).alias("spans"))
    # written, so that the join below can split the rows of a text that very many documents share
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        spans = written(spans, "spans")
    n = spans.count()
    bits, hashes = min(FILTER_BITS, max(64, 12 * n)), 5
    data = bytes(bloom.build(spans.select("digest"), "digest", bits, hashes).first()["filter"])
    of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    own = of.mapInArrow(_touched(data, bits, hashes), "doc_id long, text binary, own binary")
    joined = own.join(spans, own["own"] == spans["digest"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_removed, _REMOVED).unionByName(of.mapInArrow(_untouched(data, bits, hashes), _REMOVED))


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
x AS (SELECT rid, i, words[i] AS word, CASE WHEN i + {WINDOW - 1} <= len(words) THEN array_to_string(words[i : i + {WINDOW - 1}], ' ') END AS win
      FROM (SELECT rid, words, unnest(range(1, len(words) + 1)) AS i FROM d)),
r AS (SELECT rid, i, word, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS rep FROM x),
m AS (SELECT rid, i, word, max(rep::int) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM r),
k AS (SELECT rid, sum(gone)::bigint AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM m GROUP BY rid)
SELECT doc_id, len(words)::bigint AS n_words, coalesce(n_removed, 0)::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
