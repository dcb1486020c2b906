"""A durable ordered key/value table over Parquet runs.

Single mutations go to the log, then to a driver-side buffer that becomes a run at the flush threshold, on ``flush``
or ``close``; ``write_frame`` appends a whole DataFrame of mutations as one run, which is the way for bulk data.
Reads are DataFrames over the runs that the manifest named when the table was opened or last changed; they stay
valid after a compaction, as replaced runs are only deleted by ``vacuum``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping
from itertools import islice

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.bytesx import ENTRY_OVERHEAD, entry_bytes, next_prefix
from ..operators import compaction, scan
from ..operators.resolve import newest, resolve, visible
from ..schema import LOG_SCHEMA, STATS_SCHEMA, VERSION_SCHEMA, Closed, Conflict, Invalid, NotFound, Options, ReadOnly
from .log import Log, replay
from .store import Store

#: Bytes of a run's Parquet file that compaction aims at.
TARGET_FILE_BYTES = 256 << 20
MAX_SEQ = (1 << 63) - 1


class WriteBatch:
    """Mutations that commit together, in order; of one key the last one counts."""

    def __init__(self) -> None:
        self._ops: list[tuple[bytes, bytes | None, bool]] = []

    def put(self, key: bytes, value: bytes | None) -> WriteBatch:
        self._ops.append((bytes(key) if key is not None else b"", bytes(value or b""), False))
        return self

    def delete(self, key: bytes) -> WriteBatch:
        self._ops.append((bytes(key) if key is not None else b"", None, True))
        return self

    def __len__(self) -> int:
        return len(self._ops)

    def clear(self) -> None:
        self._ops.clear()


class Cursor:
    """An iterator over live keys in order: unpositioned first, forward only.

    The first page is a top-k; whoever goes past it gets the rest from one sorted pass, of which the driver holds
    a partition at a time.  So a short look costs no sort and a full scan resolves the log twice, not once a page.
    """

    def __init__(self, table: Table, page: int = 1000):
        self._versions, self._page = table.versions(), page
        self._rows: list = []
        self._rest: Iterator | None = None
        self._at, self._more, self._closed = -1, False, False

    def _after(self, low: bytes | None, inclusive: bool) -> DataFrame:
        v = self._versions
        if low is not None:
            v = v.filter(F.col("key") >= F.lit(low) if inclusive else F.col("key") > F.lit(low))
        return visible(v, src="src").select("key", "value").orderBy("key")

    def _fetch(self, low: bytes | None) -> None:
        self._rows, self._rest = self._after(low, True).limit(self._page).collect(), None
        self._at, self._more = 0, len(self._rows) == self._page

    def seek_to_first(self) -> None:
        self._fetch(None)

    def seek(self, target: bytes) -> None:
        """To the first live key at or after ``target``."""
        self._fetch(bytes(target))

    def valid(self) -> bool:
        return not self._closed and 0 <= self._at < len(self._rows)

    def next(self) -> None:
        if self._at < 0 or self._at >= len(self._rows):
            return
        last = bytes(self._rows[self._at].key)
        self._at += 1
        if self._at == len(self._rows) and self._more:
            if self._rest is None:
                self._rest = self._after(last, False).toLocalIterator()
            self._rows = list(islice(self._rest, self._page))
            self._at, self._more = 0, len(self._rows) == self._page

    def key(self) -> bytes | None:
        return bytes(self._rows[self._at].key) if self.valid() else None

    def value(self) -> bytes | None:
        return bytes(self._rows[self._at].value or b"") if self.valid() else None

    def close(self) -> None:
        self._closed, self._rows, self._rest = True, [], None

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        if self._at < 0:
            self.seek_to_first()
        while self.valid():
            yield self.key(), self.value()
            self.next()


class Table:
    def __init__(self, spark: SparkSession, root: str, options: Options | None = None):
        if not root:
            raise Invalid("a table needs a directory")
        self.spark, self.root = spark, root
        self.options = (options or Options()).normalized()
        self._store = Store(spark, root)
        if not self.options.read_only:
            self._store.create()
        self._number, self._manifest = self._store.read_manifest()
        self._seq = self._recovered_seq()
        self._memory: dict[bytes, tuple[bytes | None, int, bool]] = {}
        self._bytes = 0
        self._closed = False
        self._log = Log(self._store, uuid.uuid4().hex[:16], self.options.sync_policy, self.options.sync_every_n)
        self._recover()

    def _recover(self) -> None:
        """Mutations in the log that no run holds come back, behind all that is committed."""
        frames, self._adopted = replay(self._store, self._manifest["logs"])
        self._adopted_frames: dict[str, int] = {}
        for writer, f in frames:
            self._adopted_frames[writer] = max(f.number, self._adopted_frames.get(writer, 0))
            for op in f.ops:
                self._remember(*op)

    @classmethod
    def open(cls, spark: SparkSession, root: str, options: Options | None = None) -> Table:
        return cls(spark, root, options)

    def __enter__(self) -> Table:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def __repr__(self) -> str:
        return f"Table({self.root!r}, runs={len(self._manifest['files'])}, seq={self._seq}, {'closed' if self._closed else 'open'})"

    def path_for(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def _recovered_seq(self) -> int:
        return max([self._manifest["log_seq"], *(f["max_seq"] for f in self._manifest["files"])])

    def _check(self, write: bool = False) -> None:
        if self._closed:
            raise Closed("the table is closed")
        if write and self.options.read_only:
            raise ReadOnly("the table is open for reading only")

    def refresh(self) -> None:
        """See what other writers have committed."""
        self._check()
        self._number, self._manifest = self._store.read_manifest()
        self._seq = max(self._seq, self._recovered_seq())

    # writes

    def put(self, key: bytes, value: bytes | None) -> None:
        """An empty value is a live value."""
        self._apply([(key, bytes(value or b""), False)])

    def delete(self, key: bytes) -> None:
        """A tombstone, whether the key exists or not."""
        self._apply([(key, None, True)])

    def write(self, batch: WriteBatch | None) -> None:
        """All mutations of a batch or none, as one frame of the log."""
        if not batch:
            return
        self._apply(batch._ops)

    def _apply(self, ops: list[tuple[bytes, bytes | None, bool]]) -> None:
        if any(not k for k, _, _ in ops):
            raise Invalid("keys must not be empty")
        self._check(write=True)
        if self._seq > MAX_SEQ - len(ops):
            raise Invalid("sequence numbers are used up")
        ops = [(bytes(k), v, d) for k, v, d in ops]
        self._log.append(self._seq + 1, ops)
        for op in ops:
            self._remember(*op)
        if self._bytes >= self.options.memtable_bytes:
            self.flush()

    def _remember(self, key: bytes, value: bytes | None, deleted: bool) -> None:
        self._seq += 1
        old = self._memory.get(key)
        self._bytes += len(value or b"") - len(old[0] or b"") if old else len(key) + len(value or b"") + ENTRY_OVERHEAD
        self._memory[key] = (value, self._seq, deleted)

    def write_frame(self, mutations: DataFrame) -> None:
        """Append ``key, value, deleted, ord`` rows as one run; ``ord`` (not negative) is their order of writing.

        Empty and null keys, null ``deleted`` and orders past the last sequence number are refused.  Sequence
        numbers are the last one plus ``ord``.  A run holds one row a key, that of the greatest ``ord``; of equal
        ones a value beats a tombstone, and the greater value a smaller one.  Extra columns are ignored.
        """
        self._check(write=True)
        self.flush()
        self._append(mutations, F.col("ord"), self._seq + 1)

    def append_versions(self, versions: DataFrame, stream: str | None = None, batch: int = 0) -> bool:
        """Append ``key, value, deleted, seq`` rows with their own sequence numbers, so late versions stay late.

        Ties are settled as in ``write_frame``.  With ``stream``, batches of that name up to the last committed
        number are passed over (False): a batch that is delivered again isn't appended again.
        """
        self._check(write=True)
        self.flush()
        self.refresh()
        if stream is not None and batch <= self._manifest["streams"].get(stream, -1):
            return False
        self._append(versions, F.col("seq"), 0, None if stream is None else {stream: batch})
        return True

    def _append(self, rows: DataFrame, order: Column, base: int, streams: Mapping[str, int] | None = None) -> None:
        order = order.cast("long")
        dead = F.col("deleted").cast("boolean")
        named = rows.select(
            F.col("key").cast("binary").alias("key"),
            F.when(~dead, F.coalesce(F.col("value").cast("binary"), F.lit(b""))).alias("value"),
            F.try_add(order, F.lit(base)).alias("seq"),
            dead.alias("deleted"),
            (F.col("key").isNull() | (F.octet_length(F.col("key").cast("binary")) == 0) | order.isNull() | (order < 0) | (order > MAX_SEQ - base) | dead.isNull()).alias("bad"),
        )
        seen = Observation()
        named = named.observe(seen, F.count(F.when(F.col("bad"), 1)).alias("bad"), F.max("seq").alias("top")).drop("bad")
        won = newest(named, ("key",), F.col("seq").desc(), F.col("deleted").asc(), F.col("value").desc())

        def accept() -> int | None:
            if seen.get["bad"]:
                raise Invalid("mutations with an empty or null key, no order or one out of range, or no word on deletion")
            return seen.get["top"]

        self._commit_run(won, level=0, remove=(), top=accept, streams=streams, fixed=base == 0)

    def sync(self) -> None:
        """What is logged becomes durable; allowed on a read-only table, where nothing is."""
        self._check()
        if not self.options.read_only:
            self._log.sync()

    def flush(self) -> None:
        """The buffer becomes a run of level 0 and its log goes; an empty buffer is nothing to do."""
        self._check(write=True)
        if not self._memory:
            return
        rows = [(bytearray(k), None if v is None else bytearray(v), s, d) for k, (v, s, d) in self._memory.items()]
        logs = self._adopted_frames | ({self._log._writer: self._log.frames} if self._log.frames else {})
        self._commit_run(self.spark.createDataFrame(rows, VERSION_SCHEMA).coalesce(1), level=0, remove=(), top=self._seq, logs=logs)
        self._memory.clear()
        self._bytes = 0
        self._log.reset()
        for name in self._adopted:
            self._store.delete_log(name)
        self._adopted, self._adopted_frames = [], {}

    def _commit_run(self, rows: DataFrame, level: int, remove: tuple[str, ...], top, logs: Mapping[str, int] | None = None, streams: Mapping[str, int] | None = None, fixed: bool = False, retries: int = 20) -> dict | None:
        """Write a run and commit it, replacing ``remove``; retried after other writers' commits.

        Its statistics are taken while it is written.  ``top`` is the last sequence number used, or a function
        that gives it (or refuses the rows) once they are written; ``fixed`` numbers aren't moved behind others'.
        """
        name = f"{self._manifest['next_file']:06d}-{uuid.uuid4().hex[:12]}"
        path = self._store.run_path(name)
        seen = Observation()
        stats = (F.min("key").alias("low"), F.max("key").alias("high"), F.max("seq").alias("seq"), F.count("*").alias("n"), F.count(F.when(F.col("deleted"), 1)).alias("dead"))
        rows.sortWithinPartitions("key", F.col("seq").desc()).observe(seen, *stats).write.parquet(path)
        found = seen.get
        try:
            top = top() if callable(top) else top
        except Invalid:
            self._store.delete_run(name)
            raise
        if top is None:  # no rows
            top = self._recovered_seq()
        meta = None
        if found["n"]:
            meta = {
                "name": name, "level": level, "min_key": bytes(found["low"]), "max_key": bytes(found["high"]), "max_seq": found["seq"],
                "entries": found["n"], "file_size": self._store.size_of(name),
            }
        else:
            self._store.delete_run(name)
        for _ in range(retries):
            m = self._manifest
            gone = set(remove)
            if not gone <= {f["name"] for f in m["files"]}:
                self._store.delete_run(name)
                raise Conflict("another writer has compacted these runs")
            files = [f for f in m["files"] if f["name"] not in gone] + ([meta] if meta else [])
            new = m | {"files": files, "next_file": m["next_file"] + 1, "log_seq": max(m["log_seq"], top), "logs": m["logs"] | dict(logs or {}), "streams": m["streams"] | dict(streams or {})}
            try:
                self._number = self._store.commit(self._number, new)
            except Conflict:
                before = self._recovered_seq()
                self._number, self._manifest = self._store.read_manifest()
                if not remove and not fixed and self._recovered_seq() > before:
                    # others have used our numbers: this run's must come after theirs
                    self._store.delete_run(name)
                    shift = self._recovered_seq() - before
                    self._seq = max(self._seq, top) + shift
                    return self._commit_run(rows.withColumn("seq", F.col("seq") + shift), level, remove, top + shift, logs, streams, fixed, retries - 1)
                continue
            self._manifest = new
            self._seq = max(self._seq, top)
            self._last_dead = found["dead"]
            return meta
        self._store.delete_run(name)
        raise Conflict("too many writers")

    # reads

    def versions(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """The version log, buffer included: ``key, value, seq, deleted, src``.

        Runs whose keys lie outside ``[low, high)`` aren't opened: they hold no version of a key inside.
        """
        self._check()
        names = [
            f["name"] for f in self._manifest["files"]
            if not (low is not None and f["max_key"] < low) and not (high is not None and f["min_key"] >= high)
        ]
        held = [(bytearray(k), None if v is None else bytearray(v), s, d) for k, (v, s, d) in self._memory.items()]
        parts = []
        if names:
            runs = self.spark.read.schema(VERSION_SCHEMA).parquet(*(self._store.run_path(n) for n in names))
            parts.append(runs.select("*", F.col("_metadata.file_path").alias("src")))
        if held or not parts:
            parts.append(self.spark.createDataFrame(held, VERSION_SCHEMA).withColumn("src", F.lit("")))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _bounded(self, low: bytes | None, high: bytes | None) -> DataFrame:
        from ..functions.bytesx import in_range

        return self.versions(low, high).filter(in_range("key", low, high))

    def find(self, key: bytes) -> DataFrame:
        """The live version of a key as a DataFrame of one row or none."""
        key = bytes(key)
        return visible(self._bounded(key, key + b"\x00"), src="src").select("key", "value", "seq")

    def get(self, key: bytes) -> bytes:
        """The value of a key; raises ``NotFound``."""
        self._check()
        held = self._memory.get(bytes(key))
        if held:
            if held[2]:
                raise NotFound(repr(key))
            return bytes(held[0] or b"")
        row = self.find(key).first()
        if row is None:
            raise NotFound(repr(key))
        return bytes(row.value or b"")

    def has(self, key: bytes) -> bool:
        try:
            self.get(key)
        except NotFound:
            return False
        return True

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return scan.multi_get(self.versions(), keys, src="src").select("key", "value", "seq")

    def has_many(self, keys: DataFrame) -> DataFrame:
        return scan.has_many(self.versions(), keys, src="src")

    def scan(self) -> DataFrame:
        return scan.scan(self.versions(), src="src").select("key", "value", "seq")

    def snapshot(self) -> DataFrame:
        """The newest version of every key, tombstones included."""
        return scan.snapshot(self.versions(), src="src").select("key", "value", "seq", "deleted")

    def seek(self, target: bytes, limit: int | None = None) -> DataFrame:
        out = visible(self._bounded(bytes(target), None), src="src").select("key", "value", "seq").orderBy("key")
        return out if limit is None else out.limit(limit)

    def key_range(self, low: bytes | None = None, high: bytes | None = None, raw: bool = False) -> DataFrame:
        v = self._bounded(low, high)
        return (resolve(v, src="src") if raw else visible(v, src="src")).select("key", "value", "seq", "deleted").orderBy("key")

    def prefix_scan(self, prefix: bytes) -> DataFrame:
        return self.key_range(bytes(prefix) or None, next_prefix(bytes(prefix)))

    def cursor(self, page: int = 1000) -> Cursor:
        self._check()
        return Cursor(self, page)

    # state

    def manifest(self) -> dict:
        self._check()
        return self._manifest | {"files": [dict(f) for f in self._manifest["files"]]}

    def files(self) -> DataFrame:
        self._check()
        return self._store.files_frame(self._manifest)

    def max_seq(self) -> int:
        return self._seq

    def log_frames(self) -> DataFrame:
        """The log as rows in order of writing: ``writer, frame, ord, key, value, deleted`` of mutations that no run holds."""
        self._check()
        rows = [
            (w, f.number, i, bytearray(k), None if v is None else bytearray(v), d) for w, f in replay(self._store, self._manifest["logs"])[0] for i, (k, v, d) in enumerate(f.ops)
        ]
        return self.spark.createDataFrame(rows, LOG_SCHEMA)

    def stats(self) -> DataFrame:
        """One row: bytes and keys in the buffer, number of runs, bytes in this writer's log."""
        self._check()
        row = (self._bytes, len(self._memory), len(self._manifest["files"]), self._log.size)
        return self.spark.createDataFrame([row], STATS_SCHEMA)

    def approximate_bytes(self) -> DataFrame:
        """One row: what all newest versions count towards a flush."""
        return resolve(self.versions(), src="src").agg(F.coalesce(F.sum(entry_bytes()), F.lit(0)).alias("bytes"))

    # compaction

    def compact(self, drop_tombstones: bool = False) -> dict | None:
        """Merge runs of level 0 (or the first two) into one of level 1; None if there is too little to do.

        Tombstones stay unless ``drop_tombstones``, which needs every run to be an input.
        """
        self._check(write=True)
        files = self._manifest["files"]
        if len(files) < self.options.compact_threshold:
            return None
        inputs = compaction.plan(files)
        if drop_tombstones:
            inputs = list(files)
        if not inputs:
            return None
        read = self.spark.read.schema(VERSION_SCHEMA).parquet(*(self._store.run_path(f["name"]) for f in inputs))
        versions = read.select("*", F.col("_metadata.file_path").alias("src"))
        # dealt by key range first: that is one exchange for the merge and for the files' key ranges.  No key is
        # hot here, as a run holds one version of it
        parts = max(1, -(-sum(f["file_size"] for f in inputs) // TARGET_FILE_BYTES))
        merged = resolve(versions.repartitionByRange(parts, "key"), src="src").drop("src")
        if drop_tombstones:
            merged = merged.filter(~F.col("deleted"))
        removed = tuple(f["name"] for f in inputs)
        meta = self._commit_run(merged, level=1, remove=removed, top=max(f["max_seq"] for f in inputs))
        dropped = sum(f["entries"] for f in inputs) - (meta["entries"] if meta else 0)
        return {"output": meta, "removed": list(removed), "kept_tombstones": self._last_dead, "dropped_obsolete": dropped}

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete runs that the newest ``keep`` manifests don't name, and older manifests.  No other writer may be at work."""
        self._check(write=True)
        numbers = self._store.versions()
        kept = numbers[-max(1, keep) :]
        named = {f["name"] for n in kept for f in self._store.read_manifest(n)[1]["files"]}
        gone = [n for n in self._store.runs() if n not in named]
        for n in gone:
            self._store.delete_run(n)
        for n in numbers:
            if n not in kept:
                self._store.delete_manifest(n)
        for n in self._store.logs():  # segments whose frames a run holds, left by a writer that stopped before it deleted them
            if n not in self._log._names and not any(w == n.rsplit("-", 1)[0] for w, _ in replay(self._store, self._manifest["logs"])[0]):
                self._store.delete_log(n)
        return gone

    def close(self) -> None:
        """Flush what is buffered; a second close does nothing."""
        if self._closed:
            return
        if not self.options.read_only:
            self.flush()
        self._closed = True
