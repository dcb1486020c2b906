"""Named queries over the driver's tables and the SQL that gives the same rows.

``events`` stands for a version log: key ``u<user>/<event type>``, value ``props``, sequence ``event_id``; errors and
values over 300 are tombstones; ``event_id % 4`` is the run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bloom, bytesx, checksum, varint
from ..operators import compaction, resolve, scan
from ..operators.neighbours import with_previous
from ..schema import KeystrataError, Options, SyncPolicy
from ..sources.table import Table, WriteBatch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

KV = """
WITH kv AS (SELECT printf('u%06d/%s', user_id, event_type) AS k, props AS v, event_id AS seq,
                   coalesce(event_type = 'error' OR value > 300, false) AS d, CAST(event_id % 4 AS INT) AS f FROM events),
res AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM kv)
"""
LIVE = "SELECT k, v, seq FROM res WHERE rn = 1 AND NOT d"


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _user_key(user: str, kind: Column) -> Column:
    """``u%06d/<kind>`` without a formatter call per row."""
    digits = F.col(user).cast("string")
    return F.concat(F.lit("u"), F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits), F.lit("/"), kind)


def version_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``k, v, seq, d, f``"""
    return _table(spark, sf_dir, "events").select(
        _user_key("user_id", F.col("event_type")).alias("k"),
        F.col("props").alias("v"),
        F.col("event_id").alias("seq"),
        F.coalesce((F.col("event_type") == "error") | (F.col("value") > 300), F.lit(False)).alias("d"),
        (F.col("event_id") % 4).cast("int").alias("f"),
    )


HOW = {"seq": "seq", "deleted": "d"}
RAW = {"seq": "seq"}
OUT = ("k", "v", "seq")


@query(KV + LIVE)
def q_live(spark, d):
    return resolve.visible(version_log(spark, d), key="k", **HOW).select(*OUT)


@query(KV + "SELECT k, v, seq, d FROM res WHERE rn = 1")
def q_raw_snapshot(spark, d):
    return resolve.resolve(version_log(spark, d), key="k", **RAW).select(*OUT, "d")


@query(KV + LIVE + " AND k = 'u000012/click'")
def q_get(spark, d):
    return scan.get(version_log(spark, d), "u000012/click", "k", **HOW).select(*OUT)


@query(KV + "SELECT k, v, seq, d FROM res WHERE rn = 1 AND k = 'u000012/error'")
def q_get_raw(spark, d):
    return scan.get_raw(version_log(spark, d), "u000012/error", "k", **RAW).select(*OUT, "d")


@query(KV + ", c AS (SELECT c_custkey, printf('u%06d/click', c_custkey) AS k FROM customer) SELECT c.c_custkey, c.k, l.k IS NOT NULL AS found FROM c LEFT JOIN (" + LIVE + ") AS l ON c.k = l.k")
def q_has_many(spark, d):
    keys = _table(spark, d, "customer").select("c_custkey", _user_key("c_custkey", F.lit("click")).alias("k"))
    return scan.has_many(version_log(spark, d), keys, "k", **HOW)


@query(KV + LIVE + " AND k IN (SELECT printf('u%06d/view', c_custkey) FROM customer)")
def q_multi_get_all(spark, d):
    """The keys of all customers at once."""
    keys = _table(spark, d, "customer").select(_user_key("c_custkey", F.lit("view")).alias("k"))
    return scan.multi_get(version_log(spark, d), keys, "k", **HOW).select(*OUT)


@query(KV + LIVE + " AND k >= 'u000050' ORDER BY k LIMIT 10")
def q_seek(spark, d):
    return scan.seek(version_log(spark, d), "u000050", 10, "k", **HOW).select(*OUT)


@query(KV + "SELECT k, v, seq, d FROM res WHERE rn = 1 AND k >= 'u000010' AND k < 'u000020'")
def q_range(spark, d):
    return scan.key_range(version_log(spark, d), "u000010", "u000020", name="k", **RAW).select(*OUT, "d")


@query(KV + LIVE + " AND starts_with(k, 'u00000')")
def q_prefix(spark, d):
    return scan.prefix_scan(version_log(spark, d), "u00000", "k", **HOW).select(*OUT)


@query(KV + LIVE + " AND starts_with(k, 'u0001')")
def q_binary_prefix(spark, d):
    log = version_log(spark, d).withColumn("k", F.col("k").cast("binary"))
    return scan.prefix_scan(log, b"u0001", "k", **HOW).select(F.col("k").cast("string").alias("k"), "v", "seq")


@query(KV + "SELECT coalesce(min(k), '') AS k FROM res WHERE rn = 1 AND NOT d AND k >= 'u0001'")
def q_prefix_seek(spark, d):
    return scan.first_at_or_after(resolve.visible(version_log(spark, d), key="k", **HOW), "u0001", "k")


@query("SELECT coalesce(min(url), '') AS url FROM pages WHERE url >= 'zzz'")
def q_prefix_seek_past_end(spark, d):
    return scan.first_at_or_after(_table(spark, d, "pages"), "zzz", "url")


@query("SELECT page_id, url FROM pages WHERE starts_with(url, 'https://m.')")
def q_url_prefix(spark, d):
    return _table(spark, d, "pages").select("page_id", "url").filter(bytesx.has_prefix("url", "https://m."))


@query("SELECT page_id, url FROM pages WHERE url >= 'https://m.' AND url < 'https://m/'")
def q_url_range(spark, d):
    return _table(spark, d, "pages").select("page_id", "url").filter(bytesx.in_range("url", "https://m.", "https://m/"))


@query("SELECT url FROM pages WHERE url >= 'https://c' ORDER BY url LIMIT 5")
def q_url_seek(spark, d):
    return _table(spark, d, "pages").select("url").filter(F.col("url") >= "https://c").orderBy("url").limit(5)


@query(KV + "SELECT count(*) AS n_live, count(*) FILTER (v IS NULL) AS n_null FROM res WHERE rn = 1 AND NOT d")
def q_tombstone_order(spark, d):
    return resolve.visible(version_log(spark, d), key="k", **HOW).agg(F.count("*").alias("n_live"), F.count(F.when(F.col("v").isNull(), 1)).alias("n_null"))


@query(KV + "SELECT CAST(sum(CASE WHEN rn = 1 AND d THEN 1 ELSE 0 END) AS BIGINT) AS kept_tombstones, CAST(sum(CASE WHEN rn > 1 THEN 1 ELSE 0 END) AS BIGINT) AS dropped_obsolete FROM res")
def q_merge_metrics(spark, d):
    return resolve.merge_metrics(version_log(spark, d), key="k", **HOW)


@query(KV + "SELECT CAST(0 AS BIGINT) AS kept_tombstones, CAST(sum(CASE WHEN rn > 1 OR d THEN 1 ELSE 0 END) AS BIGINT) AS dropped_obsolete FROM res")
def q_drop_tombstones(spark, d):
    return resolve.merge_metrics(version_log(spark, d), drop_tombstones=True, key="k", **HOW)


@query(KV + "SELECT f AS run, min(k) AS min_key, max(k) AS max_key, max(seq) AS max_seq, count(*) AS entries FROM kv GROUP BY f")
def q_run_stats(spark, d):
    return compaction.run_stats(version_log(spark, d).withColumnRenamed("f", "run"), key="k")


def _files(spark, d):
    n = version_log(spark, d).groupBy("f").agg(F.count("*").alias("file_size"))
    return n.select(F.concat(F.lit("run-"), F.col("f")).alias("name"), F.when(F.col("f") < 3, 0).otherwise(1).alias("level"), "file_size")


FILES = KV + ", files AS (SELECT 'run-' || f AS name, CASE WHEN f < 3 THEN 0 ELSE 1 END AS level, count(*) AS file_size FROM kv GROUP BY f) "


@query(FILES + "SELECT name, level, file_size FROM files WHERE level = 0 AND (SELECT count(*) FROM files WHERE level = 0) >= 2")
def q_l0_plan(spark, d):
    return compaction.plan_level0_frame(_files(spark, d), 2)


@query(FILES + "SELECT name, level, file_size FROM (SELECT name, 1 - level AS level, file_size, row_number() OVER (ORDER BY name) AS r FROM files) WHERE r <= 2")
def q_fallback_plan(spark, d):
    """With one run of level 0 only: the first two runs are merged."""
    return compaction.plan_frame(_files(spark, d).withColumn("level", (1 - F.col("level")).cast("int")))


@query(FILES + "SELECT name, level, file_size FROM files ORDER BY file_size, name LIMIT 2")
def q_pick_smallest(spark, d):
    return compaction.pick_by_size(_files(spark, d), 2)


@query(KV + "SELECT k, v, seq, d FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC, f) AS r FROM kv WHERE f IN (0, 1)) WHERE r = 1")
def q_two_run_merge(spark, d):
    log = version_log(spark, d)
    return resolve.merge([log.filter("f = 0"), log.filter("f = 1")], key="k", **HOW).select(*OUT, "d")


@query("SELECT CAST(coalesce(sum(CASE WHEN p > url THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_unsorted FROM (SELECT url, lag(url) OVER (ORDER BY page_id) AS p FROM pages)")
def q_sorted_check(spark, d):
    return compaction.unsorted_pairs(_table(spark, d, "pages"), "url", "page_id")


@query(KV + "SELECT CAST(sum(octet_length(encode(k)) + CASE WHEN d OR v IS NULL THEN 0 ELSE octet_length(encode(v)) END + 16) AS BIGINT) AS bytes FROM res WHERE rn = 1")
def q_memtable_bytes(spark, d):
    won = resolve.resolve(version_log(spark, d), key="k", **RAW)
    return won.agg(F.sum(bytesx.entry_bytes("k", F.when(~F.col("d"), F.col("v")))).alias("bytes"))


@query(KV + "SELECT coalesce(max(seq), 0) AS max_seq, count(DISTINCT k) AS n_keys FROM kv")
def q_counts(spark, d):
    return version_log(spark, d).groupBy("k").agg(F.max("seq").alias("s")).agg(F.coalesce(F.max("s"), F.lit(0)).alias("max_seq"), F.count("*").alias("n_keys"))


@query(KV + "SELECT k, v, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM kv WHERE seq <= 5000) WHERE r = 1 AND NOT d")
def q_asof_seq(spark, d):
    return resolve.as_of(version_log(spark, d), 5000, key="k", **HOW).select(*OUT)


@query("SELECT conv_id, role, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def q_batch_last_wins(spark, d):
    return resolve.resolve(_table(spark, d, "conversations"), key=["conv_id", "role"], seq="turn").select("conv_id", "role", "turn", "text")


@query("SELECT c_custkey, CASE WHEN x >= 0 THEN 2 * x ELSE -2 * x - 1 END AS zz, x AS back FROM (SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS x FROM customer)")
def q_zigzag(spark, d):
    x = F.floor("c_acctbal").cast("long")
    return _table(spark, d, "customer").select("c_custkey", varint.zigzag(x).alias("zz"), varint.unzigzag(varint.zigzag(x)).alias("back"))


SIZE = "CASE " + " ".join(f"WHEN {{x}} < {1 << 7 * n} THEN {n}" for n in range(1, 9)) + " ELSE 9 END"


@query("SELECT o_orderkey, CAST(" + SIZE.format(x="x") + " AS INT) AS size FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 37 AS x FROM orders)")
def q_varint_size(spark, d):
    x = F.col("o_orderkey") * F.col("o_orderkey") * 37
    return _table(spark, d, "orders").select("o_orderkey", varint.size(x).alias("size"))


@query("SELECT o_orderkey, o_orderkey * 1000003 AS decoded, CAST(" + SIZE.format(x="o_orderkey * 1000003") + " AS INT) AS n_bytes FROM orders")
def q_varint_codec(spark, d):
    coded = _table(spark, d, "orders").select("o_orderkey", varint.encode(F.col("o_orderkey") * 1000003).alias("b"))
    return coded.select("o_orderkey", varint.decode("b").alias("decoded"), varint.encoded_length("b").alias("n_bytes"))


@query(
    "SELECT page_id, CAST(CASE WHEN p IS NULL THEN 0 ELSE coalesce(list_min(list_filter(range(1, least(length(p), length(url)) + 1), lambda i: p[i] <> url[i])) - 1, least(length(p), length(url))) END AS INT) AS shared"
    " FROM (SELECT page_id, url, lag(url) OVER (ORDER BY url, page_id) AS p FROM pages)"
)
def q_shared_prefix(spark, d):
    pages = _table(spark, d, "pages").select("page_id", "url")
    return with_previous(pages, "url", ["url", "page_id"], "p").select("page_id", F.coalesce(bytesx.shared_prefix_length(F.col("p").cast("binary"), F.col("url").cast("binary")), F.lit(0)).alias("shared"))


@query("SELECT page_id, hex(encode(url)) || '00' AS successor FROM pages")
def q_key_successor(spark, d):
    return _table(spark, d, "pages").select("page_id", F.hex(bytesx.key_successor(F.col("url").cast("binary"))).alias("successor"))


@query("SELECT n_nationkey, least(n_name, r_name) AS low, greatest(n_name, r_name) AS high, CASE WHEN n_name < r_name THEN -1 WHEN n_name > r_name THEN 1 ELSE 0 END AS cmp FROM nation JOIN region ON n_regionkey = r_regionkey")
def q_min_max_compare(spark, d):
    both = _table(spark, d, "nation").join(_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    a, b = F.col("n_name").cast("binary"), F.col("r_name").cast("binary")
    return both.select("n_nationkey", bytesx.min_bytes(a, b).cast("string").alias("low"), bytesx.max_bytes(a, b).cast("string").alias("high"), bytesx.compare(a, b).alias("cmp"))


@query("SELECT doc_id, lang, regexp_full_match(text, '[\\x00-\\x7F]*') AS ascii, true AS utf8, starts_with(text, 'Th') AS th, ends_with(text, '.') AS dot FROM documents")
def q_byte_tests(spark, d):
    t = F.col("text").cast("binary")
    return _table(spark, d, "documents").select(
        "doc_id", "lang", bytesx.is_ascii(t).alias("ascii"), bytesx.is_valid_utf8(t).alias("utf8"), bytesx.has_prefix(t, b"Th").alias("th"), bytesx.has_suffix(t, b".").alias("dot")
    )


@query("SELECT c_custkey, CAST(8 + octet_length(encode(c_name)) + octet_length(encode(c_mktsegment)) AS BIGINT) AS size FROM customer")
def q_serialized_size(spark, d):
    return _table(spark, d, "customer").select("c_custkey", bytesx.serialized_size(F.col("c_name").cast("binary"), F.col("c_mktsegment").cast("binary")).alias("size"))


@query("SELECT o_orderkey, lpad(hex(o_orderkey), 16, '0') AS be64, o_orderkey AS back FROM orders")
def q_fixed_width(spark, d):
    x = F.col("o_orderkey")
    return _table(spark, d, "orders").select(
        "o_orderkey", F.hex(bytesx.encode_fixed(x, 64, little=False)).alias("be64"), bytesx.decode_fixed(bytesx.encode_fixed(x, 64), 64).alias("back")
    )


@query("SELECT n_nationkey, hex(encode(n_name)) || repeat('00', greatest(0, 12 - octet_length(encode(n_name)))) AS padded, n_name AS trimmed, substr(n_name, 1, 3) AS head FROM nation")
def q_pad_trim(spark, d):
    b = bytesx.pad_right(F.col("n_name").cast("binary"), 12)
    return _table(spark, d, "nation").select(
        "n_nationkey", F.hex(b).alias("padded"), bytesx.trim_right_zeros(b).cast("string").alias("trimmed"), bytesx.first_bytes(F.col("n_name").cast("binary"), 3).cast("string").alias("head")
    )


@query("SELECT lang, count(*) AS n, CAST(ceil(greatest(64.0::double, -count(*) * ln(0.01::double) / (ln(2.0::double) * ln(2.0::double)))) AS BIGINT) AS bits FROM documents GROUP BY lang")
def q_bloom_bits(spark, d):
    n = _table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return n.select("lang", "n", bloom.optimal_bits("n").alias("bits"))


@query(
    "WITH b AS (SELECT lang, count(*) AS n, ceil(greatest(64.0::double, -count(*) * ln(0.01::double) / (ln(2.0::double) * ln(2.0::double)))) AS m FROM documents GROUP BY lang),"
    " k AS (SELECT *, CAST(floor(least(greatest(m / n * ln(2.0::double), 1), 30) + 0.5) AS INT) AS hashes FROM b)"
    " SELECT lang, hashes, round(pow(1 - exp(-hashes * n / m), hashes), 9) AS fp FROM k"
)
def q_bloom_fp(spark, d):
    n = _table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).withColumn("m", bloom.optimal_bits("n"))
    k = n.withColumn("hashes", bloom.optimal_hashes("m", "n"))
    return k.select("lang", "hashes", F.round(bloom.estimated_fp("m", "hashes", "n"), 9).alias("fp"))


def _crc_sql(blob: str, poly: int) -> tuple[str, str]:
    """CRC-32 over a blob for a reversed polynomial, and the CTE ``crc_<poly>`` to join: a table by shifts, then a byte at a time."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, " + str(poly) + "::ubigint) ELSE c >> 1 END"
    table = f"list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b::ubigint, list_transform(range(0, 8), lambda i: 0::ubigint)), lambda c, i: {step}))"
    digits = f"hex({blob})"
    octets = f"list_transform(range(0, CAST(length({digits}) // 2 AS BIGINT)), lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::ubigint)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(t_{poly}[CAST(xor(c, b) & 255 AS BIGINT) + 1], c >> 8), 4294967295::ubigint), 4294967295::ubigint)", f"crc_{poly} AS MATERIALIZED (SELECT {table} AS t_{poly})"


U64 = "18446744073709551615::uhugeint"


def _mix_sql(z: str, name: str) -> str:
    """CTE steps of the 64-bit mixing of ``z``; the result is column ``name``."""
    a = f"(xor({z}, {z} >> 30) * {bloom.MIX_A}::uhugeint) & {U64}"
    b = f"(xor(x1, x1 >> 27) * {bloom.MIX_B}::uhugeint) & {U64}"
    return f"SELECT * EXCLUDE (x1, x2), xor(x2, x2 >> 31) AS {name} FROM (SELECT *, {b} AS x2 FROM (SELECT *, {a} AS x1 FROM {{}}))"


def _positions_sql(source: str, key: str, bits: int, hashes: int, more: str = "") -> str:
    """CTEs up to ``pos``: every column of ``source`` and ``places``, the positions that its key sets."""
    c, c_table = _crc_sql("key", checksum.CASTAGNOLI)
    i, i_table = _crc_sql("key", checksum.IEEE)
    return f"""
{c_table}, {i_table},
k0 AS (SELECT *, encode({key}) AS key FROM ({source})),
k1 AS (SELECT * REPLACE (CASE WHEN b0 = 0 THEN {bloom.GOLDEN}::uhugeint ELSE b0 END AS b0), xor(c0, (octet_length(key)::uhugeint * {bloom.GOLDEN}::uhugeint) & {U64}) AS z0
       FROM (SELECT *, {c}::uhugeint AS c0, {i}::uhugeint AS b0 FROM k0, crc_{checksum.CASTAGNOLI}, crc_{checksum.IEEE})),
k2 AS ({_mix_sql("z0", "h1").format("k1")}),
k3 AS ({_mix_sql("z1", "h2").format("(SELECT *, xor(b0, h1) AS z1 FROM k2)")}),
pos AS (SELECT * EXCLUDE (c0, b0, z0, z1, h1, h2, t_{checksum.CASTAGNOLI}, t_{checksum.IEEE}), list_transform(range(0, {hashes}), lambda i: CAST(((h1 + i::uhugeint * h2) & {U64}) % {bits} AS BIGINT)) AS places FROM k3)
"""


@query("WITH " + _positions_sql("SELECT c_custkey, c_name FROM customer", "c_name", 8191, 5) + "SELECT c_custkey, array_to_string(places, ',') AS positions FROM pos")
def q_bloom_positions(spark, d):
    """The bits that each customer's name sets."""
    at = bloom.bit_positions(F.col("c_name"), 8191, 5)
    return _table(spark, d, "customer").select("c_custkey", F.concat_ws(",", F.transform(at, lambda x: x.cast("string"))).alias("positions"))


#: A small filter of the odd customers, so that some even ones are found by chance.
PROBED = "WITH " + _positions_sql("SELECT c_custkey, c_name FROM customer", "c_name", 4093, 3) + ", bits AS (SELECT DISTINCT unnest(places) AS bit FROM pos WHERE c_custkey % 2 = 1), one AS (SELECT list(bit) AS bits FROM bits) "


@query(PROBED + "SELECT c_custkey, coalesce(list_has_all((SELECT bits FROM one), places), false) AS found FROM pos")
def q_bloom_probe(spark, d):
    """Every customer probed in a filter over those with odd numbers, false positives included."""
    keys = _table(spark, d, "customer").select("c_custkey", F.col("c_name").cast("binary").alias("key"))
    f = bloom.build(keys.filter("c_custkey % 2 = 1"), bits=4093, hashes=3).first()
    return keys.select("c_custkey", bloom.may_contain("key", 4093, 3, bytes(f["filter"])).alias("found"))


@query("SELECT count(*) AS n_added, count(*) AS n_found FROM customer")
def q_bloom_filter(spark, d):
    """A filter over customer names holds every one of them."""
    keys = _table(spark, d, "customer").select(F.col("c_name").cast("binary").alias("key"))
    bits, hashes = bloom.sizing(keys.count())
    f = bloom.build(keys, bits=bits, hashes=hashes).first()
    return keys.agg(F.lit(f.n_added).alias("n_added"), F.count(F.when(bloom.may_contain("key", bits, hashes, bytes(f["filter"])), 1)).alias("n_found"))


MERGED = "WITH " + _positions_sql("SELECT lang, doc_id::varchar AS id FROM documents WHERE doc_id IS NOT NULL", "id", 4096, 3)


@query(MERGED + "SELECT CAST(4096 AS BIGINT) AS bits, CAST(3 AS INT) AS hashes, (SELECT count(*) FROM pos) AS n_added, round((SELECT count(DISTINCT bit) FROM (SELECT unnest(places) AS bit FROM pos)) / 4096.0::double, 6) AS fill")
def q_bloom_merge(spark, d):
    """Filters per language (null is one) joined by or: bits, and how full the whole is."""
    docs = _table(spark, d, "documents").select("lang", F.col("doc_id").cast("string").cast("binary").alias("key"))
    none = bloom.build(docs.limit(0), bits=4096, hashes=3)  # a row where there are no documents
    parts = bloom.build_each(docs, "lang", bits=4096, hashes=3).drop("lang").unionByName(none)
    return bloom.merge(parts).select("bits", "hashes", "n_added", F.round(bloom.fill_ratio("filter", "bits"), 6).alias("fill"))


@query(MERGED + "SELECT lang, n AS n_added, round(ones / 4096.0::double, 6) AS fill FROM (SELECT lang, count(DISTINCT id) AS n0, count(DISTINCT bit) AS ones, count(*) // 3 AS n FROM (SELECT lang, id, unnest(places) AS bit FROM pos) GROUP BY lang)")
def q_bloom_fill(spark, d):
    """A filter per language and its share of set bits."""
    docs = _table(spark, d, "documents").filter("doc_id IS NOT NULL").select("lang", F.col("doc_id").cast("string").cast("binary").alias("key"))
    return bloom.build_each(docs, "lang", bits=4096, hashes=3).select("lang", "n_added", F.round(bloom.fill_ratio("filter", "bits"), 6).alias("fill"))


_CRC = {poly: _crc_sql("encode(url)", poly) for poly in (checksum.IEEE, checksum.CASTAGNOLI, checksum.KOOPMAN)}


@query(
    "WITH " + ", ".join(t for _, t in _CRC.values())
    + " SELECT page_id, " + ", ".join(f"CAST({x} AS BIGINT) AS {n}" for n, (x, _) in zip(("ieee", "castagnoli", "koopman"), _CRC.values())) + " FROM pages, " + ", ".join(f"crc_{p}" for p in _CRC)
)
def q_checksums(spark, d):
    u = F.col("url").cast("binary")
    return _table(spark, d, "pages").select("page_id", checksum.crc32(u).alias("ieee"), checksum.crc32c(u).alias("castagnoli"), checksum.crc32_koopman(u).alias("koopman"))


_FRAME = _crc_sql("unhex('03') || encode(url)", checksum.CASTAGNOLI), _crc_sql("encode(url) || encode('!')", checksum.CASTAGNOLI)


@query(f"WITH {_FRAME[0][1]} SELECT page_id, CAST({_FRAME[0][0]} AS BIGINT) AS frame, CAST({_FRAME[1][0]} AS BIGINT) AS parts, true AS sound, false AS broken FROM pages, crc_{checksum.CASTAGNOLI}")
def q_frame_checksums(spark, d):
    """CRC-32C over a type byte and its payload, over parts, and at the end of a value."""
    u = F.col("url").cast("binary")
    sealed = checksum.with_trailing_crc(u)
    return _table(spark, d, "pages").select(
        "page_id", checksum.frame_crc(F.lit(3), u).alias("frame"), checksum.multipart_crc(u, F.lit(b"!")).alias("parts"),
        checksum.trailing_crc_ok(sealed).alias("sound"), checksum.trailing_crc_ok(F.concat(F.lit(b"x"), sealed)).alias("broken"),
    )


@query("SELECT o_orderkey, CASE WHEN x < y THEN -1 WHEN x > y THEN 1 ELSE 0 END AS cmp FROM (SELECT o_orderkey, o_orderkey * 1009 AS x, o_custkey * 40009 AS y FROM orders)")
def q_varint_compare(spark, d):
    x, y = varint.encode(F.col("o_orderkey") * 1009), varint.encode(F.col("o_custkey") * 40009)
    return _table(spark, d, "orders").select("o_orderkey", varint.compare_encoded(x, y).alias("cmp"))


@query(
    "SELECT n_nationkey, array_to_string(list_transform(range(0, CAST(least(length(a), length(b)) // 2 AS BIGINT)), lambda i: printf('%02X', CAST(xor(('0x' || substr(a, 2 * i + 1, 2))::ubigint, ('0x' || substr(b, 2 * i + 1, 2))::ubigint) AS INT))), '') AS x,"
    " 'ABABAB' AS filled FROM (SELECT n_nationkey, hex(encode(n_name)) AS a, hex(encode(r_name)) AS b FROM nation JOIN region ON n_regionkey = r_regionkey)"
)
def q_xor_fill(spark, d):
    both = _table(spark, d, "nation").join(_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_nationkey", F.hex(bytesx.xor_bytes(F.col("n_name").cast("binary"), F.col("r_name").cast("binary"))).alias("x"), F.hex(bytesx.filled(3, 0xAB)).alias("filled"))


@query("SELECT o_orderkey, ((((c >> 15) | ((c << 17) & 4294967295)) + 2726488792) & 4294967295) AS masked, c AS back FROM (SELECT o_orderkey, (o_orderkey * 2654435761) & 4294967295 AS c FROM orders)")
def q_crc_mask(spark, d):
    c = (F.col("o_orderkey") * 2654435761).bitwiseAND(0xFFFFFFFF)
    return _table(spark, d, "orders").select("o_orderkey", checksum.mask(c).alias("masked"), checksum.unmask(checksum.mask(c)).alias("back"))


def _scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; it goes when the session's JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/keystrata-table-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def _loaded(spark: SparkSession, d: str) -> tuple[Table, int]:
    """The log as a table of four runs of consecutive versions, and its first sequence number."""
    t = Table.open(spark, _scratch(spark), Options(compact_threshold=2))
    log = version_log(spark, d)
    first, last = log.agg(F.min("seq"), F.max("seq")).first()
    step = (last - first) // 4 + 1
    for low in range(first, last + 1, step):
        part = log.filter((F.col("seq") >= low) & (F.col("seq") < low + step))
        t.write_frame(part.select(F.col("k").cast("binary").alias("key"), F.col("v").cast("binary").alias("value"), F.col("d").alias("deleted"), (F.col("seq") - low).alias("ord")))
    return t, first


@query(KV + LIVE)
def q_table_compacted(spark, d):
    """The log written to a table as four runs of consecutive versions, compacted, read back."""
    t, first = _loaded(spark, d)
    t.compact()
    # sequence numbers of a table begin at 1
    return t.scan().select(F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"), (F.col("seq") - 1 + first).alias("seq"))


#: The four runs of ``q_table_compacted``: consecutive versions, one row a key, sequence numbers from 1.
RUNS = KV + """, b AS (SELECT min(seq) AS first, (max(seq) - min(seq)) // 4 + 1 AS step FROM kv),
parts AS (SELECT *, (seq - first) // step AS part, seq - first + 1 AS s FROM kv, b),
runs AS (SELECT part, min(k) AS min_key, max(k) AS max_key, max(s) AS max_seq, count(*) AS entries
         FROM (SELECT *, row_number() OVER (PARTITION BY part, k ORDER BY seq DESC) AS r FROM parts) WHERE r = 1 GROUP BY part)
"""


@query(RUNS + "SELECT CAST(part AS BIGINT) AS part, CAST(0 AS INT) AS level, min_key, max_key, max_seq, entries, true AS has_bytes FROM runs")
def q_manifest_files(spark, d):
    """What the manifest says of each run."""
    t, _ = _loaded(spark, d)
    return t.files().select(
        (F.substring("name", 1, 6).cast("long") - 1).alias("part"), "level", F.col("min_key").cast("string").alias("min_key"), F.col("max_key").cast("string").alias("max_key"),
        "max_seq", "entries", (F.col("file_size") > 0).alias("has_bytes"),
    )


@query(RUNS + "SELECT coalesce(max(max_seq), 0) AS max_seq, count(*) AS n_files, coalesce(max(max_seq), 0) AS recovered FROM runs")
def q_manifest_max_seq(spark, d):
    """The greatest sequence number over files, and what a table opened anew goes on from."""
    t, _ = _loaded(spark, d)
    again = Table.open(spark, t.root)
    return t.files().agg(F.coalesce(F.max("max_seq"), F.lit(0)).alias("max_seq"), F.count("*").alias("n_files")).withColumn("recovered", F.lit(again.max_seq()).cast("long"))


@query(KV + "SELECT k, v, seq, d FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM kv, (SELECT min(seq) AS first, (max(seq) - min(seq)) // 4 + 1 AS step FROM kv) WHERE seq < first + 2 * step) WHERE r = 1")
def q_table_as_of(spark, d):
    """The table's versions up to the end of its second run."""
    t, first = _loaded(spark, d)
    top = t.files().filter(F.substring("name", 1, 6) <= "000002").agg(F.max("max_seq")).first()[0]
    won = resolve.resolve(t.versions().filter(F.col("seq") <= top), src="src")
    return won.select(F.col("key").cast("string").alias("k"), F.when(~F.col("deleted"), F.col("value").cast("string")).alias("v0"), "seq", "deleted").join(
        version_log(spark, d).select((F.col("seq") - first + 1).alias("s"), F.col("k").alias("k2"), "v"), (F.col("k") == F.col("k2")) & (F.col("seq") == F.col("s"))
    ).select("k", "v", (F.col("seq") - 1 + first).alias("seq"), F.col("deleted").alias("d"))


@query(KV + "SELECT k, CASE WHEN d THEN NULL ELSE coalesce(v, '') END AS v, d, CAST(o + 1 AS BIGINT) AS seq FROM (SELECT *, seq % 7 AS o, row_number() OVER (PARTITION BY k ORDER BY seq % 7 DESC, d, CASE WHEN d THEN NULL ELSE coalesce(v, '') END DESC NULLS LAST) AS r FROM kv) WHERE r = 1")
def q_write_frame_ties(spark, d):
    """A frame with seven orders only: of one key's equals a value beats a tombstone, then the greater value counts."""
    t = Table.open(spark, _scratch(spark))
    log = version_log(spark, d)
    t.write_frame(log.select(F.col("k").cast("binary").alias("key"), F.col("v").cast("binary").alias("value"), F.col("d").alias("deleted"), (F.col("seq") % 7).alias("ord")))
    return t.versions().select(F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"), F.col("deleted").alias("d"), "seq")


#: ``nation`` through the calls of one key at a time: every one put, those of an odd region deleted, key 3 put again.
_NATION = "WITH n AS (SELECT n_name AS k, 'r' || n_regionkey AS v, n_nationkey AS i, n_regionkey % 2 = 1 AS gone FROM nation) "


def _by_calls(spark: SparkSession, d: str, **options) -> tuple[Table, list]:
    t = Table.open(spark, _scratch(spark), Options(**options))
    rows = _table(spark, d, "nation").orderBy("n_nationkey").collect()  # 25 rows at every scale
    for r in rows:
        t.put(r.n_name.encode(), f"r{r.n_regionkey}".encode())
    for r in rows:
        if r.n_regionkey % 2:
            t.delete(r.n_name.encode())
    return t, rows


@query(_NATION + "SELECT k, v FROM n WHERE NOT gone")
def q_put_delete(spark, d):
    """Single puts and deletes, read without a flush."""
    t, _ = _by_calls(spark, d)
    return t.scan().select(F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


@query(_NATION + "SELECT k, v FROM n WHERE NOT gone")
def q_log_replay(spark, d):
    """The same, lost before any flush: the next open replays the log, torn at its end."""
    t, _ = _by_calls(spark, d)
    last = t._store.logs()[-1]
    t._store.write_log(last.replace("-0", "-9", 1), b"\x01\x02\x03\x04\x05")
    return Table.open(spark, t.root).scan().select(F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


@query(_NATION + "SELECT i + 1 AS frame, CAST(0 AS BIGINT) AS ord, k, v, false AS d FROM n UNION ALL SELECT (SELECT count(*) FROM n) + row_number() OVER (ORDER BY i), 0, k, NULL, true FROM n WHERE gone")
def q_log_frames(spark, d):
    t, _ = _by_calls(spark, d)
    return t.log_frames().select("frame", "ord", F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"), F.col("deleted").alias("d"))


@query(_NATION + "SELECT k, CASE WHEN NOT gone THEN v END AS v, gone AS d, CASE WHEN gone THEN (SELECT count(*) FROM n) + row_number() OVER (PARTITION BY gone ORDER BY i) ELSE i + 1 END AS seq, CAST(1 AS BIGINT) AS n_files, CAST(0 AS BIGINT) AS n_logs FROM n")
def q_flush(spark, d):
    """The buffer as a run, tombstones included; then it is empty and the log is gone."""
    t, _ = _by_calls(spark, d)
    t.flush()
    t.flush()  # nothing to do
    run = spark.read.parquet(*(t._store.run_path(f["name"]) for f in t.manifest()["files"]))
    return run.select(
        F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"), F.col("deleted").alias("d"), "seq",
        F.lit(len(t.manifest()["files"])).cast("long").alias("n_files"), F.lit(len(t._store.logs())).cast("long").alias("n_logs"),
    )


@query(
    _NATION + "SELECT CAST(sum(octet_length(encode(k)) + CASE WHEN gone THEN 0 ELSE octet_length(encode(v)) END + 16) AS BIGINT) AS memtable_bytes, count(*) AS memtable_keys, CAST(0 AS BIGINT) AS sst_files,"
    " CAST(sum(28 + 9 + octet_length(encode(k)) + octet_length(encode(v)) + CASE WHEN gone THEN 28 + 9 + octet_length(encode(k)) ELSE 0 END) AS BIGINT) AS wal_size FROM n"
)
def q_table_stats(spark, d):
    """Buffer, runs and log of a table; a frame takes 28 bytes, each of its mutations 9 besides key and value."""
    t, _ = _by_calls(spark, d)
    return t.stats()


@query(_NATION + "SELECT k, CASE WHEN i = 3 THEN 'again' ELSE v END AS v, n_ops, CAST(1 AS BIGINT) AS n_frames FROM n, (SELECT count(*) + count(*) FILTER (gone) + 1 AS n_ops FROM n) WHERE NOT gone OR i = 3")
def q_batch_atomic(spark, d):
    """One batch of puts, deletes and a second put: one frame of the log, in which the last mutation of a key counts."""
    t = Table.open(spark, _scratch(spark))
    rows = _table(spark, d, "nation").orderBy("n_nationkey").collect()
    b = WriteBatch()
    for r in rows:
        b.put(r.n_name.encode(), f"r{r.n_regionkey}".encode())
    for r in rows:
        if r.n_regionkey % 2:
            b.delete(r.n_name.encode())
    b.put(rows[3].n_name.encode(), b"again")
    t.write(b)
    frames = t.log_frames().select("frame").distinct().count()
    return t.scan().select(F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"), F.lit(len(b)).cast("long").alias("n_ops"), F.lit(frames).cast("long").alias("n_frames"))


@query(_NATION + "SELECT p AS policy, CASE p WHEN 'FULL' THEN c WHEN 'BATCH' THEN c // 8 * 8 ELSE 0 END AS before_sync, c AS after_sync FROM (SELECT count(*) + count(*) FILTER (gone) AS c FROM n), (VALUES ('FULL'), ('BATCH'), ('NONE')) AS x(p)")
def q_sync_policy(spark, d):
    """How many frames another opener finds before and after ``sync``, by policy."""
    out = []
    for policy in SyncPolicy:
        t, _ = _by_calls(spark, d, sync_policy=policy, sync_every_n=8)
        before = t.log_frames().count()
        t.sync()
        out.append((policy.name, before, t.log_frames().count()))
    return spark.createDataFrame(out, "policy string, before_sync long, after_sync long")


@query(_NATION + "SELECT row_number() OVER (ORDER BY k) AS place, k, v FROM n WHERE NOT gone")
def q_cursor(spark, d):
    """Live keys one after the other, in pages of four."""
    t, _ = _by_calls(spark, d)
    return spark.createDataFrame([(n, k.decode(), v.decode()) for n, (k, v) in enumerate(t.cursor(page=4), 1)], "place long, k string, v string")


@query("SELECT * FROM (VALUES ('put', 'ReadOnly'), ('delete', 'ReadOnly'), ('write', 'ReadOnly'), ('flush', 'ReadOnly'), ('compact', 'ReadOnly'), ('sync', 'none'), ('empty key', 'Invalid'), ('absent', 'NotFound'), ('closed', 'Closed'), ('closed twice', 'none'), ('no folder', 'Invalid')) AS x(act, error)")
def q_refusals(spark, d):
    """Which error each call raises: on a table opened for reading, with bad arguments, after closing."""
    t, _ = _by_calls(spark, d)
    r = Table.open(spark, t.root, Options(read_only=True))
    c = Table.open(spark, t.root, Options(read_only=True))
    c.close()
    acts = {
        "put": lambda: r.put(b"k", b""), "delete": lambda: r.delete(b"k"), "write": lambda: r.write(WriteBatch().put(b"k", b"")), "flush": r.flush, "compact": r.compact,
        "sync": r.sync, "empty key": lambda: t.put(b"", b""), "absent": lambda: t.get(b"no such key"), "closed": lambda: c.get(b"k"), "closed twice": c.close, "no folder": lambda: Table.open(spark, ""),
    }

    def outcome(act: Callable[[], object]) -> str:
        try:
            act()
        except KeystrataError as e:
            return type(e).__name__
        return "none"

    return spark.createDataFrame([(n, outcome(f)) for n, f in acts.items()], "act string, error string")


@query("SELECT CAST(4194304 AS BIGINT) AS memtable_bytes, 'FULL' AS sync_policy, CAST(32 AS INT) AS sync_every_n, CAST(2 AS INT) AS compact_threshold, false AS read_only, true AS described")
def q_options(spark, d):
    """Options that aren't positive take their defaults; the table says where it lies."""
    root = _scratch(spark)
    o = Options(memtable_bytes=0, sync_every_n=-1, compact_threshold=0).normalized()
    t = Table.open(spark, root, o)
    described = root in repr(t) and t.path_for("x") == f"{root}/x"
    row = (o.memtable_bytes, o.sync_policy.name, o.sync_every_n, o.compact_threshold, o.read_only, described)
    return spark.createDataFrame([row], "memtable_bytes long, sync_policy string, sync_every_n int, compact_threshold int, read_only boolean, described boolean")


@query(_NATION + "SELECT k, CASE WHEN i % 2 = 0 THEN 'b' ELSE 'a' END AS v, CAST(2 AS BIGINT) AS n_files FROM n")
def q_two_writers(spark, d):
    """Two writers of one table without a lock: the manifest's next number goes to one, the other comes behind it."""
    root = _scratch(spark)
    a, b = Table.open(spark, root), Table.open(spark, root)
    for r in _table(spark, d, "nation").orderBy("n_nationkey").collect():
        a.put(r.n_name.encode(), b"a")
        if r.n_nationkey % 2 == 0:
            b.put(r.n_name.encode(), b"b")
    a.flush()
    b.flush()
    t = Table.open(spark, root)
    return t.scan().select(F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"), F.lit(len(t.manifest()["files"])).cast("long").alias("n_files"))
