import binascii

import pytest
from pyspark.sql import functions as F

from keystrata.functions import bloom, bytesx, checksum, varint


def rows(spark, values, kind):
    return spark.createDataFrame([(k, bytearray(v) if isinstance(v, bytes) else v) for k, v in enumerate(values)], f"i int, x {kind}")


def values(df):
    return [bytes(r.y) if isinstance(r.y, bytearray) else r.y for r in df.orderBy("i").collect()]


def encode(x):
    x %= 1 << 64
    out = bytearray()
    while x >= 128:
        out.append(x & 127 | 128)
        x >>= 7
    return bytes(out + bytearray([x]))


LONGS = [0, 1, -1, 127, 128, 16383, 16384, 2**32, 2**35 - 1, 2**56 - 1, 2**56, 2**62, 2**63 - 1, -(2**63), None]


def test_next_prefix():
    assert bytesx.next_prefix(b"a\xff\xff") == b"b" and bytesx.next_prefix(b"\xff") is None and bytesx.next_prefix(b"") is None and bytesx.next_prefix(b"ab") == b"ac"


def test_varints(spark):
    df = rows(spark, LONGS, "long")
    some = [x for x in LONGS if x is not None]
    assert values(df.withColumn("y", varint.encode("x"))) == [encode(x) for x in some] + [None]
    assert values(df.withColumn("y", varint.size("x"))) == [len(encode(x)) for x in some] + [None]
    assert values(df.withColumn("y", varint.decode(varint.encode("x")))) == LONGS
    assert values(df.withColumn("y", varint.unzigzag(varint.zigzag("x")))) == LONGS
    assert values(df.withColumn("y", varint.zigzag("x")))[:5] == [0, 2, 1, 254, 256]
    assert values(df.withColumn("y", varint.zigzag_size("x")))[:5] == [1, 1, 1, 2, 2]
    b = rows(spark, [b"", b"\x80", b"\x05rest", b"\xff" * 9 + b"\x02", b"\xff" * 9 + b"\x01", b"\xff" * 11, None], "binary")
    assert values(b.withColumn("y", varint.decode("x"))) == [None, None, 5, None, -1, None, None]
    assert values(b.withColumn("y", varint.encoded_length("x"))) == [None, None, 1, 10, 10, None, None]
    pair = rows(spark, [encode(300) + encode(7) + b"x", encode(300), b""], "binary").withColumn("p", varint.decode_pair("x"))
    assert [r.p and tuple(r.p) for r in pair.orderBy("i").collect()] == [(300, 7, 3), None, None]
    cmp = varint.compare_encoded("x", F.lit(encode(300)))
    assert values(rows(spark, [encode(300), encode(7), encode(-1), b""], "binary").withColumn("y", cmp)) == [0, -1, 1, None]


BYTES = [b"", b"\x00", b"a\x00\x00", b"abc", b"\xff\xfe", b"\x80", "é".encode(), b"abcdefghij" * 40, None]


def test_bytes(spark):
    df = rows(spark, BYTES, "binary")
    some = BYTES[:-1]
    assert values(df.withColumn("y", bytesx.is_ascii("x"))) == [all(c < 128 for c in b) for b in some] + [None]
    assert values(df.withColumn("y", bytesx.is_valid_utf8("x")))[:7] == [True, True, True, True, False, False, True]
    assert values(df.withColumn("y", bytesx.pad_right("x", 4, 7))) == [b.ljust(4, b"\x07") for b in some] + [None]
    assert values(df.withColumn("y", bytesx.trim_right_zeros("x"))) == [b.rstrip(b"\x00") for b in some] + [None]
    assert values(df.withColumn("y", bytesx.key_successor("x"))) == [b + b"\x00" for b in some] + [None]
    assert values(df.withColumn("y", bytesx.first_bytes("x", 2))) == [b[:2] for b in some] + [None]
    assert values(df.withColumn("y", bytesx.xor_bytes("x", F.lit(b"\x0f\xf0")))) == [bytes(p ^ q for p, q in zip(b, b"\x0f\xf0")) for b in some] + [None]
    assert values(df.withColumn("y", bytesx.filled(3, 0xAB)))[0] == b"\xab" * 3
    assert values(df.withColumn("y", bytesx.has_prefix("x", b"\xff"))) == [b.startswith(b"\xff") for b in some] + [None]
    assert values(df.withColumn("y", bytesx.shared_prefix_length("x", F.lit(b"abd\x00")))) == [0, 0, 1, 2, 0, 0, 0, 2, None]
    assert values(df.withColumn("y", bytesx.entry_bytes("x", F.lit(None).cast("binary"))))[3] == 19
    for bits in (16, 32, 64):
        for little in (True, False):
            back = bytesx.decode_fixed(bytesx.encode_fixed("x", bits, little), bits, little)
            ints = rows(spark, [0, 1, 2**bits // 2 - 1, 513], "long")
            assert values(ints.withColumn("y", back)) == [0, 1, 2**bits // 2 - 1, 513]
            assert values(ints.withColumn("y", bytesx.encode_fixed("x", bits, little)))[3] == (513).to_bytes(bits // 8, "little" if little else "big")
    assert values(df.withColumn("y", bytesx.decode_fixed("x", 16)))[:5] == [None, None, 97, 25185, 65279]


def slow_crc(b, poly):
    c = 0xFFFFFFFF
    for x in b:
        c ^= x
        for _ in range(8):
            c = c >> 1 ^ (poly if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_checksums(spark):
    df = rows(spark, [*BYTES, b"123456789"], "binary")
    for f, poly in ((checksum.crc32, checksum.IEEE), (checksum.crc32c, checksum.CASTAGNOLI), (checksum.crc32_koopman, checksum.KOOPMAN)):
        assert values(df.withColumn("y", f("x"))) == [None if b is None else slow_crc(b, poly) for b in [*BYTES, b"123456789"]]
    assert checksum.crc_of([b"123456789"], checksum.CASTAGNOLI)[0] == 0xE3069283
    assert checksum.crc_of([b"6789"], checksum.IEEE, binascii.crc32(b"12345"))[0] == binascii.crc32(b"123456789")
    assert values(df.withColumn("y", checksum.trailing_crc_ok(checksum.with_trailing_crc("x"))))[:3] == [True] * 3
    assert values(df.withColumn("y", checksum.trailing_crc_ok("x")))[:4] == [False] * 4
    assert values(df.withColumn("y", checksum.frame_crc(F.lit(3), "x")))[3] == slow_crc(b"\x03abc", checksum.CASTAGNOLI)
    assert values(df.withColumn("y", checksum.multipart_crc("x", F.lit(b"z"))))[3] == slow_crc(b"abcz", checksum.CASTAGNOLI)
    ints = rows(spark, [0, 1, 0xFFFFFFFF, 0x12345678], "long")
    assert values(ints.withColumn("y", checksum.unmask(checksum.mask("x")))) == [0, 1, 0xFFFFFFFF, 0x12345678]
    assert values(ints.withColumn("y", checksum.mask("x")))[0] == 0xA282EAD8


def test_bloom(spark):
    assert bloom.sizing(0, 2) == bloom.sizing(1, 0.01) == (64, 30) and bloom.sizing(1000)[1] == 7
    keys = [b"key-%d" % k for k in range(500)] + [b""]
    df = rows(spark, [*keys, None], "binary")
    bits, hashes = bloom.sizing(len(keys))
    f = bloom.build(df, "x", bits, hashes).first()
    assert f.n_added == len(keys)
    probe = lambda d: values(d.withColumn("y", bloom.may_contain("x", bits, hashes, bytes(f["filter"]))))
    assert probe(df) == [True] * len(keys) + [None]
    other = probe(rows(spark, [b"other-%d" % k for k in range(1000)], "binary"))
    assert sum(other) < 40
    assert all(values(df.withColumn("y", bloom.may_contain("x", 0, 1, b"")))[:-1])
    whole = bloom.build(df, "x", bits, hashes)
    halves = bloom.merge(bloom.build(df.filter("i < 250"), "x", bits, hashes).unionByName(bloom.build(df.filter("i >= 250"), "x", bits, hashes)))
    a, b = whole.first(), halves.first()
    assert bytes(a["filter"]) == bytes(b["filter"]) and a.n_added == b.n_added
    fill = whole.select(bloom.fill_ratio("filter", "bits").alias("r")).first().r
    assert fill == pytest.approx(sum(bin(x).count("1") for x in bytes(a["filter"])) / bits)
    assert bloom.build(df.limit(0), "x", 64, 2).first().n_added == 0
    with pytest.raises(ValueError):
        bloom.may_contain("x", 8 * bloom.MAX_PROBE_BYTES + 8, 1, bytes(bloom.MAX_PROBE_BYTES + 1))


def test_previous_rows_across_partitions(spark):
    from keystrata.operators.neighbours import with_previous

    values = [("b", 2), ("a", 1), ("c", 3), ("a", 4), (None, 5)] + [(f"k{k:03d}", k) for k in range(100)]
    for rows in (values, values[:1], []):
        df = spark.createDataFrame(rows, "x string, _part int")
        got = with_previous(df, "x", ["x", "_part"], "p", partitions=5)
        assert got.columns == ["x", "_part", "p"]
        order = sorted(rows, key=lambda r: (r[0] is not None, r))
        want = [(*r, order[i - 1][0] if i else None) for i, r in enumerate(order)]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
