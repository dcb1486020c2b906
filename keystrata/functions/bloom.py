"""Bloom filters: sizing as column expressions; building, merging and probing in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import checksum
from .bytesx import _col

#: Multipliers of the 64-bit mixing and the golden-ratio constant (fixed values).
MIX_A, MIX_B, GOLDEN = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
DEFAULT_FP, MIN_BITS, MAX_HASHES = 0.01, 64, 30


def optimal_bits(n: Column | str, fp: float = DEFAULT_FP) -> Column:
    n = F.greatest(_col(n).cast("double"), F.lit(0.0))
    return F.ceil(F.greatest(F.lit(float(MIN_BITS)), -n * math.log(fp) / (math.log(2) ** 2))).cast("long")


def optimal_hashes(bits: Column | str, n: Column | str) -> Column:
    k = _col(bits).cast("double") / F.nullif(_col(n).cast("double"), F.lit(0.0)) * math.log(2)
    return F.when(_col(n) <= 0, 1).otherwise(F.floor(F.least(F.greatest(k, F.lit(1.0)), F.lit(float(MAX_HASHES))) + 0.5)).cast("int")


def estimated_fp(bits: Column | str, hashes: Column | str, n: Column | str) -> Column:
    m, k, n = (_col(x).cast("double") for x in (bits, hashes, n))
    return F.when((m == 0) | (k == 0), 1.0).otherwise(F.pow(1 - F.exp(-k * n / F.nullif(m, F.lit(0.0))), k))


def sizing(n: int, fp: float = DEFAULT_FP) -> tuple[int, int]:
    """Bits and hashes for ``n`` keys; ``n`` and ``fp`` out of range take 1 and the default."""
    n, fp = (n if n > 0 else 1), (fp if 0 < fp < 1 else DEFAULT_FP)
    bits = math.ceil(max(MIN_BITS, -n * math.log(fp) / math.log(2) ** 2))
    return bits, math.floor(min(max(bits / n * math.log(2), 1), MAX_HASHES) + 0.5)


def _mix(z: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, MIX_A), (27, MIX_B)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


def positions(keys: list[bytes], bits: int, hashes: int) -> np.ndarray:
    """Bit positions of each key by double hashing over its two checksums, one row a key."""
    length = np.array([len(k) for k in keys], np.uint64)
    a = checksum.crc_of(keys, checksum.CASTAGNOLI).astype(np.uint64)
    b = checksum.crc_of(keys, checksum.IEEE).astype(np.uint64)
    a = _mix(a ^ (length * np.uint64(GOLDEN)))
    b = _mix(np.where(b == 0, np.uint64(GOLDEN), b) ^ a)
    return (a[:, None] + np.arange(hashes, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


def _filter_of(keys: list[bytes], bits: int, hashes: int) -> bytes:
    out = np.zeros(8 * -(-bits // 8), bool)
    if keys:
        out[positions(keys, bits, hashes).ravel().astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def build(df: DataFrame, key: str = "key", bits: int = MIN_BITS, hashes: int = 4) -> DataFrame:
    """One row ``bits, hashes, n_added, filter``.  Each task sends one partial filter, never its keys."""

    def partial(it):
        out, n = np.zeros(-(-bits // 8), np.uint8), 0
        for pdf in it:
            keys = [bytes(k) for k in pdf[key] if k is not None]
            n += len(keys)
            out |= np.frombuffer(_filter_of(keys, bits, hashes), np.uint8)
        yield pd.DataFrame({"n_added": [n], "filter": [out.tobytes()]})

    parts = df.select(F.col(key).cast("binary").alias(key)).mapInPandas(partial, "n_added long, filter binary")
    none = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("n_added"), F.lit(bytes(-(-bits // 8))).alias("filter"))
    return merge(parts.unionByName(none).withColumns({"bits": F.lit(bits).cast("long"), "hashes": F.lit(hashes)}))


def build_each(df: DataFrame, by: str, key: str = "key", bits: int = MIN_BITS, hashes: int = 4) -> DataFrame:
    """One row ``by, bits, hashes, n_added, filter`` for each value of the text column ``by``, null included.

    Each task sends one partial filter a value, never its keys.
    """

    def partial(it):
        found: dict[str | None, list] = {}
        for pdf in it:
            for value, keys in pdf.groupby(by, dropna=False)[key]:
                mine = found.setdefault(None if pd.isna(value) else value, [0, np.zeros(-(-bits // 8), np.uint8)])
                keys = [bytes(k) for k in keys if k is not None]
                mine[0] += len(keys)
                mine[1] |= np.frombuffer(_filter_of(keys, bits, hashes), np.uint8)
        if found:
            yield pd.DataFrame({by: list(found), "n_added": [n for n, _ in found.values()], "filter": [out.tobytes() for _, out in found.values()]})

    parts = df.select(F.col(by).cast("string").alias(by), F.col(key).cast("binary").alias(key)).mapInPandas(partial, f"`{by}` string, n_added long, filter binary")
    return merge(parts.withColumns({"bits": F.lit(bits).cast("long"), "hashes": F.lit(hashes)}), by)


#: Groups that partial filters meet in before the last step.
MERGE_FAN = 32


def merge(filters: DataFrame, *by: str) -> DataFrame:
    """Filters ``bits, hashes, n_added, filter`` joined by bitwise or, per shape (and text columns ``by``).

    In two steps, each a running "or" that holds one filter a shape: the last task reads ``MERGE_FAN`` filters of
    a shape, however many there are.
    """
    keys = [*by, "bits", "hashes"]
    schema = "".join(f"`{c}` string, " for c in by) + "bits long, hashes int, n_added long, filter binary"

    def ored(it):
        found: dict[tuple, list] = {}
        for pdf in it:
            for row in pdf.itertuples(index=False):
                *key, added, data = row
                key = tuple(None if pd.isna(k) else k for k in key)
                mine = found.setdefault(key, [0, np.zeros(len(data), np.uint8)])
                mine[0] += added
                mine[1] |= np.frombuffer(data, np.uint8)
        if found:
            rows = [(*k, n, out.tobytes()) for k, (n, out) in found.items()]
            yield pd.DataFrame(rows, columns=[*keys, "n_added", "filter"])

    parts = filters.select(*keys, "n_added", "filter")
    some = parts.repartition(*keys, F.pmod(F.xxhash64("filter"), F.lit(MERGE_FAN))).mapInPandas(ored, schema)
    return some.repartition(*keys).mapInPandas(ored, schema)


#: A filter beyond this isn't sent to the executors: look such keys up with a semi-join.
MAX_PROBE_BYTES = 256 << 20


def may_contain(key: Column | str, bits: int, hashes: int, data: bytes) -> Column:
    """Whether a key may be in the filter (never false for one that is).  A filter of no bits holds everything.

    The filter travels packed, once an executor (Spark broadcasts a function's data over a megabyte), and is
    refused over ``MAX_PROBE_BYTES``.
    """
    if len(data) > MAX_PROBE_BYTES:
        raise ValueError(f"a filter of {len(data)} bytes is too large to be sent; use a semi-join")

    @F.pandas_udf("boolean")
    def probe(k: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(k), dtype="boolean")
        ok = k.notna().to_numpy()
        keys = [bytes(x) for x in k[ok]]
        if bits == 0:
            out[ok] = True
        elif keys:
            at = positions(keys, bits, hashes)
            packed = np.frombuffer(data, np.uint8)
            out[ok] = ((packed[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
        return out

    return probe(_col(key).cast("binary"))


def bit_positions(key: Column | str, bits: int, hashes: int) -> Column:
    """The positions that a key sets, as an array in order of the hashes; null for null."""

    @F.pandas_udf("array<long>")
    def found(k: pd.Series) -> pd.Series:
        ok = k.notna().to_numpy()
        out = np.full(len(k), None, object)
        at = positions([bytes(x) for x in k[ok]], bits, hashes).astype(np.int64) if ok.any() else []
        for i, row in zip(np.flatnonzero(ok), at):
            out[i] = row
        return pd.Series(out)

    return found(_col(key).cast("binary"))


def fill_ratio(data: Column | str, bits: Column | str) -> Column:
    """Set bits over all bits."""
    ones = F.lit(0)
    digits = F.hex(_col(data))
    for d in range(1, 16):
        ones = ones + bin(d).count("1") * (F.length(digits) - F.length(F.translate(digits, f"{d:X}", "")))
    return F.when(_col(bits) > 0, ones / _col(bits)).otherwise(0.0)
