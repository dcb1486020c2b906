"""Checksums.  CRC-32 is built in; other polynomials run in Arrow batches, a byte position of all rows at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .bytesx import _col

#: Reversed polynomials (fixed values).
IEEE, CASTAGNOLI, KOOPMAN = 0xEDB88320, 0x82F63B78, 0xEB31D82E
#: Offset of masked checksums (fixed value).
MASK_DELTA = 0xA282EAD8


@lru_cache(maxsize=8)
def _table(poly: int) -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(poly), t >> 1)
    return t


def crc_of(values: list[bytes], poly: int, start: int = 0) -> np.ndarray:
    """Checksums of byte strings, extending ``start``."""
    table = _table(poly)
    size = np.array([len(v) for v in values], np.int64)
    order = np.argsort(-size, kind="stable")
    data = np.frombuffer(b"".join(values[k] for k in order), np.uint8)
    begin = np.cumsum(size[order]) - size[order]
    crc = np.full(len(values), np.uint32(start) ^ np.uint32(0xFFFFFFFF), np.uint32)
    live, longest = len(values), int(size.max(initial=0))
    for at in range(longest):
        while live and size[order[live - 1]] <= at:
            live -= 1
        c = crc[:live]
        crc[:live] = table[(c ^ data[begin[:live] + at]) & 0xFF] ^ (c >> 8)
    out = np.empty(len(values), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def _udf(poly: int):
    @F.pandas_udf("long")
    def crc(b: pd.Series) -> pd.Series:
        there = b.notna().to_numpy()
        out = pd.Series([None] * len(b), dtype="Int64")
        out[there] = crc_of([bytes(x) for x in b[there]], poly).astype(np.int64)
        return out

    return crc


def crc32(b: Column | str) -> Column:
    return F.crc32(_col(b))


def crc32c(b: Column | str) -> Column:
    return _udf(CASTAGNOLI)(_col(b))


def crc32_koopman(b: Column | str) -> Column:
    return _udf(KOOPMAN)(_col(b))


def frame_crc(kind: Column | str, payload: Column | str) -> Column:
    """CRC-32C over a type byte and its payload."""
    return crc32c(F.concat(F.unhex(F.lpad(F.hex(_col(kind).cast("long").bitwiseAND(255)), 2, "0")), _col(payload)))


def multipart_crc(*parts: Column | str) -> Column:
    return crc32c(F.concat(*map(_col, parts)))


def with_trailing_crc(b: Column | str) -> Column:
    """The bytes and their CRC-32C, little-endian."""
    from .bytesx import encode_fixed

    return F.concat(_col(b), encode_fixed(crc32c(b), 32))


def trailing_crc_ok(b: Column | str) -> Column:
    """Whether the last four bytes are the CRC-32C of those before; false for shorter values."""
    from .bytesx import decode_fixed

    b = _col(b)
    n = F.octet_length(b)
    body = F.substr(b, F.lit(1), F.greatest(n - 4, F.lit(0)))
    return F.when(n < 4, False).otherwise(crc32c(body) == decode_fixed(F.substr(b, n - 3), 32))


def mask(crc: Column | str) -> Column:
    """Rotated by 15 bits and offset, modulo 2**32."""
    c = _col(crc).cast("long")
    turned = F.shiftright(c, 15).bitwiseOR(F.shiftleft(c, 17)).bitwiseAND(0xFFFFFFFF)
    return (turned + MASK_DELTA).bitwiseAND(0xFFFFFFFF)


def unmask(masked: Column | str) -> Column:
    t = (_col(masked).cast("long") - MASK_DELTA).bitwiseAND(0xFFFFFFFF)
    return F.shiftright(t, 17).bitwiseOR(F.shiftleft(t, 15)).bitwiseAND(0xFFFFFFFF)
