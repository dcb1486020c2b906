"""Functions on binary keys and values: all built-in expressions, except where noted."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that each entry counts besides its key and value.
ENTRY_OVERHEAD = 16


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def next_prefix(prefix: bytes) -> bytes | None:
    """The least byte string above all that begin with ``prefix``; None if there is none (empty or all 0xFF)."""
    stem = prefix.rstrip(b"\xff")
    return stem[:-1] + bytes([stem[-1] + 1]) if stem else None


def in_range(key: Column | str, low: bytes | str | None = None, high: bytes | str | None = None) -> Column:
    """``low <= key < high``; a bound that is None is open.  Plain comparisons, so they reach the scan."""
    out = F.lit(True)
    if low is not None:
        out = _col(key) >= F.lit(low)
    if high is not None:
        out = (out & (_col(key) < F.lit(high))) if low is not None else _col(key) < F.lit(high)
    return out


def has_prefix(key: Column | str, prefix: bytes | str) -> Column:
    """Keys that begin with ``prefix``.  For binary keys a range, since only that is pushed to the scan."""
    if isinstance(prefix, str):
        return _col(key).startswith(prefix)
    return in_range(key, bytes(prefix), next_prefix(bytes(prefix)))


def has_suffix(key: Column | str, suffix: bytes | str) -> Column:
    return F.endswith(_col(key), F.lit(suffix))


def key_successor(key: Column | str) -> Column:
    """The least key above ``key``."""
    return F.concat(_col(key), F.lit(b"\x00"))


def compare(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1 in unsigned byte order."""
    return F.when(_col(a) < _col(b), -1).when(_col(a) > _col(b), 1).otherwise(0)


def min_bytes(a: Column | str, b: Column | str) -> Column:
    return F.least(_col(a), _col(b))


def max_bytes(a: Column | str, b: Column | str) -> Column:
    return F.greatest(_col(a), _col(b))


def is_ascii(b: Column | str) -> Column:
    return F.hex(_col(b)).rlike("^([0-7][0-9A-F])*$")


def is_valid_utf8(b: Column | str) -> Column:
    return F.is_valid_utf8(_col(b).cast("string")) & (F.octet_length(_col(b)) >= 0)


def shared_prefix_length(a: Column | str, b: Column | str) -> Column:
    """Length of the common prefix in bytes."""
    ha, hb = F.hex(_col(a)), F.hex(_col(b))
    n = F.least(F.length(ha), F.length(hb)) / 2
    differ = F.filter(F.sequence(F.lit(1), n.cast("int")), lambda i: F.substr(ha, 2 * i - 1, F.lit(2)) != F.substr(hb, 2 * i - 1, F.lit(2)))
    shared = F.when(n < 1, 0).otherwise(F.coalesce(F.get(differ, F.lit(0)) - 1, n.cast("int"))).cast("int")
    return F.when(ha.isNotNull() & hb.isNotNull(), shared)


def pad_right(b: Column | str, n: int, fill: int = 0) -> Column:
    """Padded to ``n`` bytes; longer values stay whole."""
    return F.when(F.octet_length(_col(b)) >= n, _col(b)).otherwise(F.rpad(_col(b), n, bytes([fill])))


def trim_right_zeros(b: Column | str) -> Column:
    return F.unhex(F.regexp_replace(F.hex(_col(b)), "(00)+$", ""))


def first_bytes(b: Column | str, n: int) -> Column:
    return F.substring(_col(b), 1, max(0, n))


def concat(*parts: Column | str) -> Column:
    return F.concat(*map(_col, parts))


def entry_bytes(key: Column | str = "key", value: Column | str = "value") -> Column:
    """What an entry counts towards the flush threshold."""
    return (F.octet_length(_col(key)) + F.coalesce(F.octet_length(_col(value)), F.lit(0)) + ENTRY_OVERHEAD).cast("long")


def serialized_size(*parts: Column | str) -> Column:
    """Bytes of the parts when each follows its 32-bit length."""
    out = F.lit(0).cast("long")
    for p in parts:
        out = out + 4 + F.coalesce(F.octet_length(_col(p)), F.lit(0))
    return out


def encode_fixed(x: Column | str, bits: int, little: bool = True) -> Column:
    """The low ``bits`` (16, 32 or 64) of an integer as bytes."""
    digits = F.right(F.lpad(F.hex(_col(x).cast("long")), 16, "0"), F.lit(bits // 4))
    return F.unhex(_swapped(digits, bits // 8) if little else digits)


def decode_fixed(b: Column | str, bits: int, little: bool = True) -> Column:
    """The unsigned integer in the first bytes (64 bits wrap into a signed long); null where bytes are missing."""
    n = bits // 8
    digits = F.hex(F.substring(_col(b), 1, n))
    digits = _swapped(digits, n) if little else digits
    value = F.conv(digits, 16, -10 if bits == 64 else 10).cast("long")
    return F.when(F.octet_length(_col(b)) >= n, value)


def _swapped(digits: Column, n: int) -> Column:
    return F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(n))))


@F.pandas_udf(T.BinaryType())
def xor_bytes(a: pd.Series, b: pd.Series) -> pd.Series:
    """Byte-wise exclusive or over the shorter of the two.  Arrow batches: no built-in works on bytes one by one."""
    return pd.Series([None if x is None or y is None else bytes(p ^ q for p, q in zip(x, y)) for x, y in zip(a, b)])


def filled(n: int, fill: int) -> Column:
    """``n`` equal bytes."""
    return F.unhex(F.repeat(F.lit(f"{fill & 0xFF:02X}"), n))
