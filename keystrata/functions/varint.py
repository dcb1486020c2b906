"""Variable-length integers: seven bits a byte, low bits first, a set high bit meaning more follows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bytesx import _col

MAX_LENGTH = 10


def size(x: Column | str) -> Column:
    """Bytes of the encoding of a long taken as unsigned."""
    x = _col(x).cast("long")
    out = F.when(x < 0, MAX_LENGTH)
    for n in range(1, 9):
        out = out.when(x < (1 << 7 * n), n)
    return F.when(x.isNotNull(), out.otherwise(9)).cast("int")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encode(x: Column | str) -> Column:
    """The encoding of a long taken as unsigned.

    Bytes are put together as numbers, five to a half, so a row is rendered as text twice and not ten times.
    """
    x = _col(x).cast("long")

    def of(n: Column) -> Column:
        digits = []
        for half in (0, 1):
            value = F.lit(0).cast("long")
            for k in range(5):
                i = 5 * half + k
                group = F.shiftrightunsigned(x, 7 * i).bitwiseAND(0x7F).bitwiseOR(F.when(n > i + 1, 0x80).otherwise(0).cast("long"))
                value = value.bitwiseOR(F.shiftleft(group, 8 * (4 - k)))
            text = F.substr(F.lpad(F.hex(value), 10, "0"), F.lit(1), 2 * F.greatest(n - 5 * half, F.lit(0)))
            digits.append(text if half == 0 else F.when(n > 5, text).otherwise(""))
        return F.unhex(F.concat(*digits))

    return F.when(x.isNotNull(), _let(size(x), of))


def _with_bytes(b: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body(halves, n)``: the first ten bytes as two numbers of five, and the length of the first encoding.

    Bytes that are missing are 0xFF, which never ends an encoding; its length is null if nothing does.
    """
    digits = F.rpad(F.hex(F.substring(b, 1, MAX_LENGTH)), 2 * MAX_LENGTH, "F")
    halves = F.array(*(F.conv(F.substring(digits, at, 10), 16, 10).cast("long") for at in (1, 11)))

    def length(h: Column) -> Column:
        out = None
        for i in range(MAX_LENGTH):
            ends = F.get(h, F.lit(i // 5)).bitwiseAND(0x80 << 8 * (4 - i % 5)) == 0
            out = F.when(ends, i + 1) if out is None else out.when(ends, i + 1)
        return out.cast("int")

    return F.when(b.isNotNull(), _let(halves, lambda h: _let(length(h), lambda n: body(h, n))))


def encoded_length(b: Column | str) -> Column:
    """Bytes of the first encoding in ``b``; null if it is cut off or longer than ten bytes."""
    return _with_bytes(_col(b), lambda h, n: n)


def decode(b: Column | str) -> Column:
    """The first encoding in ``b`` as a long (64 bits wrap); null if it is cut off or overflows 64 bits."""

    def of(h: Column, n: Column) -> Column:
        out = F.lit(0).cast("long")
        for i in range(MAX_LENGTH):
            group = F.shiftrightunsigned(F.get(h, F.lit(i // 5)), 8 * (4 - i % 5)).bitwiseAND(0x7F)
            out = out.bitwiseOR(F.when(n > i, F.shiftleft(group, 7 * i)).otherwise(F.lit(0).cast("long")))
        fits = (n < MAX_LENGTH) | (F.get(h, F.lit(1)).bitwiseAND(0xFF) <= 1)
        return F.when(n.isNotNull() & fits, out)

    return _with_bytes(_col(b), of)


def decode_pair(b: Column | str) -> Column:
    """Two encodings one after the other: ``struct(a, b, n)`` with the bytes they take; null if either is broken."""
    b = _col(b)
    n1 = encoded_length(b)
    rest = F.substr(b, F.coalesce(n1, F.lit(0)) + 1)
    first, second, n2 = decode(b), decode(rest), encoded_length(rest)
    return F.when(first.isNotNull() & second.isNotNull(), F.struct(first.alias("a"), second.alias("b"), (n1 + n2).alias("n")))


def compare_encoded(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1 by unsigned decoded value; null if either is broken."""
    flip = F.lit(-(1 << 63))
    x, y = decode(a).bitwiseXOR(flip), decode(b).bitwiseXOR(flip)
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def zigzag(x: Column | str) -> Column:
    """Signed to unsigned so that small magnitudes stay small."""
    x = _col(x).cast("long")
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(u: Column | str) -> Column:
    u = _col(u).cast("long")
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-u.bitwiseAND(1))


def zigzag_size(x: Column | str) -> Column:
    return size(zigzag(x))
