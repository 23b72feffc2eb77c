"""Expressions over BINARY columns: slices, integers, comparisons.

All of them are Catalyst expressions, so they stay in generated code and a
prefix read like ``head`` is evaluated once for all predicates over it.
Offsets count from 0; anything outside the content is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def content(text: Column) -> Column:
    """The UTF-8 bytes of a text."""
    return F.encode(text, "UTF-8")


def latin1(data: Column) -> Column:
    """Bytes as a string in which character n is byte n."""
    return F.decode(data, "ISO-8859-1")


def size(data: Column) -> Column:
    return F.octet_length(data)


def head(data: Column, n: int = 4100) -> Column:
    return F.substring(data, 1, n)


def part(data: Column, offset: Column | int, length: Column | int) -> Column:
    """A checked range; -1 as length reads to the end.  Null if it is not inside."""
    if isinstance(offset, int) and isinstance(length, int) and length >= 0:
        return F.when(size(data) >= offset + length, F.substring(data, offset + 1, length)) if offset >= 0 else F.lit(None).cast("binary")

    def inside(p: Column) -> Column:
        o, n = p["o"], p["n"]
        n = F.when(n == -1, size(data) - o).otherwise(n)
        return F.when((o >= 0) & (n >= 0) & (o + n <= size(data)), F.substring(data, (o + 1).cast("int"), n.cast("int")))

    # Place and length may be long expressions.
    o, n = (F.lit(x) if isinstance(x, int) else x for x in (offset, length))
    return bound(F.struct(o.try_cast("bigint").alias("o"), n.try_cast("bigint").alias("n")), inside)


def unsigned(data: Column, offset: Column | int, width: int, big: bool = False) -> Column:
    """An unsigned integer of 1 to 8 bytes: BIGINT up to 7 bytes, DECIMAL(20,0) for 8."""
    raw = F.hex(part(data, offset, width))
    if not big and width > 1:
        raw = F.regexp_replace(raw, "(..)" * width, "".join(f"${k}" for k in range(width, 0, -1)))
    return _number(raw, width)


def unsigned_digits(digits: Column, offset: int, width: int, big: bool = False) -> Column:
    """The same from a content's hex digits, which must be there."""
    start = 2 * offset + 1
    return _number(F.substring(digits, start, 2 * width) if big or width == 1 else F.concat(*[F.substring(digits, start + 2 * k, 2) for k in range(width - 1, -1, -1)]), width)


def _number(digits: Column, width: int) -> Column:
    return F.conv(digits, 16, 10).cast("decimal(20,0)" if width == 8 else "bigint")


def signed(data: Column, offset: Column | int, width: int, big: bool = False) -> Column:
    return as_signed(unsigned(data, offset, width, big), width)


def as_signed(v: Column, width: int) -> Column:
    """The two's complement of an unsigned integer of ``width`` bytes."""
    half, whole = 1 << (8 * width - 1), 1 << (8 * width)
    if width == 8:
        return F.when(v >= F.lit(str(half)).cast("decimal(20,0)"), v - F.lit(str(whole)).cast("decimal(20,0)")).otherwise(v).cast("bigint")
    return F.when(v >= half, v - whole).otherwise(v)


def u8(data: Column, offset: Column | int) -> Column:
    return unsigned(data, offset, 1)


def u16le(data: Column, offset: Column | int) -> Column:
    return unsigned(data, offset, 2)


def u16be(data: Column, offset: Column | int) -> Column:
    return unsigned(data, offset, 2, True)


def u32le(data: Column, offset: Column | int) -> Column:
    return unsigned(data, offset, 4)


def u32be(data: Column, offset: Column | int) -> Column:
    return unsigned(data, offset, 4, True)


def c_string(data: Column, offset: Column | int, limit: int = 65536) -> Column:
    """The text up to the next zero byte; null without one within ``limit`` bytes, or for broken UTF-8."""
    raw = F.substring(data, (F.lit(offset) if isinstance(offset, int) else offset) + 1, F.lit(limit + 1))
    end = F.position(literal("00"), raw)
    text = F.substring(raw, F.lit(1), (end - 1).cast("int"))
    return F.when((end > 0) & F.is_valid_utf8(text.cast("string")), text.cast("string"))


def crc_unmasked(masked: Column) -> Column:
    """The CRC-32C behind its masked form: a constant is taken off, and 15 bits are rotated back."""
    v = F.pmod(masked.cast("bigint") - 0xA282EAD8, F.lit(1 << 32))
    return F.floor(v / (1 << 17)) + (v % (1 << 17)) * (1 << 15)


def all_zero(data: Column, offset: int, count: int) -> Column:
    """Whether ``count`` bytes are there and all are zero."""
    return F.coalesce(part(data, offset, count) == F.unhex(F.repeat(F.lit("00"), count)), F.lit(False))


def bits_before_end(data: Column, skip: Column | int, count: int) -> Column:
    """``count`` bits of a stream that is read from its end: its last set bit marks where it begins; null if there are too few.

    For streams of up to seven bytes, as a number.
    """
    n = size(data)
    padded = F.concat(data, F.unhex(F.lit("0000000000000000")))
    v = unsigned(padded, 0, 7).cast("bigint")
    mark = F.length(F.bin(v)) - 1
    left = mark - (F.lit(skip) if isinstance(skip, int) else skip) - count
    return F.when((n.between(1, 7)) & (v > 0) & (left >= 0), F.floor(v / F.pow(F.lit(2.0), left.cast("double"))).cast("bigint") % (1 << count))


def literal(hexes: str) -> Column:
    return F.unhex(F.lit(hexes))


def at(data: Column, offset: int, hexes: str) -> Column:
    """Whether the bytes at ``offset`` are those of ``hexes``; false outside."""
    return F.coalesce(F.substring(data, offset + 1, len(hexes) // 2) == literal(hexes), F.lit(False))


def nibbles(data: Column, offset: int, pattern: str) -> Column:
    """Whether the hex digits at ``offset`` fit ``pattern``, in which ``.`` fits any digit."""
    p = pattern.upper()
    shown = F.substring(F.hex(F.substring(data, offset + 1, (len(p) + 1) // 2)), 1, len(p))
    return F.coalesce(shown.rlike(f"^{p}$") if "." in p else shown == p, F.lit(not p))


def position(data: Column, needle: Column) -> Column:
    """Where ``needle`` first stands; null if nowhere."""
    p = F.position(needle, data)
    return F.when(p > 0, p - 1)


def bit_field(value: Column, start: int, width: int, of: int) -> Column:
    """``width`` bits of an ``of``-bit value, bit 0 being the most significant."""
    return F.shiftrightunsigned(value.cast("bigint"), of - start - width).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
