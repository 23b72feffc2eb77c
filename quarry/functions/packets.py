"""Network packets as nested columns, in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bytes as b
from .transforms import internet_checksum


def dotted(data: Column, offset: Column | int) -> Column:
    """Four bytes as an address."""
    o = F.lit(offset) if isinstance(offset, int) else offset
    return F.concat_ws(".", *[b.u8(data, o + k).cast("string") for k in range(4)])


def ipv4(data: Column, at: Column | int = 0) -> Column:
    """The header of an IPv4 packet; null if it is none or its checksum is wrong."""
    o = F.lit(at) if isinstance(at, int) else at
    first, total = b.u8(data, o), b.u16be(data, o + 2)
    length = (first % 16) * 4
    head = b.part(data, o, length)
    good = (F.floor(first / 16) == 4) & (length >= 20) & (total >= length) & (o + total <= b.size(data)) & (internet_checksum(head) == 0)
    fields = F.struct(
        length.cast("int").alias("header"), total.alias("total"), b.u16be(data, o + 4).alias("id"), b.u8(data, o + 8).alias("ttl"), b.u8(data, o + 9).alias("protocol"),
        dotted(data, o + 12).alias("source"), dotted(data, o + 16).alias("target"), b.part(data, o + length, (total - length)).alias("payload"),
    )
    return F.when(good, fields)


def udp(data: Column) -> Column:
    size = b.u16be(data, 4)
    return F.when((size >= 8) & (size <= b.size(data)), F.struct(b.u16be(data, 0).alias("source"), b.u16be(data, 2).alias("target"), b.part(data, 8, size - 8).alias("payload")))


def tcp(data: Column) -> Column:
    head = F.floor(b.u8(data, 12) / 16) * 4
    return F.when((head >= 20) & (head <= b.size(data)), F.struct(b.u16be(data, 0).alias("source"), b.u16be(data, 2).alias("target"), b.u32be(data, 4).alias("sequence"), b.u32be(data, 8).alias("acknowledged"), b.u8(data, 13).alias("flags"), b.part(data, head.cast("int"), -1).alias("payload")))


def sequence_after(a: Column, c: Column) -> Column:
    """Whether 32-bit sequence number ``a`` comes after ``c``, around the wrap."""
    gap = F.pmod(a - c, F.lit(1 << 32))
    return (gap > 0) & (gap < 1 << 31)
