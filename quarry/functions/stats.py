"""Byte statistics.

Histograms and what follows from them are Arrow UDFs over whole batches: one
``numpy.bincount`` counts the bytes of many rows, so a row costs no Python call.
A histogram as a column can also be asked in the JVM, in ascending order of the
byte value; ``byte_statistics`` returns the numbers alone, 7 instead of 256 a row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .udf import per_batch, per_value, value_buffer


def byte_counts(data: np.ndarray, offsets: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Counts of the 256 values for each row, some rows of about ``step`` bytes (or one longer row) at a time."""
    rows = len(offsets) - 1
    out = np.zeros((rows, 256), np.int64)
    at = 0
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + step, "right")) - 1)
        part = data[offsets[at] : offsets[to]]
        if to == at + 1:
            out[at] = np.bincount(part, minlength=256)
        else:
            row = np.repeat(np.arange(to - at), np.diff(offsets[at : to + 1]))
            out[at:to] = np.bincount(row * 256 + part, minlength=256 * (to - at)).reshape(-1, 256)
        at = to
    return out


@per_batch("array<bigint>")
def histogram(column: pa.Array) -> pa.Array:
    """How often each of the 256 byte values occurs."""
    counts = byte_counts(*value_buffer(column))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, 256 * len(counts) + 1, 256, np.int32)), pa.array(counts.ravel()), mask=column.is_null() if column.null_count else None)


@per_batch("struct<total:bigint,byte_sum:bigint,mean:double,deviation:double,mode:int,entropy:double,printable:double>")
def byte_statistics(column: pa.Array) -> pa.Array:
    """Number and sum of bytes, mean, mean distance from it, most frequent byte, entropy in bits, share from 0x20 to 0x7E.

    Mean, deviation, mode and share are null for no bytes, where entropy is 0.
    """
    counts = byte_counts(*value_buffer(column))
    value, n = np.arange(256), counts.sum(1)
    total = counts @ value
    none = n == 0
    some = np.maximum(n, 1)
    mean = total / some
    deviation = (np.abs(value - mean[:, None]) * counts).sum(1) / some
    c = counts.astype(np.float64)
    entropy = np.where(none, 0.0, np.maximum(np.log2(some) - (c * np.log2(np.maximum(c, 1))).sum(1) / some, 0.0))
    share = counts[:, 0x20:0x7F].sum(1) / some
    columns = [pa.array(n), pa.array(total), pa.array(mean, mask=none), pa.array(deviation, mask=none), pa.array(counts.argmax(1).astype(np.int32), mask=none), pa.array(entropy), pa.array(share, mask=none)]
    return pa.StructArray.from_arrays(columns, ["total", "byte_sum", "mean", "deviation", "mode", "entropy", "printable"], mask=column.is_null() if column.null_count else None)


@per_value("struct<byte_sum:bigint,square_sum:bigint,adjacent_sum:bigint>")
def serial_sums(data: bytes):
    """Sums of bytes, of squares, and of products of neighbours (the ends don't meet)."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    return {"byte_sum": int(b.sum()), "square_sum": int((b * b).sum()), "adjacent_sum": int((b[:-1] * b[1:]).sum())}


@per_value("bigint")
def weighted_sum(data: bytes):
    """The sum of bytes, each times its place (from 0 on, modulo 251) plus one: it tells apart contents with equal counts."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    return int((b * (np.arange(len(b)) % 251 + 1)).sum())


@per_value("bigint")
def circle_hits(data: bytes, limit: int):
    """Six-byte points whose two 24-bit coordinates lie within the squared radius ``limit``."""
    n = len(data) // 6
    p = np.frombuffer(data[: 6 * n], np.uint8).reshape(n, 2, 3).astype(np.int64) @ np.array([65536, 256, 1])
    return int((p[:, 0] ** 2 + p[:, 1] ** 2 < limit).sum())


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda acc, c: acc + c)


def _indexed(counts: Column) -> Column:
    return F.transform(counts, lambda c, i: F.struct(i.alias("i"), c.alias("c")))


def count_of(counts: Column, value: int) -> Column:
    return F.element_at(counts, value + 1)


def byte_sum(counts: Column) -> Column:
    return F.aggregate(_indexed(counts), F.lit(0).cast("bigint"), lambda acc, x: acc + x["i"] * x["c"])


def mean(counts: Column) -> Column:
    """The mean byte; null for no bytes."""
    return byte_sum(counts).cast("double") / F.nullif(total(counts), F.lit(0))


def deviation(counts: Column, around: Column) -> Column:
    """The mean distance of bytes from ``around``."""
    far = F.aggregate(_indexed(counts), F.lit(0.0), lambda acc, x: acc + F.abs(x["i"] - around) * x["c"])
    return far / F.nullif(total(counts), F.lit(0))


def mode(counts: Column) -> Column:
    """The most frequent byte, the smaller one of a tie."""
    return F.array_position(counts, F.array_max(counts)).cast("int") - 1


def entropy(counts: Column) -> Column:
    """Shannon entropy in bits a byte; 0 for no bytes."""
    n = total(counts).cast("double")
    s = F.aggregate(F.filter(counts, lambda c: c > 0), F.lit(0.0), lambda acc, c: acc + c * F.log2(c.cast("double")))
    return F.when(n > 0, F.greatest(F.log2(n) - s / n, F.lit(0.0))).otherwise(0.0)


def entropy_by_ln(counts: Column) -> Column:
    """The same by natural logarithms of the shares: equal but for the last bits; 0 for no bytes."""
    n = total(counts).cast("double")
    s = F.aggregate(F.filter(counts, lambda c: c > 0), F.lit(0.0), lambda acc, c: acc - c / n * F.ln(c / n))
    return F.when(n > 0, F.greatest(s / math.log(2), F.lit(0.0))).otherwise(0.0)


def serial_correlation(sums: Column, n: Column) -> Column:
    """Correlation of neighbours from their sums; -100000 for no bytes or where it is 0/0."""
    scale = n * sums["square_sum"] - sums["byte_sum"] * sums["byte_sum"]
    return F.when((n == 0) | (scale == 0), F.lit(-100000.0)).otherwise((n * sums["adjacent_sum"] - sums["byte_sum"] * sums["byte_sum"]) / scale.cast("double"))


#: The squared radius for 24-bit coordinates.
CIRCLE_LIMIT = (2**24 - 1) ** 2


def monte_carlo_pi(data: Column) -> Column:
    """How far, relatively, the points' estimate of pi is off; null below 6 bytes."""
    points = F.floor(F.octet_length(data) / 6)
    return F.when(points > 0, F.abs(4.0 * circle_hits(data, CIRCLE_LIMIT) / points - math.pi) / math.pi)


def printable_ratio(counts: Column) -> Column:
    """The share of bytes from 0x20 to 0x7E; null for no bytes."""
    return total(F.slice(counts, 0x20 + 1, 95)) / F.nullif(total(counts), F.lit(0)).cast("double")
