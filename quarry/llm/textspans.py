"""Words, shingles and their hashes over whole Arrow string columns, in numpy.

A column's texts lie one after another in a single byte buffer.  Words are
found with table look-ups over that buffer and never become Python objects, and
XXH64 runs over all spans of one length at a time.  Callers work through a
batch in slices of whole documents (``slices``), which bounds the temporaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PAD = 64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Words between blanks: every byte but 0x20 and 0x09-0x0D.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False

#: Words of ASCII letters, digits and all bytes from 0x80.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[ord("0") : ord("9") + 1] = True
ALNUM[ord("a") : ord("z") + 1] = True
ALNUM[ord("A") : ord("Z") + 1] = True
ALNUM[128:] = True


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = 512 << 10) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer row."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to
        at = to


class Words:
    """Words of some rows: ``buf`` (padded), ``start``, ``end`` and ``row`` of each word."""

    __slots__ = ("buf", "start", "end", "row", "rows")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = NOT_BLANK, lower: bool = True, squeeze: bool = False):
        base, n = int(offsets[0]), int(offsets[-1] - offsets[0])
        seg = data[base : base + n]
        at = offsets - base
        inside = table[seg]
        if squeeze:  # one blank at most between words, none before the first
            keep = inside.copy()
            keep[1:] |= inside[:-1]
            cut = at[:-1][at[:-1] < n]
            keep[cut] = inside[cut]
            total = np.zeros(n + 1, np.int64)
            np.cumsum(keep, out=total[1:])
            seg, inside, at = np.where(inside, seg, 32).astype(np.uint8)[keep], inside[keep], total[at]
            n = len(seg)
        buf = np.zeros(n + PAD, np.uint8)
        buf[:n] = LOWER[seg] if lower else seg
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            cut = at[:-1][at[:-1] < n]
            first[cut] = inside[cut]
            cut = at[1:][at[1:] > 0] - 1
            last[cut] = inside[cut]
        self.buf = buf
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(at[1:], self.start, "right")
        self.rows = len(offsets) - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)


P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _lane(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(buf: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each span; ``buf`` ends with ``PAD`` spare bytes."""
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    flat = np.ascontiguousarray(buf)
    u64 = np.ndarray((len(flat) - 7,), "<u8", flat, strides=(1,))
    u32 = np.ndarray((len(flat) - 3,), "<u4", flat, strides=(1,))
    seed64, raw = np.uint64(seed), None
    short = np.minimum(length, 255).astype(np.uint8)
    order = np.argsort(short, kind="stable")
    edges = np.searchsorted(short[order], np.arange(257))
    with np.errstate(over="ignore"):
        for size in np.unique(short):
            rows = order[edges[size] : edges[int(size) + 1]]
            size = int(size)
            if size == 255:  # very long spans, one by one
                raw = flat.tobytes() if raw is None else raw
                for i in rows:
                    out[i] = xxhash.xxh64_intdigest(raw[start[i] : start[i] + length[i]], seed)
                continue
            p, at = start[rows], 0
            if size >= 32:
                acc = [np.full(len(rows), v, np.uint64) for v in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
                while at + 32 <= size:
                    for k in range(4):
                        acc[k] = _lane(acc[k], u64[p + (at + 8 * k)])
                    at += 32
                h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
                for a in acc:
                    h = (h ^ _lane(np.uint64(0), a)) * P1 + P4
            else:
                h = np.full(len(rows), seed64 + P5, np.uint64)
            h = h + np.uint64(size)
            while at + 8 <= size:
                h = _rotl(h ^ _lane(np.uint64(0), u64[p + at]), 27) * P1 + P4
                at += 8
            if at + 4 <= size:
                h = _rotl(h ^ (u32[p + at].astype(np.uint64) * P1), 23) * P2 + P3
                at += 4
            while at < size:
                h = _rotl(h ^ (flat[p + at].astype(np.uint64) * P5), 11) * P1
                at += 1
            h ^= h >> np.uint64(33)
            h *= P2
            h ^= h >> np.uint64(29)
            h *= P3
            out[rows] = h ^ (h >> np.uint64(32))
    return out
