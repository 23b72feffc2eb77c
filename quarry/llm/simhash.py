"""SimHash near-duplicates found by covering locality-sensitive hashing.

A text's fingerprint has 64 bits: bit b is set if more than half of its 3-word
shingles' XXH64 values (seed 42) have it.  Texts link when their fingerprints
differ in at most ``radius`` bits.

Candidates come from a covering family: bit i gets a code m(i) of radius+1
bits, and mask v (one for each non-zero code) holds the bits whose code has an
odd product with v.  Any ``radius`` differing bits leave some v orthogonal to
all their codes, so the two fingerprints agree on all of mask v and meet in its
table: no pair within the radius is missed.

Equal fingerprints are one class before any candidate is made.  In a bucket the
operator emits a spanning forest of the links, at most one edge for each
member, never the pairs.  A bucket of more than ``LARGE`` members is split by a
second family of masks, so what meets agrees in the bits of two masks; fewer
than 2**20 fingerprints can, and in practice those that do are far fewer.

Defined cases: a null or blank text has the zero fingerprint and links like any
other; very long texts are read whole.  Rows that share a doc_id each get their
own row, and so do repeated rows.  A row without doc_id is fingerprinted and
links; a component without any doc_id is null.  An empty table gives an empty
result.  Other columns are ignored.  doc_id is an integer, or text that holds
one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import bounded_batches, free_name, materialize, quoted, release
from .textspans import Words, slices, text_bytes, xxh64

SHINGLE = 3
SEED = 42
RADIUS = 3
LARGE = 4096
_LANES = np.uint64(0x0101010101010101)


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The 64-bit SimHash of each row."""
    w = Words(data, offsets, squeeze=True)
    out, count = np.zeros(w.rows, np.uint64), w.counts()
    begin = np.cumsum(count) - count
    pieces = np.where(count >= shingle, count - shingle + 1, (count > 0).astype(np.int64))
    rows = np.flatnonzero(pieces)
    if not len(rows):
        return out
    first = np.cumsum(pieces[rows]) - pieces[rows]
    total = int(pieces.sum())
    word = np.arange(total) - np.repeat(first, pieces[rows]) + np.repeat(begin[rows], pieces[rows])
    span = np.repeat(np.minimum(count[rows], shingle), pieces[rows]) - 1
    start, end = w.start[word], w.end[word + span]
    h = xxh64(w.buf, start, end - start, seed)
    # Eight bits at a time, each in a byte lane: at most 255 shingles fit a lane.
    parts = -(-pieces[rows] // 255)
    part_of = np.cumsum(parts) - parts
    cut = np.repeat(first, parts) + 255 * (np.arange(int(parts.sum())) - np.repeat(part_of, parts))
    ones = np.empty((len(rows), 64), np.int64)
    for b in range(8):
        lanes = np.add.reduceat((h >> np.uint64(b)) & _LANES, cut).view(np.uint8).reshape(-1, 8)
        ones[:, b::8] = np.add.reduceat(lanes.astype(np.int64), part_of, axis=0)
    bits = 2 * ones > pieces[rows][:, None]
    out[rows] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``(doc_id, row, fp)`` for every row; reads these columns only (row is null if none is named)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            fp = [fingerprints(data, offsets[a : b + 1]) for a, b in slices(offsets)]
            joined = np.concatenate(fp) if fp else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(joined.view(np.int64))], ["doc_id", "row", "fp"])

    bounded_batches(docs.sparkSession)
    row = F.col(quoted(row_col)) if row_col else F.lit(None)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row.cast("long").alias("row"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, row long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64, second: bool = False) -> list[int]:
    """One mask for each non-zero code of radius+1 bits, as signed 64-bit numbers; a ``second`` family deals codes differently."""
    n = 2 ** (radius + 1) - 1
    codes = [1 + (7 * i + i // n if second else i) % n for i in range(bits)]
    masks = []
    for v in range(1, 2 ** (radius + 1)):
        mask = sum(1 << i for i, m in enumerate(codes) if bin(m & v).count("1") % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _forest(fp: np.ndarray, radius: int, tile: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Positions (child, parent) of a spanning forest of the links among ``fp``."""
    left, child, parent = np.arange(len(fp)), [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            found = np.zeros(len(left), bool)
            by = np.zeros(len(left), np.int64)
            step = max(1, tile // len(left))
            for k in range(0, len(front), step):
                part = front[k : k + step]
                near = np.bitwise_count(fp[part][:, None] ^ fp[left][None, :]) <= radius
                new = near.any(0) & ~found
                by[new] = part[near[:, new].argmax(0)]
                found |= new
            child.append(left[found])
            parent.append(by[found])
            front, left = left[found], left[~found]
    return (np.concatenate(child), np.concatenate(parent)) if child else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def bucket_edges(key: np.ndarray, fp: np.ndarray, radius: int, small: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Linking edges within runs of equal ``key`` (rows), as two arrays of fingerprints."""
    if not len(key):
        return fp[:0], fp[:0]
    start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
    size = np.diff(np.r_[start, len(key)])
    a, b = [], []
    run = np.repeat(size, size)
    for d in range(1, small):
        i = np.flatnonzero((run[:-d] <= small) & (key[:-d] == key[d:]).all(1)) if len(key) > d else np.zeros(0, np.int64)
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]
        a.append(fp[i])
        b.append(fp[i + d])
    for s, n in zip(start[size > small], size[size > small], strict=True):
        child, parent = _forest(fp[s : s + n], radius)
        a.append(fp[s + child])
        b.append(fp[s + parent])
    return np.concatenate(a), np.concatenate(b)


def near_edges(classes: DataFrame, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """``(a, b)`` edges that connect all ``classes(fp)`` within the radius.

    Each class goes to one bucket of every table, or to one of each table of the second family if that bucket is large;
    a task meets its buckets in sorted order and holds one bucket and one batch at a time.
    """

    def masks(second: bool) -> Column:
        return F.array(*[F.lit(m).cast("long") for m in covering_masks(radius, second=second)])

    keyed = classes.select("fp", F.posexplode(masks(False)).alias("t", "mask")).select(F.col("t").cast("long").alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp")
    crowded = materialize(keyed.groupBy("t", "part").agg(F.count("*").alias("n")).where(F.col("n") > large).select("t", "part", F.lit(True).alias("crowded")), "crowded")
    if crowded.isEmpty():
        dealt = keyed.select("t", "part", F.lit(-1).cast("long").alias("t2"), F.lit(0).cast("long").alias("part2"), "fp")
    else:
        again = F.when(F.col("crowded"), masks(True)).otherwise(F.array(F.lit(0).cast("long")))
        dealt = keyed.join(crowded, ["t", "part"], "left").select("t", "part", "fp", F.posexplode(again).alias("t2", "mask2"))
        dealt = dealt.select("t", "part", F.col("t2").cast("long").alias("t2"), F.col("fp").bitwiseAND(F.col("mask2")).alias("part2"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            rows = np.concatenate(held)
            a, b = bucket_edges(rows[:, :4], np.ascontiguousarray(rows[:, 4]).view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            rows = np.column_stack([c.to_numpy() for c in batch.columns])
            if not len(rows):
                continue
            last = int(np.argmin((rows[::-1, :4] == rows[-1, :4]).all(1))) if not (rows[:, :4] == rows[-1, :4]).all() else len(rows)
            if last < len(rows):  # a bucket ends in this batch
                held.append(rows[: len(rows) - last])
                yield out()
                held = [rows[len(rows) - last :]]
            elif held and (held[-1][-1, :4] != rows[0, :4]).any():
                yield out()
                held = [rows]
            else:
                held.append(rows)
        if held:
            yield out()

    place = ["t", "part", "t2", "part2"]
    return dealt.repartition(*place).sortWithinPartitions(*place).mapInArrow(run, "a long, b long")


def _grouped(fps: DataFrame, radius: int) -> DataFrame:
    """``(fp, component_id, keep)`` of each fingerprint; keep is the row of the least (doc_id, row) of its component."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min(order).alias("first")), "classes")
    parts = connected_components(near_edges(classes.select("fp"), radius))
    rooted = materialize(classes.join(parts, classes.fp == parts.node, "left").select("fp", "rep", "first", F.coalesce("component", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.min("first").alias("first")).select("root", "component_id", F.col("first.row").alias("keep"))
    named = materialize(rooted.select("fp", "root").join(least, "root").select("fp", "component_id", "keep"), "named")
    release(classes)
    release(rooted)
    return named


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``."""
    fps = materialize(with_fingerprints(docs, id_col, text_col), "fingerprints")
    return fps.join(_grouped(fps, radius).select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for each group of linked texts: that of the least doc_id, of equal ids the first; rows without id come last."""
    own, kept = free_name(docs, "own_row"), free_name(docs, "kept_row")
    rows = materialize(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    groups = _grouped(materialize(with_fingerprints(rows, id_col, text_col, own), "fingerprints"), radius)
    keep = groups.select(F.col("keep").alias(kept)).distinct()
    met = rows.hint("merge").join(keep, F.col(own) == F.col(kept), "left_semi")
    return met.select(*[F.col(quoted(c)) for c in docs.columns])
