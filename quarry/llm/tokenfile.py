"""Token ids in ORC: encode, write in doc_id order, read back from the files.

Texts are encoded by the tokenizers library.  Its work is spent on distinct
pieces: a text is cut only where the byte-level pre-tokenizer must cut too
(between a letter and a blank, a letter and one of ``CUTS``, or before a blank
that follows anything but a blank), so a piece's ids do not depend on its
neighbours, and each Python worker remembers the ids of the pieces it has met
in sorted numpy arrays of bounded size.

The file format is Spark's ORC: integers in run-length encoded streams, a row
index every ``ROW_INDEX`` rows, and a Bloom filter on doc_id.  Rows are ordered
by doc_id over all files, so minimum and maximum of files, stripes and row
groups prune a look-up; stripes are read in parallel.

Defined cases: a null or empty text has only its end id.  Rows without doc_id
come first; rows that share a doc_id keep one entry each, ordered by text.
Other columns are not written.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, scratch_path
from .textspans import PAD, slices, text_bytes, xxh64

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
ROW_INDEX = 1000
STRIPE = 32 << 20
REMEMBERED = 500_000
SLICE_BYTES = 1 << 20
FILE_SCHEMA = "part int, doc_id long, before long, n_tokens long, ids array<int>"

_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = True
_LETTER[ord("a") : ord("z") + 1] = True
#: Characters that never share a pre-token with a letter before them.
CUTS = np.zeros(256, bool)
CUTS[list(b".,;:!?|()[]{}<>\"#$%&*+-/=@\\^_`~")] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x0A]] = True
#: One-byte characters, and first bytes of two-byte ones, that are no white space in any Unicode table.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_TWO = np.zeros(256, bool)
_TWO[0xC3:0xE0] = True
_LEAD = np.zeros(256, bool)
_LEAD[0xC3] = True
_TAIL = np.zeros(256, bool)
_TAIL[0x80:0xC0] = True

#: How byte-level vocabularies write bytes: printable ones as themselves, the rest from U+0100 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_WRITTEN = np.arange(256, dtype="<u4")
for _k, _b in enumerate(b for b in range(256) if b not in _PRINTABLE):
    _WRITTEN[_b] = 0x100 + _k


@functools.lru_cache(maxsize=2)
def _load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts by the library, remembering the ids of pieces."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.remembered = _load(path), remembered
        self.cuts = CUTS.copy()
        for token in self.tokenizer.get_added_tokens_decoder().values():  # never cut inside one of them
            inside = np.frombuffer(token.content.encode(), np.uint8)
            if _BLANK[inside].any() or token.lstrip or token.rstrip or token.single_word:
                raise ValueError(f"added token {token.content!r} depends on its neighbours")
            self.cuts[inside[1:]] = False

        self.key = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.met = np.zeros(0, np.uint8)  # whether it was met again
        self.ids = np.zeros(0, np.int32)

    def _forget(self) -> None:
        """Keep the pieces that were met again since the last time, if they are few enough."""
        keep = np.flatnonzero(self.met)
        if 2 * len(keep) > self.remembered:
            keep = keep[:0]
        size = self.size[keep].astype(np.int64)
        ends = np.cumsum(size)
        self.ids = self.ids[np.arange(int(size.sum())) + np.repeat(self.at[keep] - (ends - size), size)]
        self.key, self.at, self.size, self.met = self.key[keep], ends - size, self.size[keep], np.zeros(len(keep), np.uint8)

    def _ask(self, raw: bytes, start: np.ndarray, end: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of pieces, and how many each has.

        ``plain`` pieces are letters with at most a blank before them: one pre-token each,
        so they go straight to the library's BPE model, written as it writes bytes."""
        tokenize, written = self.tokenizer.model.tokenize, _WRITTEN[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-32-le")
        ids, size = array("i"), array("i")
        for a, b, one in zip(start.tolist(), end.tolist(), plain.tolist(), strict=True):
            got = [t.id for t in tokenize(written[a:b])] if one else self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids
            ids.extend(got)
            size.append(len(got))
        return np.array(ids, np.int32), np.array(size, np.int32)

    def _learn(self, key: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Add the ids of pieces, ``key`` sorted and new."""
        at = len(self.ids) + np.cumsum(size, dtype=np.int64) - size
        where = np.searchsorted(self.key, key)
        self.key = np.insert(self.key, where, key)
        self.at = np.insert(self.at, where, at)
        self.size = np.insert(self.size, where, size)
        self.met = np.insert(self.met, where, 0)
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some rows, and how many each row has (without end ids)."""
        base, n = int(offsets[0]), int(offsets[-1] - offsets[0])
        rows = len(offsets) - 1
        if not n:
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        buf = np.zeros(n + PAD, np.uint8)
        buf[:n] = data[base : base + n]
        seg, at = buf[:n], offsets - base
        letter, solid = _LETTER[seg], _SOLID[seg]
        tail = _TAIL[seg[1:]]
        solid[1:] |= tail & _TWO[seg[:-1]]
        letter[1:] |= tail & (seg[:-1] == 0xC3) & (seg[1:] & 0xDF != 0x97)
        first = np.zeros(n, bool)
        first[1:] = (solid[:-1] & _BLANK[seg[1:]]) | (letter[:-1] & self.cuts[seg[1:]])
        first[at[:-1][at[:-1] < n]] = True
        start = np.flatnonzero(first)
        size = np.diff(np.r_[start, n])
        key = xxh64(buf, start, size, 7)
        new, one, of = np.unique(key, return_index=True, return_inverse=True)
        if len(self.key) + len(new) > self.remembered:
            self._forget()
        if len(self.key):
            spot = np.minimum(np.searchsorted(self.key, new), len(self.key) - 1)
            known = self.key[spot] == new
            self.met[spot[known]] = 1
            unseen = np.flatnonzero(~known)
        else:
            unseen = np.arange(len(new))
        if len(unseen):
            raw = buf.tobytes()
            p, z = start[one[unseen]], size[one[unseen]]
            odd = np.zeros(n + 1, np.int64)
            np.cumsum(~(letter | _LEAD[seg]), out=odd[1:])
            plain = odd[p + z] == odd[np.minimum(p + (seg[p] == 0x20), p + z)]
            plain &= z > (seg[p] == 0x20)
            self._learn(new[unseen], *self._ask(raw, p, p + z, plain))
        spot = np.searchsorted(self.key, new)[of]
        each = self.size[spot].astype(np.int64)
        ends = np.cumsum(each)
        ids = self.ids[np.arange(int(ends[-1])) + np.repeat(self.at[spot] - (ends - each), each)]
        row = np.searchsorted(at[1:], start, "right")
        return ids, np.bincount(row, weights=each, minlength=rows).astype(np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder: a reused Python worker keeps what it has learnt."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _with_ends(ids: np.ndarray, count: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(count), end_id).astype(np.int32), count + 1


def encode_sorted(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """``FILE_SCHEMA`` rows in doc_id order: range partitions, each sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, before, enc = TaskContext.get().partitionId(), 0, encoder(vocabulary_path(vocabulary))
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets, SLICE_BYTES):
                ids, n = _with_ends(*enc.encode(data, offsets[a : b + 1]), end_id)
                cut = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b - a, own, np.int32)), batch.column(0).slice(a, b - a), pa.array(before + cut - n), pa.array(n), pa.ListArray.from_arrays(pa.array(np.r_[0, cut].astype(np.int32)), pa.array(ids))],
                    ["part", "doc_id", "before", "n_tokens", "ids"],
                )
                before += int(cut[-1])

    bounded_batches(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, FILE_SCHEMA)


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Write the ids of ``docs`` to ORC files under ``path``."""
    (
        encode_sorted(docs, vocabulary, end_id)
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(ROW_INDEX))
        .option("orc.stripe.size", str(STRIPE))
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` from the files; filters on doc_id prune stripes."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    # One row for each file: what stands in the files before it.
    ends = rows.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("n"))
    firsts = ends.select(F.col("part").alias("_part"), F.expr("coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("_first"))
    return rows.join(F.broadcast(firsts), F.col("part") == F.col("_part")).select("doc_id", (F.col("_first") + F.col("before")).alias("start"), "n_tokens", "ids")


def with_crc(rows: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of rows with an ``ids`` column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            at = ids.offsets.to_numpy()
            flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4"))
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``docs`` and return each document's entry as read from the files."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_tokens(docs, path)
    return with_crc(read_tokens(spark, path))
