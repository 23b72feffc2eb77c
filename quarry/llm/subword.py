"""Hashed character n-grams of words, and bounded labelled samples.

Texts of a batch lie in one buffer in which every row begins with a blank, so
each word has a blank on both sides.  An n-gram may begin or end with that
blank but never crosses it; it is read as one unaligned 64-bit load, masked and
multiplied into its bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textspans import LOWER, PAD

#: Rows of a label that a byte budget leaves alone.
LEAST_ROWS = 50
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

#: Bytes that words are made of: ASCII letters and all bytes from 0x80.
LETTERS = np.zeros(256, bool)
LETTERS[ord("a") : ord("z") + 1] = True
LETTERS[ord("A") : ord("Z") + 1] = True
LETTERS[128:] = True


class Grams:
    """The n-grams of some rows: ``bucket``, ``word`` and the words' ``row``."""

    __slots__ = ("bucket", "word", "word_row", "rows", "_buf", "_start", "_end")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, sizes: tuple[int, ...], bits: int):
        base, n = int(offsets[0]), int(offsets[-1] - offsets[0])
        self.rows = len(offsets) - 1
        at = (offsets - base)[:-1]
        seg = np.insert(data[base : base + n], at, 32)
        begins = at + np.arange(self.rows)
        n = len(seg)
        buf = np.full(n + PAD, 32, np.uint8)
        inside = np.zeros(n + 1, bool)
        inside[:n] = table[seg]
        inside[begins] = False
        buf[:n] = np.where(inside[:n], LOWER[seg], 32)
        start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        self.word_row = np.searchsorted(begins, start, "right") - 1
        self._buf, self._start, self._end = buf, start, ends
        u64 = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
        buckets, words = [], []
        length = ends - start
        for size in sizes:
            # A word of k letters has k + 3 - size n-grams of that size, blanks included.
            each = np.maximum(length + 3 - size, 0)
            cut = np.cumsum(each)
            total = int(cut[-1]) if len(cut) else 0
            word = np.repeat(np.arange(len(start)), each)
            p = np.arange(total) + np.repeat(start - 1 - (cut - each), each)
            mask = np.uint64((1 << (8 * size)) - 1)
            with np.errstate(over="ignore"):
                h = (((u64[p] & mask) + np.uint64(size)) * _MULTIPLIER) >> np.uint64(64 - bits)
            buckets.append(h.astype(np.int32))
            words.append(word.astype(np.int32))
        self.bucket = np.concatenate(buckets)
        self.word = np.concatenate(words)

    def word_texts(self) -> list[bytes]:
        raw = self._buf.tobytes()
        return [raw[a:b] for a, b in zip(self._start.tolist(), self._end.tolist(), strict=True)]


def train_rows(doc_id: str = "doc_id"):
    """Whether a row may be learnt from: crc32 of its id's text modulo 4 is not 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2, F.lit(False))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_rates(stats: dict[str, tuple[int, int]], per_label: int, byte_budget: int) -> dict[str, float]:
    """The share of each label's rows that is taken, given their number and bytes."""
    rows = {k: min(n, per_label) for k, (n, _) in stats.items()}
    least = {k: min(r, LEAST_ROWS) for k, r in rows.items()}
    each = {k: b / n for k, (n, b) in stats.items()}
    more = sum((rows[k] - least[k]) * each[k] for k in stats)
    share = min(1.0, max(0.0, byte_budget - sum(least[k] * each[k] for k in stats)) / max(more, 1.0))
    return {k: (least[k] + share * (rows[k] - least[k])) / stats[k][0] for k in stats}


def labelled_sample(rows: DataFrame, label: str, per_label: int, byte_budget: int) -> pa.Table:
    """A sample of ``rows(doc_id, text, <label>)`` that does not depend on their order.

    About ``per_label`` rows of each label, chosen by a hash of doc_id.  If they are
    more than ``byte_budget`` bytes of text, labels with more than ``LEAST_ROWS``
    rows give up rows above that number, all the same share of them.
    """
    rows = rows.select(F.col("doc_id"), F.col("text"), F.col(label).cast("string").alias("label")).where("doc_id is not null and text is not null and label is not null")
    stats = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).collect()
    if not stats:
        return pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "label": pa.array([], pa.string())})
    scale = 1 << 30
    pairs = [x for k, v in sorted(sample_rates({r["label"]: (r["n"], r["b"]) for r in stats}, per_label, byte_budget).items()) for x in (F.lit(k), F.lit(int(v * scale)))]
    kept = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < F.create_map(*pairs)[F.col("label")])
    return kept.toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
