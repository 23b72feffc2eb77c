"""Benchmark decontamination with an FM-index for each shard of the training text.

A shard is a run of whole documents of bounded size.  Its words become symbols
of the phrase vocabulary; a word that no phrase holds, like a document's end,
is a terminator that no phrase can cross, ordered by its position.  The shard's
suffix array gives a BWT kept as a wavelet matrix; phrases are matched by
backward search through its ranks, all phrases of a length at once, and the
matching rows are located by walking to sampled suffix positions.  Occurrences
are merged into word spans for each document.

Documents never leave their task: there is no shuffle, and memory is bounded by
a shard (or one longer document) and a block of phrases.  The phrase set is a
stated query set, shipped in blocks of at most ``block_bytes`` of text (or one
longer item).  If there are several, each is searched by a job of its own, so
neither the driver nor a task ever holds two.

Defined cases: a null or empty text has no words; very long texts are read
whole; benchmark rows without id or without words are skipped, and with an empty
benchmark nothing is found; rows that share an item_id are one item; repeated
document rows each get their own result; an empty table gives an empty result;
other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, materialize, numbered, quoted
from .textspans import ALNUM, Words, slices, text_bytes, xxh64

WINDOW = 8
SAMPLE = 4
SHARD_BYTES = 1 << 20
BLOCK_BYTES = 2 << 20


class WaveletMatrix:
    """Ranks over a sequence of small integers, one bit vector for each bit."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for level in range(bits - 1, -1, -1):
            one = (seq >> level) & 1 == 1
            words = np.zeros(len(seq) // 64 + 2, np.uint64)
            packed = np.packbits(one, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self.levels.append((words, before, len(seq) - int(one.sum())))
            seq = np.concatenate([seq[~one], seq[one]])

    @staticmethod
    def _ones(level, i: np.ndarray) -> np.ndarray:
        words, before, _ = level
        at = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[at] + np.bitwise_count(words[at] & below)

    def rank(self, symbol: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """How often each symbol stands before each of ``ends``."""
        at = [np.zeros_like(symbol, dtype=np.int64), *ends]
        for k, level in enumerate(self.levels):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            for j, i in enumerate(at):
                ones = self._ones(level, i)
                at[j] = np.where(one, level[2] + ones, i - ones)
        return [i - at[0] for i in at[1:]]

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for level in self.levels:
            one = (level[0][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1
            ones = self._ones(level, i)
            out = out * 2 + one
            i = np.where(one, level[2] + ones, i - ones)
        return out


def suffix_array(seq: np.ndarray, symbols: int) -> np.ndarray:
    """Suffixes of ``seq`` in order; 0 is a terminator, ordered by position.

    Prefix doubling: the first sort packs as many symbols as fit 62 bits, and
    later rounds sort only suffixes that are still tied.
    """
    n = len(seq)
    stops = np.flatnonzero(seq == 0)
    at = np.flatnonzero(seq)
    width = max(1, int(symbols - 1).bit_length())
    depth = max(1, 62 // width)
    key, alive = np.zeros(len(at), np.int64), np.ones(len(at), bool)
    for k in range(depth):
        alive &= at + k < n
        s = np.where(alive, seq[np.minimum(at + k, n - 1)], 0)
        alive &= s > 0
        key = key << width | s
    order = np.argsort(key, kind="stable")
    key, ended, order = key[order], ~alive[order], at[order]
    head = np.ones(len(order), bool)
    head[1:] = (key[1:] != key[:-1]) | ended[1:]
    first = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    rank = np.zeros(n + 1, np.int64)
    rank[stops] = np.arange(len(stops))
    rank[order] = first + len(stops)
    tied = ~head
    tied[:-1] |= ~head[1:]
    slot, h = np.flatnonzero(tied), depth
    while len(slot):
        p = order[slot]
        pair = first[slot] << 32 | rank[p + h]
        sort = np.argsort(pair, kind="stable")
        p, pair = p[sort], pair[sort]
        order[slot] = p
        head = np.ones(len(slot), bool)
        head[1:] = pair[1:] != pair[:-1]
        first[slot] = np.maximum.accumulate(np.where(head, slot, 0))
        rank[p] = first[slot] + len(stops)
        tied = ~head
        tied[:-1] |= ~head[1:]
        slot, h = slot[tied], 2 * h
    return np.concatenate([stops, order])


class FMIndex:
    """Counts and locates words sequences in a sequence of symbols (0 ends a run)."""

    def __init__(self, seq: np.ndarray, symbols: int, sample: int = SAMPLE):
        sa = suffix_array(seq, symbols)
        before = np.where(sa > 0, seq[sa - 1], 0)
        self.tree = WaveletMatrix(before, max(1, int(symbols - 1).bit_length()))
        self.less = np.zeros(symbols + 1, np.int64)
        np.cumsum(np.bincount(seq, minlength=symbols), out=self.less[1:])
        # A row is sampled by its position, or where a run begins: walks never leave a run.
        kept = (sa % sample == 0) | (before == 0)
        self.kept, self.samples = kept, sa[kept]
        self.kept_before = np.cumsum(kept) - kept

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (rows of one length) that occur, and their row ranges."""
        live = np.arange(len(phrases))
        low, high = self.less[phrases[:, -1]], self.less[phrases[:, -1] + 1]
        for k in range(phrases.shape[1] - 2, -1, -1):
            found = low < high
            live, low, high = live[found], low[found], high[found]
            c = phrases[live, k]
            low, high = self.tree.rank(c, low, high)
            low, high = self.less[c] + low, self.less[c] + high
        found = low < high
        return live[found], low[found], high[found]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes at ``rows``."""
        out, steps, open_ = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(open_):
            here = rows[open_]
            done = self.kept[here]
            out[open_[done]] = self.samples[self.kept_before[here[done]]] + steps[open_[done]]
            open_, here = open_[~done], here[~done]
            c = self.tree.access(here)
            rows[open_] = self.less[c] + self.tree.rank(c, here)[0]
            steps[open_] += 1
        return out


class Phrases:
    """The windows of a block of items as symbol rows, by length, and each window's items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        data, offsets = text_bytes(pa.array([t for _, t in items], pa.large_string()))
        words = Words(data, offsets, ALNUM)
        hashes = xxh64(words.buf, words.start, words.end - words.start)
        self.vocabulary, symbol = np.unique(hashes, return_inverse=True)
        self.filter = np.zeros(1 << 16, bool)
        self.filter[self.vocabulary & np.uint64(0xFFFF)] = True
        self.names = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.names)}
        of_row = np.array([number[i] for i, _ in items])
        count = words.counts()
        begin = np.cumsum(count) - count
        by_length: dict[int, list] = {}
        for r in np.flatnonzero(count):
            size = min(window, int(count[r]))
            starts = begin[r] + np.arange(count[r] - size + 1)
            by_length.setdefault(size, []).append(((symbol[starts[:, None] + np.arange(size)] + 1).astype(np.int32), np.full(len(starts), of_row[r])))
        self.lengths = {}
        for size, parts in sorted(by_length.items()):
            rows, which = np.unique(np.concatenate([p for p, _ in parts]), axis=0, return_inverse=True)
            owner = np.unique(np.column_stack([which.ravel(), np.concatenate([o for _, o in parts])]), axis=0)
            self.lengths[size] = (rows, np.searchsorted(owner[:, 0], np.arange(len(rows) + 1)), owner[:, 1])

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words by their hashes; 0 for words of no phrase."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.filter[hashes & np.uint64(0xFFFF)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        out[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at + 1, 0)
        return out


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(begin, size)


def search_shard(data: np.ndarray, offsets: np.ndarray, phrases: Phrases):
    """Words in each row, occurrences as (row, first word, end word), and (row, item) pairs."""
    words = Words(data, offsets, ALNUM)
    count = words.counts()
    symbol = phrases.symbols(xxh64(words.buf, words.start, words.end - words.start))
    none = np.zeros((0, 3), np.int64), np.zeros((0, 2), np.int64)
    if not symbol.any():
        return count, *none
    place = np.arange(len(symbol)) + words.row  # one terminator after each row
    seq = np.zeros(len(symbol) + words.rows, np.int64)
    seq[place] = symbol
    # A stretch of other words is one terminator as good as many.
    keep = np.ones(len(seq), bool)
    keep[1:] = (seq[1:] > 0) | (seq[:-1] > 0)
    where = np.flatnonzero(keep)
    index = FMIndex(seq[where], len(phrases.vocabulary) + 1)
    spans, owners = [], []
    begin = np.cumsum(count) - count
    row_of = np.zeros(len(seq), np.int64)
    row_of[place] = words.row
    for size, (rows, first, owner) in phrases.lengths.items():
        which, low, high = index.search(rows)
        if not len(which):
            continue
        at = where[index.locate(_ragged(low, high - low))]
        row = row_of[at]
        word = at - row - begin[row]
        spans.append(np.column_stack([row, word, word + size]))
        pair = np.unique(np.column_stack([row, np.repeat(which, high - low)]), axis=0)
        each = first[pair[:, 1] + 1] - first[pair[:, 1]]
        owners.append(np.column_stack([np.repeat(pair[:, 0], each), owner[_ragged(first[pair[:, 1]], each)]]))
    if not spans:
        return count, *none
    return count, np.concatenate(spans), np.unique(np.concatenate(owners), axis=0)


def merge_spans(spans: np.ndarray) -> np.ndarray:
    """Overlapping or touching (row, start, end) spans as one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    high = 1 + int(spans[:, 2].max())
    start, end = spans[:, 0] * high + spans[:, 1], np.maximum.accumulate(spans[:, 0] * high + spans[:, 2])
    new = np.r_[True, start[1:] > end[:-1]]
    new[1:] |= spans[1:, 0] != spans[:-1, 0]
    first = np.flatnonzero(new)
    return np.column_stack([spans[first, 0], spans[first, 1], np.maximum.reduceat(spans[:, 2], first)])


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", _SPANS), T.StructField("items", T.ArrayType(T.StringType()))])


def _column(count: np.ndarray, spans: np.ndarray, items: list[list[str]]) -> pa.StructArray:
    """The result column of some rows; ``spans`` are merged (row, start, end)."""
    cut = np.searchsorted(spans[:, 0], np.arange(len(count) + 1))
    pairs = pa.StructArray.from_arrays([pa.array(spans[:, k].astype(np.int32)) for k in (1, 2)], ["start", "end"])
    return pa.StructArray.from_arrays([pa.array(count.astype(np.int64)), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pairs), pa.array(items, pa.list_(pa.string()))], ["n_words", "spans", "items"])


def _pass(docs: DataFrame, text_col: str, name: str, phrases: Phrases) -> DataFrame:
    """``docs`` with what one block of phrases finds."""
    plain = numbered(docs)
    schema = T.StructType([*plain.schema.fields, T.StructField(name, _FOUND)])
    at = docs.columns.index(text_col)
    names = np.array(phrases.names, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            for a, b in slices(offsets, SHARD_BYTES):
                count, spans, owners = search_shard(data, offsets[a : b + 1], phrases)
                item = [[] for _ in range(b - a)]
                for r, i in owners:
                    item[r].append(names[i])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, _column(count, merge_spans(spans), item)], schema.names)

    return plain.mapInArrow(run, schema).toDF(*docs.columns, name)


def _united(found: DataFrame) -> DataFrame:
    """``(row, found)`` of ``(row, n_words, spans, items)``: the blocks' findings in one row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            flat, row = spans.flatten(), np.repeat(np.arange(batch.num_rows), np.diff(spans.offsets.to_numpy()))
            merged = merge_spans(np.column_stack([row, flat.field("start").to_numpy(), flat.field("end").to_numpy()]).reshape(-1, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), _column(batch.column(1).to_numpy(), merged, [sorted(x) for x in batch.column(3).to_pylist()])], ["row", "found"])

    grouped = found.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return grouped.mapInArrow(run, T.StructType([T.StructField("row", T.LongType()), T.StructField("found", _FOUND)]))


def find_phrases(docs: DataFrame, benchmark: DataFrame, name: str, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct column ``name``: n_words, merged spans (word ranges), items found.

    With several blocks of phrases, the texts are written once with a number for each row, every block is searched by a
    job of its own that writes what it finds, and these findings meet their rows at the end.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col("text")).where("item is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("item") + 16)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))

    def phrases(k: int) -> Phrases:
        rows = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        return Phrases([(r["item"], r["text"]) for r in rows.collect()] or [("", "")], window)  # at most about block_bytes

    if blocks == 1:
        return _pass(docs, text_col, name, phrases(0))
    own, other = free_name(docs, "own_row"), free_name(docs, "found_row")
    rows = materialize(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    texts, found = rows.select(F.col(own).alias("row"), F.col(quoted(text_col)).alias("text")), None
    for k in range(blocks):
        part = _pass(texts, "text", "found", phrases(k))
        part = part.where(F.size("found.items") > 0) if k else part  # the first block gives every row its number of words
        part = materialize(part.select("row", "found.n_words", "found.spans", "found.items"), "found")
        found = part if found is None else found.unionByName(part)
    united = _united(found).select(F.col("row").alias(other), F.col("found").alias(name))
    return rows.hint("merge").join(united, F.col(own) == F.col(other)).select(*[F.col(quoted(c)) for c in docs.columns], F.col(quoted(name)))


def n_hit(name: str) -> Column:
    return F.aggregate(F.col(f"{name}.spans"), F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]).cast("long"))


def contaminated(name: str, least: int = 2) -> Column:
    """Whether passages of at least ``least`` items occur."""
    return F.size(f"{name}.items") >= least


def remove_spans(found: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """``found`` without the column ``name``, and without the words of its spans in the texts.

    What stands between the words stays; texts without a span are passed through.
    """
    plain = numbered(found)
    at, mark = found.columns.index(text_col), found.columns.index(name)
    kept = [k for k in range(len(found.columns)) if k != mark]
    schema = T.StructType([plain.schema.fields[k] for k in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k) for k in kept]
            spans = batch.column(mark).field("spans")
            hit = np.flatnonzero(np.diff(spans.offsets.to_numpy()))
            if len(hit):
                texts = batch.column(at).to_pylist()
                for r in hit.tolist():
                    data, offsets = text_bytes(pa.array([texts[r]], pa.large_string()))
                    words, out, last = Words(data, offsets, ALNUM), bytearray(), 0
                    raw = data.tobytes()
                    for span in spans[r].as_py():
                        out += raw[last : words.start[span["start"]]]
                        last = int(words.end[span["end"] - 1])
                    texts[r] = (bytes(out) + raw[last:]).decode()
                columns[kept.index(at)] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return plain.mapInArrow(run, schema).toDF(*[c for c in found.columns if c != name])
