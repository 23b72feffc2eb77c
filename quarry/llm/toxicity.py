"""Toxicity scores: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams; their embeddings are averaged and
go through a linear softmax.  Embeddings and softmax are trained jointly in
numpy.  Labels are on documents, so training is multiple-instance: in a toxic
document the ``TOP`` most toxic distinct words stand for it, in a clean one
every word is an example of the other class, and the choice is repeated as the
model improves.  A word that clean documents hold too can be chosen if its share
among toxic ones is ``PURE`` of both shares, so a mislabelled document or a quote
does not remove it; its clean occurrences are examples against it.  A word that was never seen, a misspelling or another ending,
shares n-gram vectors with those that were.

A text's score is a logistic function of its two highest word scores, fitted
on the fifth of the sample that the words were not trained on and moved to the
labels' true proportion.  Averaging and softmax input are linear, so the
executors get one table of logits by bucket (4 bytes each).  Every whole text
is scored in its own task; nothing is shuffled.

Very long texts are read whole.

Defined cases: null and empty texts, and texts without a word, get the score of
a text whose words are all clean; if only one label, or none, can be learnt from,
every score is the share of toxic rows (0 without any).  Labels of documents
that do not exist, and null labels, are ignored; several labels of one document
count as several rows, and repeated rows are scored alike; of words with equal
scores the first stands for a text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import numbered
from .subword import Grams, labelled_sample, train_rows
from .textspans import NOT_BLANK, slices, text_bytes

SIZES = (3, 4, 5)
BITS = 17
DIM = 16
PER_LABEL = 1000
BYTE_BUDGET = 8 << 20
ROUNDS = 3
EPOCHS = 6
TOP = 2
FLOOR = -12.0
THRESHOLD = 0.3
PURE = 0.75


@dataclass
class ToxModel:
    table: np.ndarray | None  # logit by bucket
    bias: float = 0.0
    doc: np.ndarray = field(default_factory=lambda: np.zeros(3))  # weights of the top two word scores, and 1

    def word_scores(self, g: Grams) -> np.ndarray:
        n = len(g.word_row)
        total = np.bincount(g.word, weights=self.table[g.bucket], minlength=n)
        return np.clip(total / np.maximum(np.bincount(g.word, minlength=n), 1) + self.bias, FLOOR, -FLOOR)

    def row_features(self, g: Grams) -> np.ndarray:
        """The two highest word scores of each row."""
        out = np.full((g.rows, 2), FLOOR)
        z = self.word_scores(g)
        if len(z):
            rows, first = np.unique(g.word_row, return_index=True)
            out[rows, 0] = np.maximum.reduceat(z, first)
            best = np.repeat(out[rows, 0], np.diff(np.r_[first, len(z)]))
            # The first of the best words is put aside for the second highest.
            top = np.flatnonzero(z == best)
            _, keep = np.unique(g.word_row[top], return_index=True)
            z[top[keep]] = FLOOR
            out[rows, 1] = np.maximum.reduceat(z, first)
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.table is None:
            return np.full(len(offsets) - 1, self.bias)
        x = self.row_features(Grams(data, offsets, NOT_BLANK, SIZES, BITS))
        return 1 / (1 + np.exp(-np.clip(x @ self.doc[:2] + self.doc[2], -40, 40)))


def _vocabulary(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """N-grams of each distinct word, and the distinct words of each row."""
    data, offsets = text_bytes(texts)
    index: dict[bytes, int] = {}
    grams, rows = [], []
    for a, b in slices(offsets):
        g = Grams(data, offsets[a : b + 1], NOT_BLANK, SIZES, BITS)
        words = g.word_texts()
        new = [k for k, w in enumerate(words) if index.setdefault(w, len(index)) == len(index) - 1]
        ids = np.array([index[w] for w in words], np.int64)
        order = np.argsort(g.word, kind="stable")
        cut = np.searchsorted(g.word[order], np.arange(len(words) + 1))
        first: dict[int, int] = {}
        for k in new:
            first.setdefault(int(ids[k]), k)
        for wid in range(len(grams), len(index)):
            k = first[wid]
            grams.append(g.bucket[order[cut[k] : cut[k + 1]]])
        row_cut = np.searchsorted(g.word_row, np.arange(b - a + 1))
        rows += [np.unique(ids[row_cut[k] : row_cut[k + 1]]) for k in range(b - a)]
    return grams, rows


class _Bags:
    """N-grams of words as one ragged array."""

    def __init__(self, grams: list[np.ndarray]):
        self.size = np.array([len(x) for x in grams], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.bucket = np.concatenate(grams) if grams else np.zeros(0, np.int32)

    def take(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[words]
        ends = np.cumsum(size)
        return self.bucket[np.arange(int(ends[-1])) + np.repeat(self.at[words] - (ends - size), size)], np.repeat(np.arange(len(words)), size)

    def mean(self, table: np.ndarray) -> np.ndarray:
        return np.add.reduceat(table[self.bucket], np.minimum(self.at, max(len(self.bucket) - 1, 0))) / np.maximum(self.size, 1)


def _fit_words(bags: _Bags, words: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Embeddings and softmax of word classes by Adagrad; returns logits by bucket and a bias."""
    emb = rng.uniform(-0.5 / DIM, 0.5 / DIM, (1 << BITS, DIM)).astype(np.float32)
    w = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    ge, gw, gb = np.full(1 << BITS, 1e-8, np.float32), np.full(w.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(words)), max(1, len(words) // 1024)):
            bucket, of = bags.take(words[part])
            n = np.bincount(of, minlength=len(part)).astype(np.float32)
            start = np.cumsum(n).astype(np.int64) - n.astype(np.int64)
            h = np.add.reduceat(emb[bucket], start, axis=0) / n[:, None]
            z = h @ w + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            dw, dh, db = h.T @ p, (p @ w.T) / n[:, None], p.sum(0)
            order = np.argsort(bucket, kind="stable")
            one, first = np.unique(bucket[order], return_index=True)
            de = np.add.reduceat(dh[of[order]], first, axis=0)
            ge[one] += (de**2).mean(1)
            emb[one] -= 0.3 * de / np.sqrt(ge[one])[:, None]
            gw += dw**2
            w -= 0.1 * dw / np.sqrt(gw)
            gb += db**2
            bias -= 0.1 * db / np.sqrt(gb)
    return emb @ (w[:, 1] - w[:, 0]), float(bias[1] - bias[0])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by Newton's method, with an intercept that is not penalised."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), ridge * np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(sample: pa.Table, share: float, seed: int = 23) -> ToxModel:
    """Fit on ``sample(text, label)``; ``share`` is the labels' true share of toxic rows."""
    y = np.array([int(v == "1") for v in sample["label"].to_pylist()], np.int64)
    if len(y) < 10 or min(y.sum(), len(y) - y.sum()) < 2:
        return ToxModel(None, float(share))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cal, fit = order[: len(y) // 5], order[len(y) // 5 :]
    grams, rows = _vocabulary(sample["text"])
    if not grams:
        return ToxModel(None, float(share))
    bags = _Bags(grams)
    toxic, clean = fit[y[fit] == 1], fit[y[fit] == 0]
    # In how many toxic and clean documents a word's n-grams occur: the first guess.
    seen = np.zeros((2, 1 << BITS))
    for r in fit:
        if len(rows[r]):
            seen[y[r], np.unique(bags.take(rows[r])[0])] += 1
    guess = np.log((seen[1] + 0.5) / (len(toxic) + 1)) - np.log((seen[0] + 0.5) / (len(clean) + 1))
    z = bags.mean(guess)
    in_clean = np.unique(np.concatenate([rows[r] for r in clean])) if len(clean) else np.zeros(0, np.int64)
    # The share of a word's occurrences (by documents, classes weighing alike) that are in toxic documents.
    held = np.zeros((2, len(grams)))
    for r in fit:
        held[y[r], rows[r]] += 1
    held /= np.array([[max(1, len(clean))], [max(1, len(toxic))]])
    mark = held[1] < PURE * (held[0] + held[1])
    table, bias = guess.astype(np.float32), 0.0
    for _ in range(ROUNDS):
        score = np.where(mark, -np.inf, z)
        picks = [rows[r][np.argsort(-score[rows[r]], kind="stable")[:TOP]] for r in toxic if len(rows[r])]
        pos = np.concatenate(picks) if picks else np.zeros(0, np.int64)
        pos = pos[~mark[pos]]
        if not len(pos):
            break
        hard = in_clean[np.argsort(-z[in_clean], kind="stable")[: 4 * len(pos)]]
        easy = rng.choice(in_clean, min(len(in_clean), 16 * len(pos)), replace=False)
        words = np.concatenate([pos, pos, hard, easy])
        table, bias = _fit_words(bags, words, np.repeat([1, 0], [2 * len(pos), len(hard) + len(easy)]), rng)
        z = bags.mean(table) + bias
    model = ToxModel(table.astype(np.float32), bias)
    if not len(cal) or min(y[cal].sum(), len(cal) - y[cal].sum()) < 2:
        cal = fit
    data, offsets = text_bytes(sample["text"].take(pa.array(cal)))
    x = np.concatenate([model.row_features(Grams(data, offsets[a : b + 1], NOT_BLANK, SIZES, BITS)) for a, b in slices(offsets)])
    model.doc = _logistic(x, y[cal])
    rate = y[cal].mean()
    model.doc[2] += np.log(max(share, 1e-6) / max(1 - share, 1e-6)) - np.log(rate / (1 - rate))
    return model


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, byte_budget: int = BYTE_BUDGET) -> ToxModel:
    """Learn ``labels.toxic`` of the rows that may be learnt from."""
    known = labels.where(train_rows()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    count = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = count.get(1, 0) / max(1, sum(count.values()))
    # Labels are thinned before the join, so what meets the texts is bounded.
    scale = 1 << 30
    rate = F.create_map(*[x for k in (0, 1) for x in (F.lit(k), F.lit(int(min(1.0, 2 * per_label / max(1, count.get(k, 0))) * scale)))])
    some = known.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(scale)) < rate[F.col("toxic")])
    rows = docs.where(train_rows()).select("doc_id", "text").join(F.broadcast(some), "doc_id")
    return train(labelled_sample(rows, "toxic", per_label, byte_budget), share)


def score(docs: DataFrame, model: ToxModel, name: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with the column ``name``, a probability."""
    at = docs.columns.index(text_col)
    plain = numbered(docs)
    schema = T.StructType([*plain.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            p = [model.scores(data, offsets[a : b + 1]) for a, b in slices(offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(p) if p else np.zeros(0))], schema.names)

    return plain.mapInArrow(run, schema).toDF(*docs.columns, name)
