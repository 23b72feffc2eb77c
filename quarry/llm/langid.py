"""Language identification: averaged hashed subword embeddings and a linear softmax.

The model is trained by stochastic gradient descent in numpy on a bounded
sample of labelled rows (``PER_LABEL`` rows of each language, ``BYTE_BUDGET``
bytes, of which no language falls below ``LEAST_ROWS`` rows that it has), then its temperature and its score threshold are calibrated on a
fifth of the sample that was not trained on.  As averaging and softmax input
are linear, embeddings and weights are folded into one table of logits by
bucket, which is all that the executors get (buckets x languages, 4 bytes
each).  Every whole text is scored in its own task; nothing is shuffled.

A softmax cannot tell that a text is in none of its languages.  A text's fit is
the mean log-probability of its n-grams in the language that is predicted, less
what is usual there, and is damped to nothing in very short texts (``DAMP``).
Its threshold is calibrated on the sample in folds, against held-out languages:
each row is fitted by the other folds, and also with its own language left out.
It lies halfway between what these reach and what the sample's rows do not go
below (all but ``FALSE_REJECTION`` of them), or at the latter where they overlap.
With one language nothing can be held out, and no text is rejected for its fit.

Defined cases: a null text, or one without any letter, is ``und`` with score 0;
with no labelled row at all every text is ``und``.  Rows without doc_id are
never learnt from, and are scored like any other.  Very long texts are read
whole, repeated rows get equal results, of languages that score alike the first
by name is given, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import numbered
from .subword import LETTERS, Grams, labelled_sample, train_rows
from .textspans import slices, text_bytes

SIZES = (2, 3, 4)
BITS = 14
DIM = 16
PER_LABEL = 600
BYTE_BUDGET = 12 << 20
EPOCHS = 12
FALSE_REJECTION = 0.001
DAMP = 32
UNDETERMINED = "und"
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


@dataclass
class LangModel:
    labels: list[str]
    table: np.ndarray  # logits by bucket, temperature included
    bias: np.ndarray
    threshold: float
    typical: np.ndarray  # log-probabilities by bucket, less the usual of the language
    floor: float

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best label of each row, its score, and how the row fits it."""
        g = Grams(data, offsets, LETTERS, SIZES, BITS)
        row = g.word_row[g.word]
        n = np.bincount(row, minlength=g.rows)
        total = np.column_stack([np.bincount(row, weights=self.table[:, c][g.bucket], minlength=g.rows) for c in range(len(self.labels))])
        z = _softmax(total / np.maximum(n, 1)[:, None] + self.bias)
        best = z.argmax(1)
        at = g.bucket * np.int32(len(self.labels)) + best.astype(np.int32)[row]
        fit = np.bincount(row, weights=self.typical.ravel()[at], minlength=g.rows) / (n + DAMP)
        return best, z[np.arange(len(best)), best], fit


def _features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Buckets of each text, their shares, and how many n-grams it has."""
    data, offsets = text_bytes(texts)
    out = []
    for a, b in slices(offsets):
        g = Grams(data, offsets[a : b + 1], LETTERS, SIZES, BITS)
        row = g.word_row[g.word].astype(np.int64)
        pair, count = np.unique(row << BITS | g.bucket, return_counts=True)
        cut = np.searchsorted(pair >> BITS, np.arange(b - a + 1))
        for k in range(b - a):
            c = count[cut[k] : cut[k + 1]].astype(np.float32)
            out.append((pair[cut[k] : cut[k + 1]] & ((1 << BITS) - 1), c / max(c.sum(), 1), float(c.sum())))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _typical(x: list[tuple[np.ndarray, np.ndarray, float]], y: np.ndarray, folds: list[np.ndarray], n: int, best: np.ndarray) -> tuple[np.ndarray, float]:
    """Log-probabilities of n-grams in each language less the usual one, and the least fit that is not rejected.

    ``best`` is the language that the softmax predicts for each row.
    """

    def count(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((n, 1 << BITS))
        for r in rows:
            out[y[r], x[r][0]] += x[r][1] * x[r][2]
        return out

    def log_share(c: np.ndarray) -> np.ndarray:
        return np.log((c + 0.5) / (c.sum(1, keepdims=True) + 0.5 * (1 << BITS)))

    every = count(np.arange(len(y)))
    mean, grams = np.zeros((len(y), n)), np.array([v[2] for v in x])
    for rows in folds:  # each row by the others
        seen = log_share(np.maximum(every - count(rows), 0))
        for r in rows:
            mean[r] = seen[:, x[r][0]] @ x[r][1]
    usual = np.array([np.average(mean[y == k, k], weights=grams[y == k] + 1e-9) for k in range(n)])
    typical = (log_share(every) - usual[:, None]).T.astype(np.float32)
    fits = (mean - usual) * (grams / (grams + DAMP))[:, None]
    right = np.flatnonzero(grams > 0)
    own = fits[right, best[right]]  # of every row, mixed and noisy ones too: it is what rejection will look at
    fits[np.arange(len(y)), y] = -np.inf
    other = fits[right].max(1)[grams[right] > DAMP]
    if n < 2 or not len(other):
        return typical, -np.inf
    low, high = np.quantile(own, FALSE_REJECTION), np.quantile(other, 1 - FALSE_REJECTION)
    return typical, float(min(low, (low + high) / 2))


def train(sample: pa.Table, seed: int = 17) -> LangModel:
    """Fit on ``sample(text, label)``."""
    names = sorted(set(sample["label"].to_pylist()))
    if not names:
        return LangModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 0.0, np.zeros((1 << BITS, 0), np.float32), 0.0)
    y = np.array([names.index(v) for v in sample["label"].to_pylist()])
    x = _features(sample["text"])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cal, fit = order[: len(y) // 5], order[len(y) // 5 :]
    emb = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32)
    ge, gw = np.full(emb.shape, 1e-6, np.float32), np.full(w.shape, 1e-6, np.float32)

    def dense(rows: np.ndarray) -> np.ndarray:
        m = np.zeros((len(rows), 1 << BITS), np.float32)
        for k, r in enumerate(rows):
            m[k, x[r][0]] = x[r][1]
        return m

    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(fit), max(1, len(fit) // 32)):
            m = dense(rows)
            h = m @ emb
            err = _softmax(h @ w + bias)
            err[np.arange(len(rows)), y[rows]] -= 1
            dw, dh = h.T @ err, err @ w.T
            de = m.T @ dh
            gw += dw**2
            ge += de**2
            w -= 0.2 * dw / np.sqrt(gw)
            emb -= 0.2 * de / np.sqrt(ge)
            bias -= 0.02 * err.sum(0)
    check = cal if len(cal) else fit
    z = np.concatenate([dense(rows) @ emb @ w + bias for rows in np.array_split(check, max(1, len(cal) // 64))])
    truth = y[check]
    heat = np.geomspace(0.1, 10, 41)
    loss = [-np.log(_softmax(z * t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in heat]
    t = heat[int(np.argmin(loss))]
    p = _softmax(z * t)
    hit = p.argmax(1) == truth
    # Near-uniform scores are rejected, and those below the score that FALSE_REJECTION of the right calibration
    # rows do not reach: the k-th least, as fewer than 1 / FALSE_REJECTION rows say nothing about so small a part.
    sure = np.sort(p.max(1)[hit])
    k = int(FALSE_REJECTION * (len(sure) + 1))
    uniform = min(float(np.quantile(sure, FALSE_REJECTION)), 1.2 / max(2, len(names))) if len(sure) else 0.0
    threshold = max(uniform, float(sure[k - 1])) if k else uniform
    best = np.concatenate([(dense(rows) @ emb @ w + bias).argmax(1) for rows in np.array_split(np.arange(len(y)), max(1, len(y) // 64))])
    typical, floor = _typical(x, y, np.array_split(order, min(5, len(y))), len(names), best)
    return LangModel(names, (emb @ w * t).astype(np.float32), bias * t, threshold, typical, floor)


def fit(docs: DataFrame, per_label: int = PER_LABEL, byte_budget: int = BYTE_BUDGET) -> LangModel:
    """Learn from text and non-null lang of the rows that may be learnt from."""
    return train(labelled_sample(docs.where(train_rows()), "lang", per_label, byte_budget))


def _lettered(texts: pa.Array, grams: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with a letter.  Rows whose words have no ASCII letter are looked at by character."""
    ascii_letter = LETTERS.copy()
    ascii_letter[128:] = False
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum(ascii_letter[data], out=seen[1:])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for k in np.flatnonzero(~out & grams):
        out[k] = any(c.isalpha() for c in texts[int(k)].as_py())
    return out


def identify(docs: DataFrame, model: LangModel, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``name``: lang_pred, score, rejected."""
    at = docs.columns.index(text_col)
    plain = numbered(docs)
    schema = T.StructType([*plain.schema.fields, T.StructField(name, RESULT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.array([*model.labels, UNDETERMINED], dtype=object)
        for batch in batches:
            texts = batch.column(at)
            data, offsets = text_bytes(texts)
            lang, score, fits = [], [], []
            for a, b in slices(offsets):
                part = offsets[a : b + 1]
                if model.labels:
                    best, p, fit = model.predict(data, part)
                else:
                    best, p, fit = np.zeros(b - a, np.int64), np.zeros(b - a), np.zeros(b - a)
                some = _lettered(texts.slice(a, b - a), np.diff(part) > 0, data[part[0] : part[-1]], part - part[0]) if model.labels else np.zeros(b - a, bool)
                lang.append(np.where(some, best, len(model.labels)))
                score.append(np.where(some, p, 0.0))
                fits.append(fit)
            best, p, fit = (np.concatenate(c) for c in (lang, score, fits)) if lang else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
            rejected = (best == len(model.labels)) | (p < model.threshold) | (fit < model.floor)
            column = pa.StructArray.from_arrays([pa.array(labels[best], pa.string()), pa.array(p, pa.float64()), pa.array(rejected)], ["lang_pred", "score", "rejected"])
            yield pa.RecordBatch.from_arrays([*batch.columns, column], schema.names)

    return plain.mapInArrow(run, schema).toDF(*docs.columns, name)
