"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Tokens are runs of letters and digits (A-Z lower-cased) and runs of other
ASCII; each word of capitals adds a token that says so.  A token's vector is
the sum of the sparse random index vectors of its neighbours within CONTEXT
places, scaled to length one, in a table of BUCKETS hashed rows.  A document is
the mean of its tokens' vectors and of their own index vectors, the share of
tokens whose vector comes again LAGS places on (means alone don't see words
that are repeated in a row), and two features of size; a tanh layer and a logistic output score it.  The logit is
divided by a temperature fitted on rows kept apart.

Scale.  Vectors and network are fitted on a bounded sample; at most
FIT_PARTITIONS tables of fixed size and FIT_ROWS pooled vectors reach the
driver.  Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import bounded_sample, discard, slices

BUCKETS, WIDTH, CONTEXT, NONZERO = 1 << 14, 24, 2, 4
#: Distances at which a token's vector is compared with a later one.
LAGS = (1, 2, 3, 4, 6, 8)
FEATURES = 2 * WIDTH + len(LAGS) + 2
HIDDEN = 24
#: Labelled rows that the model is fitted on, about, and the partitions they are read in.
FIT_ROWS, FIT_PARTITIONS = 16_000, 6
EPOCHS, STEP, DECAY = 400, 0.02, 5e-4
_U = np.uint64
_CAPS = _U(0x1234567)


def _index_vectors() -> np.ndarray:
    """Fixed sparse ternary vector of every bucket."""
    rng = np.random.Generator(np.random.PCG64(7))
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    for k in range(NONZERO):
        out[np.arange(BUCKETS), rng.integers(0, WIDTH, BUCKETS)] += rng.choice(np.array([-1, 1], np.float32), BUCKETS)
    return out / np.sqrt(NONZERO)


INDEX = _index_vectors()


def token_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each token, and offsets by text."""
    h, kind, upper, off, _ = tokens.runs(*tokens.utf8(column))
    bucket = (h & _U(BUCKETS - 1)).astype(np.int64)
    caps = np.flatnonzero((kind == 1) & (upper >= 2))
    if len(caps):
        bucket = np.insert(bucket, caps + 1, int(_CAPS & _U(BUCKETS - 1)))
        off = off + np.searchsorted(caps, off)
    return bucket, off


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of rows by text; a text without rows has zeros."""
    out = np.zeros((len(off) - 1, values.shape[1]), np.float32)
    full = np.flatnonzero(np.diff(off) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, off[:-1][full])
    return out


def pooled(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """Features of each text."""
    bucket, off = token_buckets(column)
    n = np.diff(off).astype(np.float32)
    mean = _sums(table[bucket], off) / np.maximum(n, 1)[:, None]
    of = np.repeat(np.arange(len(n)), np.diff(off))
    again = np.zeros((len(n), len(LAGS)))
    for c, k in enumerate(LAGS):
        same = (bucket[k:] == bucket[:-k]) & (of[k:] == of[:-k])
        again[:, c] = np.bincount(of[k:][same], minlength=len(n)) / np.maximum(n - k, 1)
    return np.concatenate([mean, again, np.log1p(n)[:, None] / 8, (n == 0)[:, None]], axis=1).astype(np.float64)


@dataclass
class QualityModel:
    table: np.ndarray  # BUCKETS x 2 WIDTH: context and index vectors
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def score(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        z = np.tanh(((x - self.mean) / self.scale) @ a + b) @ c + d
        return 1 / (1 + np.exp(-np.clip(z[:, 0] / self.temperature, -30, 30)))


def _train(x: np.ndarray, y: np.ndarray, hidden: int) -> list[np.ndarray]:
    """Two-layer network by Adam on the log loss, whole batch."""
    rng = np.random.Generator(np.random.PCG64(11))
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, 1)), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    for t in range(1, EPOCHS + 1):
        h = np.tanh(x @ w[0] + w[1])
        p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30)))
        e = (p - y[:, None]) / len(y)
        back = (e @ w[2].T) * (1 - h * h)
        grads = [x.T @ back + DECAY * w[0], back.sum(0), h.T @ e + DECAY * w[2], e.sum(0)]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - STEP * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """Temperature of least log loss on rows kept apart."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.logaddexp(0, np.where(y == 1, -z, z) / t).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> QualityModel:
    """Fit on about `fit_rows` rows of (doc_id, text, label), taken by a hash of doc_id and text.

    Rows with a null label don't count; null texts count as empty, very long
    ones whole, repeated rows each.  Without any row every score is 0.5.
    """
    rows = labelled.where("label is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("double").alias("label"))
    sample = bounded_sample(rows, fit_rows, "doc_id", "text")
    rows = sample.coalesce(FIT_PARTITIONS)  # of the few sampled rows, not of the corpus

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, WIDTH))
        for b in slices(batches, "text"):
            bucket, off = token_buckets(b.column("text"))
            of = np.repeat(np.arange(b.num_rows), np.diff(off))
            for k in range(1, CONTEXT + 1):
                ok = of[k:] == of[:-k]
                left, right = bucket[:-k][ok], bucket[k:][ok]
                pair = np.unique(np.concatenate([left * BUCKETS + right, right * BUCKETS + left]), return_counts=True)
                np.add.at(total, pair[0] // BUCKETS, INDEX[pair[0] % BUCKETS] * np.log1p(pair[1])[:, None])
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([total[k].tobytes() for k in at], pa.binary())], ["bucket", "vector"])

    table = np.zeros((BUCKETS, WIDTH))
    for bucket, vector in rows.mapInArrow(context, "bucket bigint, vector binary").toPandas().itertuples(index=False):
        table[bucket] += np.frombuffer(vector)
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    table = np.concatenate([table, INDEX], axis=1).astype(np.float32)
    shared = labelled.sparkSession.sparkContext.broadcast(table)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x = pooled(b.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    got = rows.mapInArrow(features, "doc_id bigint, label double, x binary").toPandas().sort_values("doc_id", kind="stable")
    discard(sample)
    if not len(got):
        return QualityModel(table, np.zeros(FEATURES), np.ones(FEATURES), [np.zeros((FEATURES, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1.0)
    x, y = np.array([np.frombuffer(r) for r in got["x"]]), got["label"].to_numpy()
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = (x - mean) / scale
    apart = np.arange(len(y)) % 8 == 5
    if not 0 < apart.sum() < len(y):
        apart = np.zeros(len(y), bool)
    layers = _train(z[~apart], y[~apart], HIDDEN)
    model = QualityModel(table, mean, scale, layers, 1.0)
    if apart.any():
        p = np.clip(model.score(x[apart]), 1e-12, 1 - 1e-12)
        model.temperature = _temperature(np.log(p / (1 - p)), y[apart])
    return model


def predict(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score, the calibrated probability of label 1, of every row of (doc_id, text).

    A null text counts as empty; a very long one is read whole.  Rows that
    repeat, also with the same or no doc_id, stay apart and get equal scores
    for equal texts.  An empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            p = shared.value.score(pooled(b.column("text"), shared.value.table))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, score double")
