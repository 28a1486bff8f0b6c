"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, each run of other characters than letters becomes one
space, and the 1- to 3-grams of its code points are hashed to BUCKETS counts.
The log-probability matrix (languages x BUCKETS) is fitted on a bounded sample
of labelled rows and broadcast; batches are scored sparsely in numpy: non-zero
counts times their matrix rows, summed by text.

Scale.  Fitting gathers languages x BUCKETS counts, whatever the input; scoring
is one pass without a shuffle, whose memory is bounded by the slice of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, discard, slices, texts

BUCKETS = 1 << 14
#: Labelled rows that the model is fitted on, about.
FIT_ROWS = 8000
#: Grams after which further ones weigh less in the score: it is a probability, not a certainty.
TEMPER = 40.0
UNDECIDED = "und"

#: Letters by code point; beyond the last one there are none.
_ALPHA = np.array([chr(c).isalpha() for c in range(0x32400)] + [False])
_M = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def letters(text: str) -> np.ndarray:
    """Code points, letters kept and each run of others one space, one space at either end."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ok = _ALPHA[np.minimum(x, len(_ALPHA) - 1)]
    keep = ok.copy()
    keep[1:] |= ok[:-1]
    x = np.where(ok, x, np.uint32(32))[keep]
    pad = np.array([32], np.uint32)
    return np.concatenate([pad, x, pad]) if len(x) and x[-1] != 32 else np.concatenate([pad, x])


def counts(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse counts (text, bucket, count) in order of text, and which texts have letters."""
    parts = [letters(t) for t in batch]
    has = np.array([len(p) > 1 for p in parts], bool)
    x = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    keys, h = [], np.zeros(len(x), np.uint32)
    for k in range(3):
        m = len(x) - k
        if m <= 0:
            break
        h = (h[:m] * _M[1] if k else np.zeros(m, np.uint32)) + x[k:] * _M[0]
        g = h ^ (h >> np.uint32(15))
        g = (g * _M[2]) >> np.uint32(32 - 14)
        inside = of[:m] == of[k:]
        keys.append((of[:m] * BUCKETS + g)[inside])
    dense = np.bincount(np.concatenate(keys), minlength=len(parts) * BUCKETS) if keys else np.zeros(0, np.int64)
    at = np.flatnonzero(dense)
    return at // BUCKETS, at % BUCKETS, dense[at], has


@dataclass
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # BUCKETS x languages
    prior: np.ndarray

    def score(self, batch: list[str]) -> tuple[list[str], np.ndarray]:
        """Language (or `und`) and its probability for each text."""
        if not self.languages:
            return [UNDECIDED] * len(batch), np.zeros(len(batch))
        row, bucket, n, has = counts(batch)
        total = np.zeros((len(batch), len(self.languages)))
        size = np.zeros(len(batch))
        if len(row):
            heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            total[row[heads]] = np.add.reduceat(self.log_p[bucket] * n[:, None], heads)
            size[row[heads]] = np.add.reduceat(n, heads)
        total = total / np.maximum(1.0, size / TEMPER)[:, None] + self.prior / np.maximum(1.0, size)[:, None]
        best = total.argmax(axis=1)
        p = np.exp(total - total.max(axis=1, keepdims=True))
        p = p.max(axis=1) / p.sum(axis=1)
        return [self.languages[k] if ok else UNDECIDED for k, ok in zip(best, has)], np.where(has, p, 0.0)


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> LanguageModel:
    """Fit on about `fit_rows` rows of (doc_id, text, lang), taken by a hash of doc_id and text.

    Rows without language or text don't count; repeated rows count each, very
    long texts whole.  Without any row there is no language, and every text is
    undecided.
    """
    rows = bounded_sample(labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang"), fit_rows, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for b in slices(batches, "text", 64):
            langs = np.array(b.column("lang").to_pylist(), object)
            row, bucket, c, _ = counts(texts(b.column("text")))
            for lang in set(langs):
                mine = (langs == lang)[row]
                held[lang] = held.get(lang, np.zeros(BUCKETS, np.int64)) + np.bincount(bucket[mine], c[mine], BUCKETS).astype(np.int64)
                docs[lang] = docs.get(lang, 0) + int((langs == lang).sum())
        for lang, c in held.items():
            at = np.flatnonzero(c)
            at, c = np.r_[at, -1], np.r_[c[at], docs[lang]]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int64()), pa.array(c, pa.int64())], ["lang", "bucket", "n"])

    got = rows.mapInArrow(run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    discard(rows)
    languages = sorted(got["lang"].unique())
    at = {x: k for k, x in enumerate(languages)}
    table, docs = np.zeros((BUCKETS, len(languages))), np.ones(len(languages))
    for lang, part in got.groupby("lang"):
        b, n = part["bucket"].to_numpy(), part["n"].to_numpy()
        table[b[b >= 0], at[lang]] = n[b >= 0]
        docs[at[lang]] = n[b < 0].sum()
    table += 0.5
    return LanguageModel(languages, np.log(table / table.sum(axis=0)), np.log(docs / docs.sum()))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every row of (doc_id, text).

    `und` and 0 where a text is null or has no letter; ties go to the language
    first in order.  A very long text is read whole.  Rows that repeat, also
    with the same or no doc_id, stay apart; an empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 64):
            lang, p = shared.value.score(texts(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(p, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


#: Least probability of the language of a text that stays.
LEAST_SCORE = 0.5


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs whose language is decided, with probability `least` or more, with all their columns.

    Null texts and texts without a letter go.  Each row is judged by its own
    text, whatever its doc_id (null, repeated).  A model without languages
    rejects only texts without letters.  An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 64):
            batch = texts(b.column("text"))
            if shared.value.languages:
                lang, p = shared.value.score(batch)
                keep = [x != UNDECIDED and s >= least for x, s in zip(lang, p)]
            else:
                keep = [len(letters(t)) > 1 for t in batch]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
