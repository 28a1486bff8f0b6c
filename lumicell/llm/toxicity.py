"""Toxicity: a linear classifier regularised by counterfactual swaps of identity terms.

Features are hashed words (A-Z lower-cased, punctuation split off) and hashed
word beginnings of four and five bytes, each present or not in a text.  The
FEATURES most telling ones are picked by smoothed log odds, the identity terms
are always among them, and a logistic regression is fitted with a penalty on

    (score of a sentence - score of its counterfactual) ** 2

over labelled sentences.  Where a sentence names a group, its counterfactuals
name every time another of the same kind and language instead.  Where it names
none, a term is put into it, so that the penalty works in corpora that hardly
name groups: counterfactuals of the plain sentence name one, and of that one
another.  Score changes that only the named group makes are so pushed to zero,
and neutral mentions don't raise the score.

Scale.  Fitting uses a bounded sample, written once: counts of BUCKETS features,
FIT_ROWS short lists of picked features and SWAP_PAIRS pairs of them reach the
driver.  Scoring is one pass.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import bounded_sample, discard, slices

BUCKETS, FEATURES = 1 << 19, 768
#: Bytes of the word beginnings that are features.
PREFIXES = (4, 5)
#: Labelled rows that the model is fitted on, about.
FIT_ROWS = 20_000
#: Pairs of a sentence and its counterfactual, at most, how many one text gives, and the weight of their penalty.
SWAP_PAIRS, SWAPS, SWAP_WEIGHT = 4000, 4, 4.0
#: Words of the sentences that counterfactuals are made from.
SWAP_WORDS = (2, 60)
EPOCHS, STEP, DECAY = 300, 0.1, 1e-5
#: Texts of the positive class that a feature must occur in.
LEAST_TEXTS = 3

#: Terms that name groups neutrally, by kind and language; a term is swapped within its list.
IDENTITY = {
    "belief en": "christian muslim jewish hindu buddhist sikh catholic protestant atheist".split(),
    "belief de": "christ christin muslim muslima jude jüdin hindu buddhist katholik protestantin atheist".split(),
    "belief fr": "chrétien chrétienne musulman musulmane juif juive hindou bouddhiste catholique athée".split(),
    "belief es": "cristiano cristiana musulmán musulmana judío judía hindú budista católico atea".split(),
    "origin en": "african american asian european latino mexican arab indian chinese german french spanish".split(),
    "origin de": "afrikaner amerikanerin asiate europäerin araberin inder chinesin türke polin".split(),
    "origin fr": "africain américaine asiatique européen arabe indienne chinois algérien polonaise".split(),
    "origin es": "africano americana asiático europea árabe indio china marroquí mexicana".split(),
    "gender en": "women men woman man girls boys female male nonbinary".split(),
    "gender de": "frauen männer frau mann mädchen jungen weiblich männlich".split(),
    "gender fr": "femmes hommes femme homme filles garçons".split(),
    "gender es": "mujeres hombres mujer hombre chicas chicos".split(),
    "orientation en": "gay lesbian bisexual straight queer transgender".split(),
    "orientation de": "schwul lesbisch bisexuell heterosexuell queer transgeschlechtlich".split(),
    "orientation fr": "gay lesbienne bisexuel hétérosexuelle transgenre".split(),
    "orientation es": "gay lesbiana bisexual heterosexual transgénero".split(),
    "other en": "black white brown immigrant immigrants refugee refugees elderly young disabled blind deaf".split(),
    "other de": "schwarze weiße einwanderer flüchtling geflüchtete behinderte blinde gehörlose".split(),
    "other fr": "noire blanche immigré immigrée réfugié réfugiée handicapé aveugle sourde".split(),
    "other es": "negra blanca inmigrante refugiado refugiada discapacitado ciega sorda".split(),
}
_U = np.uint64


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct feature buckets of each text, and offsets."""
    data, offsets = tokens.utf8(column)
    h, kind, _, off, fronts = tokens.runs(data, offsets, PREFIXES)
    word = kind == 1
    every = np.repeat(np.arange(len(off) - 1), np.diff(off))
    of, key = [every[word]], [h[word]]
    for c in range(len(PREFIXES)):
        ok = word & (fronts[:, c] != 0)
        of.append(every[ok])
        key.append(fronts[ok, c])
    of, key = np.concatenate(of), np.concatenate(key)
    key = np.unique(of * BUCKETS + (key >> _U(64 - 19)).astype(np.int64))
    return key % BUCKETS, np.searchsorted(key, np.arange(len(offsets)) * BUCKETS)


@dataclass
class ToxicityModel:
    place: np.ndarray  # of each bucket: its place among the picked features, or -1
    weights: np.ndarray
    bias: float

    def picked(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, place) of the picked features present."""
        bucket, off = features(column)
        place = self.place[bucket]
        of = np.repeat(np.arange(len(off) - 1), np.diff(off))
        return of[place >= 0], place[place >= 0]

    def score(self, column: pa.Array) -> np.ndarray:
        of, place = self.picked(column)
        z = self.bias + np.bincount(of, self.weights[place], len(column))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _terms(identity: dict[str, list[str]]) -> dict[str, list[str]]:
    """The lists that each term is in."""
    out: dict[str, list[str]] = {}
    for group, terms in identity.items():
        for t in terms:
            out.setdefault(t, []).append(group)
    return out


_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def counterfactuals(sentence: str, identity: dict[str, list[str]] = IDENTITY, most: int = SWAPS) -> list[tuple[str, str]]:
    """Pairs of a sentence and its counterfactual; which terms are taken is a hash of the sentence.

    A sentence that names groups has its first named list's terms swapped,
    wherever they occur; in one that names none a term is put behind a word.
    """
    known, mark = _terms(identity), zlib.crc32(sentence.encode())
    named = [m for m in _WORD.finditer(sentence) if m[0].lower() in known]
    if named:
        group = known[named[0][0].lower()][0]
        own = {m[0].lower() for m in named}
        others = [t for t in identity[group] if t not in own]
        with_term = lambda t: _WORD.sub(lambda m: t if m[0].lower() in identity[group] else m[0], sentence)
        first = sentence
    else:
        group = sorted(identity)[mark % len(identity)]
        others = list(identity[group])
        ends = [m.end() for m in _WORD.finditer(sentence)]
        at = ends[(mark >> 8) % len(ends)] if ends else len(sentence)
        with_term = lambda t: f"{sentence[:at]} {t}{sentence[at:]}"
        first = None
    turn = (mark >> 16) % max(1, len(others))
    others = (others[turn:] + others[:turn])[:most]
    if not others:
        return []
    if first is not None:
        return [(first, with_term(t)) for t in others]
    return [(sentence, with_term(others[0])), *((with_term(a), with_term(b)) for a, b in zip(others, others[1:]))]


def _fit_weights(rows: list[np.ndarray], y: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], k: int, weight: float = SWAP_WEIGHT) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam with the penalty on pairs."""
    x = np.zeros((len(rows), k), np.float32)
    for i, r in enumerate(rows):
        x[i, r] = 1
    a, b = np.zeros((len(pairs), k), np.float32), np.zeros((len(pairs), k), np.float32)
    for i, (p, q) in enumerate(pairs):
        a[i, p], b[i, q] = 1, 1
    w, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    w[k] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, EPOCHS + 1):
        own = w[:k].astype(np.float32)
        e = (sigmoid(x @ own + w[k]) - y) / len(y)
        g = np.append(e.astype(np.float32) @ x + DECAY * w[:k], e.sum())
        if len(pairs) and weight:
            p, q = sigmoid(a @ own + w[k]), sigmoid(b @ own + w[k])
            d = 2 * weight * (p - q) / len(pairs)
            dp, dq = d * p * (1 - p), d * q * (1 - q)
            g += np.append(dp.astype(np.float32) @ a - dq.astype(np.float32) @ b, (dp - dq).sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - STEP * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:k], float(w[k])


def score_gap(model: ToxicityModel, sentences: list[str], identity: dict[str, list[str]] = IDENTITY) -> float:
    """Mean change of the score between sentences and their counterfactuals."""
    pairs = [p for s in sentences for p in counterfactuals(s, identity)]
    if not pairs:
        return 0.0
    first, second = (model.score(pa.array([p[k] for p in pairs])) for k in (0, 1))
    return float(np.abs(first - second).mean())


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, identity: dict[str, list[str]] = IDENTITY, swap_weight: float = SWAP_WEIGHT) -> ToxicityModel:
    """Fit on about `fit_rows` rows of (doc_id, text, label), taken by a hash of doc_id and text.

    Rows with a null label don't count; null texts count as empty, very long
    ones whole, repeated rows each.  Without any row every score is 0.5.
    Counterfactuals come from one sentence of SWAP_WORDS words of a text, that
    of least hash, first from texts of least hash; sentences that name groups
    come before others.
    """
    rows = labelled.where("label is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
    rows = sample = bounded_sample(rows, fit_rows, "doc_id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        docs = np.zeros(2, np.int64)
        for b in slices(batches, "text"):
            y = (b.column("label").to_numpy() == 1).astype(np.int64)
            bucket, off = features(b.column("text"))
            of = np.repeat(y, np.diff(off))
            total += np.bincount(of * BUCKETS + bucket, minlength=2 * BUCKETS).reshape(2, -1)
            docs += np.bincount(y, minlength=2)
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[total[0, at], docs[0]]), pa.array(np.r_[total[1, at], docs[1]])], ["bucket", "n0", "n1"])

    # only features with enough positive texts can be picked: the rest stays on the executors
    got = rows.mapInArrow(count, "bucket bigint, n0 bigint, n1 bigint").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(f"bucket < 0 or n1 >= {LEAST_TEXTS}").toPandas()
    d0, d1 = (int(got.loc[got["bucket"] < 0, c].sum()) for c in ("n0", "n1"))
    got = got[got["bucket"] >= 0]
    odds = np.log((got["n1"] + 0.5) / (d1 + 1)) - np.log((got["n0"] + 0.5) / (d0 + 1))
    telling = got.assign(s=odds * np.sqrt(got["n1"]))[odds > 1.0].sort_values(["s", "bucket"], ascending=[False, True])
    terms, _ = features(pa.array([" ".join(_terms(identity))]))
    place = np.full(BUCKETS, -1, np.int32)
    buckets = np.unique(np.concatenate([telling["bucket"].to_numpy(np.int64)[:FEATURES], terms]))
    place[buckets] = np.arange(len(buckets))
    model = ToxicityModel(place, np.zeros(len(buckets)), 0.0)
    if d0 + d1 == 0:
        discard(sample)
        return model
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _terms(identity)
        for b in slices(batches, "text"):
            model = shared.value
            of, where = model.picked(b.column("text"))
            cut = np.searchsorted(of, np.arange(b.num_rows + 1))
            places = [where[x:y].tolist() for x, y in zip(cut[:-1], cut[1:])]
            first, second, order = [], [], []
            for t in b.column("text").to_pylist():
                able = []
                for s in _SENTENCE.findall(t):
                    if SWAP_WORDS[0] <= len(s.split()) <= SWAP_WORDS[1]:
                        able.append((not any(m[0].lower() in known for m in _WORD.finditer(s)), zlib.crc32(s.encode()), s.strip()))
                best = min(able, default=None)
                pairs = counterfactuals(best[2], identity) if best else []
                order.append((best[0] << 32) + best[1] if best else 1 << 40)
                first.append([p[0] for p in pairs])
                second.append([p[1] for p in pairs])
            flat = [s for side in (first, second) for x in side for s in x]
            of, where = model.picked(pa.array(flat, pa.string()))
            cut = np.searchsorted(of, np.arange(len(flat) + 1))
            each = iter([where[x:y].tolist() for x, y in zip(cut[:-1], cut[1:])])
            sides = [[[next(each) for _ in x] for x in side] for side in (first, second)]
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((b.column("doc_id").to_pylist(), b.column("label").to_pylist(), places, order, *sides), kinds)], ["doc_id", "label", "places", "order", "a", "b"])

    spec = "doc_id bigint, label int, places array<int>, order bigint, a array<array<int>>, b array<array<int>>"
    got = rows.mapInArrow(lists, spec).toPandas().sort_values(["doc_id", "order"], kind="stable")
    discard(sample)
    pairs = [(np.asarray(p, np.int64), np.asarray(q, np.int64)) for x, y in got.sort_values(["order", "doc_id"], kind="stable")[["a", "b"]].itertuples(index=False) for p, q in zip(x, y)]
    model.weights, model.bias = _fit_weights([np.asarray(p, np.int64) for p in got["places"]], (got["label"] == 1).to_numpy(float), pairs[:SWAP_PAIRS], len(buckets), swap_weight)
    return model


def predict(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score, the probability of label 1, of every row of (doc_id, text).

    A null text counts as empty; a very long one is read whole.  Rows that
    repeat, also with the same or no doc_id, stay apart and get equal scores
    for equal texts.  An empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.score(b.column("text")), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, score double")
