"""Personal data: fixed patterns, and a skip-chain conditional random field on top.

The base spans come from patterns with checks (BASE_KINDS).  The field then
labels the tokens of a document that hold a digit or an at sign and lie outside
base spans, as one of the base kinds, as `secret` (keys, passwords) or as none.
Its variables are those tokens and the tokens of base spans, whose labels are
observed.  Factors are: features of a token's shape and of the word before it,
its neighbour in the text (chain), and its next token with the same or similar
content, however far (skip chain): the same word, or the same last digits, also
of a number that is written as several tokens.  Marginals come from damped
loopy sum-product message passing, for all tokens of a batch at once.  A free
token whose likeliest kind is not none and has at least CONFIDENCE becomes a
span; neighbours of a kind that is written with spaces become one.  So a phone
number is found where the pattern failed because another number follows it, or
where its country code is missing, and plain numbers stay as they are.

Weights are learned by pseudo-likelihood on a bounded sample.  Its labels are
the base spans; for secrets, values that are assigned to a name such as token
or password; and for phones also matches that failed only since they ran on
into another base span.  Pieces come a second time without the first token of
phones (the country code), and features are dropped at random while learning,
so that context and skip factors carry weight beside the shape.

Scale.  A document is handled by itself: one pass, no shuffle; fitting gathers
FIT_SEGMENTS pieces of SEGMENT tokens as numbers, no texts.
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

from .common import bounded_sample, discard, slices, texts

BASE_KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *BASE_KINDS, "secret")
K = len(LABELS)
CONFIDENCE = 0.9
#: Rows that the field is fitted on, about; pieces of them, and tokens of a piece.
FIT_ROWS, FIT_SEGMENTS, SEGMENT = 4000, 4000, 64
EPOCHS, STEP, DECAY, DROP = 150, 0.1, 1e-3, 0.3
ROUNDS, DAMPING = 12, 0.3
#: Digits or characters from which equal contents make a skip edge.
SKIP_DIGITS, SKIP_CHARS = 7, 8

_SIGN = re.compile(r"[0-9@]")
_RUN = re.compile(r"[0-9@]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPACES = re.compile(r"\s")
_DIGITS = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' checked matches, leftmost and not overlapping within a kind."""
    out: list[tuple[int, int, int]] = []
    if not _SIGN.search(text):
        return out
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((1, start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((2, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append((3, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((4, *m.span()))
    return out


def signed_tokens(text: str) -> list[tuple[int, int]]:
    """Spans between white space that hold a digit or an at sign."""
    out, end = [], 0
    for m in _RUN.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        s = _SPACES.search(text, m.end())
        end = s.start() if s else len(text)
        out.append((start, end))
    return out


#: Shape features: names in order; the first is always on.
SHAPES = (
    "bias at dot_after_at no_digit d1_3 d4_6 d7_9 d10_15 d16_19 d20 dots1 dots2 dots3 dots4 only_digits plus paren hyphen letter hex_like long colon slash equals quote luhn named assigned".split()
)
#: Words before a token are features by hash.
WORD_BUCKETS = 32
FEATURES = len(SHAPES) + WORD_BUCKETS
_TRIM = ".,;:!?()[]{}<>\"'$%&*#"
#: What names a secret, up to the place where its value starts.
_NAMED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth)\w*[\"']?\s{0,4}[:=]\s{0,4}[\"']?$")
_ASSIGNED = re.compile(r"[:=]\s{0,4}[\"']?$")
_WORD_BEFORE = re.compile(r"([^\W\d_]+)[\W_]*$")
#: A value that can be a secret.
_VALUE = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}\Z")
#: Characters before a token that its context is read from.
_BEFORE = 40


def shape(token: str, before: str) -> list[int]:
    """Indices of the features that are on, for a token and the text before it."""
    digits = sum("0" <= c <= "9" for c in token)
    dots = token.count(".")
    on = [True, "@" in token, "." in token.partition("@")[2], digits == 0, 1 <= digits <= 3, 4 <= digits <= 6, 7 <= digits <= 9, 10 <= digits <= 15, 16 <= digits <= 19, digits > 19]
    letters = any(c.isalpha() for c in token)
    on += [dots == 1, dots == 2, dots == 3, dots > 3, digits == len(token), "+" in token, "(" in token or ")" in token, "-" in token, letters]
    on += [letters and digits > 0 and all(c in "0123456789abcdefABCDEF" for c in token.strip(_TRIM)), len(token) > 24, ":" in token, "/" in token, "=" in token, '"' in token or "'" in token]
    on += [16 <= digits <= 19 and not letters and _luhn(_DIGITS.sub("", token)), bool(_NAMED.search(before)), bool(_ASSIGNED.search(before))]
    word = _WORD_BEFORE.search(before)
    bucket = [len(SHAPES) + zlib.crc32(word[1].lower().encode()) % WORD_BUCKETS] if word else []
    return [k for k, x in enumerate(on) if x] + bucket


@dataclass
class Graph:
    """Tokens of a batch of texts: text, span, features, observed label (-1: free), edges."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    shapes: np.ndarray
    label: np.ndarray
    chain: np.ndarray  # edges x 2
    skip: np.ndarray


def _dense(on: list[list[int]]) -> np.ndarray:
    table = np.zeros((len(on), FEATURES), np.float32)
    for i, x in enumerate(on):
        table[i, x] = 1
    return table


def _tokens(text: str, found: list[tuple[int, int, int]]) -> tuple[list, list, list, list, list]:
    """(start, end), features, label of each signed token of a text, chain and skip edges between them."""
    rows: list[tuple[int, int]] = []
    on: list[list[int]] = []
    label: list[int] = []
    chain: list[tuple[int, int]] = []
    skip: list[tuple[int, int]] = []
    edges = sorted((s, e, k) for k, s, e in found)
    last: dict[str, int] = {}
    covering: list[tuple[int, int, int]] = []
    run, j = "", 0
    for s, e in signed_tokens(text):
        while j < len(edges) and edges[j][0] < e:
            covering.append(edges[j])
            j += 1
        covering = [x for x in covering if x[1] > s]
        i, token = len(rows), text[s:e]
        near = bool(rows) and s - rows[-1][1] <= 1
        if near:
            chain.append((i - 1, i))
        digits = _DIGITS.sub("", token)
        letters = any(c.isalpha() for c in token) or "@" in token
        run = "" if letters else (run[-32:] if near else "") + digits  # digits of a number written as several tokens
        word = token.strip(_TRIM).lower()
        content = f"#{run[-SKIP_DIGITS:]}" if len(run) >= SKIP_DIGITS else f"#{digits[-SKIP_DIGITS:]}" if not letters and len(digits) >= SKIP_DIGITS else word if len(word) >= SKIP_CHARS else ""
        if content:
            if content in last:
                skip.append((last[content], i))
            last[content] = i
        rows.append((s, e))
        on.append(shape(token, text[max(0, s - _BEFORE) : s]))
        label.append(next((k for a, b, k in covering if b > s and a < e), -1))
    return rows, on, label, chain, skip


def graph(batch: list[str], spans: list[list[tuple[int, int, int]]]) -> Graph:
    at: list[tuple[int, int, int]] = []
    on: list[list[int]] = []
    label: list[int] = []
    chain: list[tuple[int, int]] = []
    skip: list[tuple[int, int]] = []
    for d, (text, found) in enumerate(zip(batch, spans)):
        if not _SIGN.search(text):
            continue
        rows, shapes, labels, c, s = _tokens(text, found)
        base = len(at)
        at += [(d, a, b) for a, b in rows]
        on += shapes
        label += labels
        chain += [(a + base, b + base) for a, b in c]
        skip += [(a + base, b + base) for a, b in s]
    where = np.array(at, np.int64).reshape(-1, 3)
    edges = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return Graph(where[:, 0], where[:, 1], where[:, 2], _dense(on), np.array(label, np.int64), edges(chain), edges(skip))


def _plausible(kind: str, token: str) -> bool:
    """Whether a token that the field labels can be of that kind at all."""
    digits = sum("0" <= c <= "9" for c in token)
    if kind == "email":
        return 0 < token.find("@") < len(token) - 1
    if kind == "ip":
        return token.count(".") == 3
    if kind == "card":
        return 13 <= digits <= 19 and not any(c.isalpha() for c in token)
    if kind == "phone":
        return 7 <= digits <= 15 and not any(c.isalpha() for c in token)
    return bool(_VALUE.match(token)) and digits > 0 and any(c.isalpha() for c in token)


@dataclass
class SkipChainField:
    node: np.ndarray  # features x K
    chain: np.ndarray  # K x K
    skip: np.ndarray  # K x K

    def marginals(self, g: Graph) -> np.ndarray:
        """Beliefs after damped loopy message passing; observed tokens are fixed."""
        own = (g.shapes @ self.node).astype(np.float64)
        fixed = np.flatnonzero(g.label >= 0)
        own[fixed] = -50.0
        own[fixed, g.label[fixed]] = 0.0
        src = np.concatenate([g.chain[:, 0], g.chain[:, 1], g.skip[:, 0], g.skip[:, 1]])
        dst = np.concatenate([g.chain[:, 1], g.chain[:, 0], g.skip[:, 1], g.skip[:, 0]])
        c, s = len(g.chain), len(g.skip)
        back = np.concatenate([np.arange(c) + c, np.arange(c), 2 * c + s + np.arange(s), 2 * c + np.arange(s)])
        factor = np.concatenate([np.repeat(self.chain[None], c, 0), np.repeat(self.chain.T[None], c, 0), np.repeat(self.skip[None], s, 0), np.repeat(self.skip.T[None], s, 0)])
        message = np.zeros((len(src), K))
        for _ in range(ROUNDS if len(src) else 0):
            belief = own.copy()
            np.add.at(belief, dst, message)
            out = (belief[src] - message[back])[:, :, None] + factor
            top = out.max(axis=1, keepdims=True)
            new = (top + np.log(np.exp(out - top).sum(axis=1, keepdims=True)))[:, 0]
            new -= new.max(axis=1, keepdims=True)
            message = DAMPING * message + (1 - DAMPING) * new
        belief = own
        np.add.at(belief, dst, message)
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def added(self, batch: list[str], spans: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
        """Spans that the field adds to each text's base spans."""
        g = graph(batch, spans)
        out: list[list[tuple[int, int, int]]] = [[] for _ in batch]
        if not (g.label < 0).any() or not self.node.any():
            return out
        p = self.marginals(g)
        best = p.argmax(axis=1)
        chosen = np.flatnonzero((g.label < 0) & (best > 0) & (p.max(axis=1) >= CONFIDENCE))
        near = {(int(a), int(b)) for a, b in g.chain}
        runs: list[list[int]] = []
        for i in chosen.tolist():
            if runs and (runs[-1][-1], i) in near and best[i] == best[runs[-1][-1]] and LABELS[best[i]] in ("card", "phone"):
                runs[-1].append(i)
            else:
                runs.append([i])
        for run in runs:
            d, s, e, kind = int(g.text[run[0]]), int(g.start[run[0]]), int(g.end[run[-1]]), int(best[run[0]])
            token = batch[d][s:e]
            lead = _TRIM.replace("(", "") if LABELS[kind] == "phone" else _TRIM
            s, e = s + len(token) - len(token.lstrip(lead)), e - len(token) + len(token.rstrip(_TRIM))
            if s < e and _plausible(LABELS[kind], batch[d][s:e]) and all(e <= a or s >= b for _, a, b in spans[d]):
                out[d].append((kind, s, e))
        return out


def training_labels(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Spans that learning takes as true, and stretches whose tokens have no label."""
    spans = base_spans(text)
    covered = [(s, e) for _, s, e in spans]
    for s, e in signed_tokens(text):
        value = text[s:e].strip(_TRIM)
        named = _NAMED.search(text[max(0, s - _BEFORE) : s])
        if named and _VALUE.match(value) and any(c.isalpha() for c in value) and all(e <= a or s >= b for a, b in covered):
            spans.append((LABELS.index("secret"), s, e))
    unknown = []
    for m in _PHONE.finditer(text):
        if sum(c.isdigit() for c in m[0]) > 15:
            end = min([s for s, _ in covered if m.start() < s < m.end()], default=m.end())
            if 8 <= sum(c.isdigit() for c in text[m.start() : end]) <= 15:
                spans.append((LABELS.index("phone"), m.start(), end))
            else:
                unknown.append(m.span())
    return spans, unknown


def _without_first(x: list, y: list[int], chain: list[int], skip: list[int]) -> tuple | None:
    """A piece without the first tokens of phones, or None if it has no phone of several tokens."""
    phone = LABELS.index("phone")
    pairs = list(zip(chain[::2], chain[1::2]))
    inner = {b for a, b in pairs if y[a] == y[b] == phone}
    gone = {a for a, b in pairs if y[a] == y[b] == phone and a not in inner}
    if not gone:
        return None
    place = {old: new for new, old in enumerate(k for k in range(len(y)) if k not in gone)}
    left = lambda e: [place[k] for a, b in zip(e[::2], e[1::2]) if a in place and b in place for k in (a, b)]
    return [x[k] for k in place], [y[k] for k in place], left(chain), left(skip)


def _fit(x: np.ndarray, y: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> SkipChainField:
    """Pseudo-likelihood by Adam; tokens with label -1 take no part."""
    rng = np.random.Generator(np.random.PCG64(5))
    known = y >= 0
    onehot = np.eye(K)[np.maximum(y, 0)] * known[:, None]
    around = {}
    for name, edges in (("chain", chain), ("skip", skip)):
        into, out = np.zeros((len(y), K)), np.zeros((len(y), K))
        np.add.at(into, edges[:, 1], onehot[edges[:, 0]])
        np.add.at(out, edges[:, 0], onehot[edges[:, 1]])
        around[name] = (into, out)
    w = {"node": np.zeros((x.shape[1], K)), "chain": np.zeros((K, K)), "skip": np.zeros((K, K))}
    m, v = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}
    for t in range(1, EPOCHS + 1):
        seen = x * (rng.random(x.shape, np.float32) >= DROP)
        seen[:, 0] = x[:, 0]
        z = seen @ w["node"]
        for name, (into, out) in around.items():
            z = z + into @ w[name] + out @ w[name].T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        e = (p / p.sum(axis=1, keepdims=True) - onehot) * known[:, None] / max(1, known.sum())
        grads = {"node": seen.T @ e} | {n: i.T @ e + (o.T @ e).T for n, (i, o) in around.items()}
        for k, g in grads.items():
            g = g + DECAY / 100 * w[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - STEP * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return SkipChainField(**w)


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> SkipChainField:
    """Fit on about `fit_rows` rows of (doc_id, text) with signed tokens, taken by a hash of doc_id and text.

    Texts are read whole; of their pieces of SEGMENT tokens the FIT_SEGMENTS
    with the least hash are learned from.  Without any the weights are zero and
    nothing is added.
    """
    sample = bounded_sample(docs.where(F.col("text").rlike("[0-9@]")).select("doc_id", "text"), fit_rows, "doc_id", "text")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows: list[tuple] = []
            for text in texts(b.column("text")):
                spans, unknown = training_labels(text)
                at, on, label, chain, skip = _tokens(text, spans)
                mark = zlib.crc32(text.encode())
                for a in range(0, len(at), SEGMENT):
                    e = min(len(at), a + SEGMENT)
                    inside = lambda x, a=a, e=e: [k - a for p in x if a <= p[0] and p[1] < e for k in p]
                    # a token without a base label is none, or has no label where a phone pattern failed
                    y = [k if k >= 0 else -1 if any(s < v and u < t for s, t in unknown) else 0 for k, (u, v) in zip(label[a:e], at[a:e])]
                    piece = on[a:e], y, inside(chain), inside(skip)
                    rows.append((zlib.crc32(b"%d" % a, mark), *piece))
                    if cut := _without_first(*piece):
                        rows.append((zlib.crc32(b"-%d" % a, mark), *cut))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_PIECE_TYPES)], ["h", "x", "y", "chain", "skip"])

    found = sample.mapInArrow(pieces, "h bigint, x array<array<int>>, y array<int>, chain array<int>, skip array<int>").orderBy("h", "y", "chain", "skip").limit(FIT_SEGMENTS).collect()
    discard(sample)
    if not found:
        return SkipChainField(np.zeros((FEATURES, K)), np.zeros((K, K)), np.zeros((K, K)))
    base = np.cumsum([0, *(len(r.y) for r in found)])
    edges = lambda c: np.concatenate([np.array(r[c], np.int64).reshape(-1, 2) + base[k] for k, r in enumerate(found)])
    return _fit(_dense([on for r in found for on in r.x]), np.concatenate([np.array(r.y, np.int64) for r in found]), edges("chain"), edges("skip"))


_PIECE_TYPES = (pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()))


def find(docs: DataFrame, field: SkipChainField) -> DataFrame:
    """doc_id, base and spans of every row of (doc_id, text): arrays of (kind, start, end) in code points.

    base holds the patterns' spans, spans those and the field's, both ordered
    by kind as in LABELS and then by start.  Null or empty texts have none; a
    very long text is read whole.  Between equal probabilities the first kind
    in LABELS wins.  Rows that repeat, also with the same or no doc_id, stay
    apart; an empty table gives an empty result; other columns are ignored,
    whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(spans: list[tuple[int, int, int]]) -> list[dict]:
            return [{"kind": LABELS[k], "start": s, "end": e} for k, s, e in sorted(spans)]

        for b in slices(batches, "text"):
            batch = texts(b.column("text"))
            base = [base_spans(t) for t in batch]
            more = shared.value.added(batch, base)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([rows(x) for x in base], kind), pa.array([rows(x + y) for x, y in zip(base, more)], kind)], ["doc_id", "base", "spans"])

    span = "array<struct<kind: string, start: bigint, end: bigint>>"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, f"doc_id bigint, base {span}, spans {span}")
