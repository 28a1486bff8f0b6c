"""Vectorised word and shingle hashing over Arrow string columns.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z
lower-cased.  Since those bytes never occur inside a multi-byte UTF-8
sequence, everything here works on the raw UTF-8 buffer of a column: no
Python string is made and the cost per byte is a few numpy passes.

Hashes are 64-bit: a polynomial over the bytes of a word modulo 2**64 with an
odd base (so a prefix sum can be divided out again), then a bit mixer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes handled in one numpy pass; bounds the size of the temporaries.
SEGMENT = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_U64 = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240917))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | _U64(1)
_IS_WS = np.zeros(256, dtype=bool)
_IS_WS[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_IS_WS] = 0
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
#: For words without punctuation: ASCII other than letters and digits separates too.
_BYTE_ALNUM, _IS_SEP = _BYTE.copy(), _IS_WS.copy()
_IS_SEP[[c for c in range(128) if not chr(c).isalnum()]] = True
_BYTE_ALNUM[_IS_SEP] = 0
_STEP = [_U64(x) for x in (_rng.integers(1, 2**63, 16, dtype=np.uint64) | _U64(1))]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    # fixed values: the multipliers of the published splitmix64 generator
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inv = _U64(pow(int(_BASE), -1, 2**64))
            up = np.full(n, _BASE, dtype=np.uint64)
            down = np.full(n, inv, dtype=np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base of the hash, and of its inverse."""
    return _POWERS.get(n)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    bufs = column.buffers()
    if n == 0 or bufs[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(bufs[1], np.int64, n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(bufs[2], np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, punctuation: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, in order, and the word offsets of each text (len + 1).

    Without `punctuation`, ASCII punctuation separates words as white space does.
    """
    is_sep, value = (_IS_WS, _BYTE) if punctuation else (_IS_SEP, _BYTE_ALNUM)
    n, size = len(offsets) - 1, len(data)
    hashes, at = [], []
    a = 0
    while a < size:
        b = min(size, a + SEGMENT)
        if b < size:  # end at white space or a text's start, else a word would be cut
            while True:
                ws = np.flatnonzero(is_sep[data[a:b]])
                k = int(np.searchsorted(offsets, b, "right")) - 1
                cut = max(a + int(ws[-1]) + 1 if len(ws) else a, int(offsets[k]))
                if cut > a or b == size:
                    b = cut if cut > a else b
                    break
                b = min(size, b + SEGMENT)
        x = data[a:b]
        word = ~is_sep[x]
        start = word.copy()
        start[1:] &= ~word[:-1]
        lo, hi = np.searchsorted(offsets[:-1], (a, b))
        heads = offsets[lo:hi] - a
        heads = heads[heads < len(x)]
        start[heads] = word[heads]
        starts = np.flatnonzero(start)
        if len(starts):
            up, down = _POWERS.get(len(x))
            hashes.append(mix(np.add.reduceat(value[x] * up, starts) * down[starts]))
            at.append(starts + a)
        a = b
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    pos = np.concatenate(at)
    return np.concatenate(hashes), np.searchsorted(pos, offsets).astype(np.int64)


def ngram_hashes(words: np.ndarray, offsets: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each text, in order, and their offsets.

    A text of fewer than k words, but at least one, gives its whole sequence as
    one hash if `short`, else none.
    """
    counts = np.diff(offsets)
    grams = np.maximum(counts - k + 1, 0)
    out_off = np.concatenate([[0], np.cumsum(grams)]).astype(np.int64)
    if len(words) >= k:
        acc = words[: len(words) - k + 1] * _STEP[0]
        for j in range(1, k):
            acc = acc + words[j : len(words) - k + 1 + j] * _STEP[j]
        inside = np.ones(len(acc), bool)
        for j in range(1, k):  # runs that reach over a text's end
            bad = offsets[1:-1] - j
            inside[bad[(bad >= 0) & (bad < len(acc))]] = False
        acc = mix(acc[inside])
    else:
        acc = np.zeros(0, np.uint64)
    few = np.flatnonzero((counts > 0) & (counts < k)) if short else ()
    if len(few) == 0:
        return acc, out_off
    extra = np.empty(len(few), np.uint64)
    with np.errstate(over="ignore"):
        for i, d in enumerate(few):
            w = words[offsets[d] : offsets[d + 1]]
            extra[i] = (w * np.array(_STEP[: len(w)], np.uint64)).sum(dtype=np.uint64) + _U64(len(w) + 1) * _STEP[-1]
    out = np.insert(acc, out_off[few], mix(extra))
    grams[few] = 1
    return out, np.concatenate([[0], np.cumsum(grams)]).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


#: Kinds of bytes: 0 white space, 1 letters, digits and non-ASCII, 2 other ASCII.
_KIND = np.ones(256, np.uint8)
_KIND[_IS_SEP] = 2
_KIND[_IS_WS] = 0
_UPPER = np.zeros(256, np.uint8)
_UPPER[ord("A") : ord("Z") + 1] = 1


def runs(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one kind of byte: hash, kind, upper-case letters, offsets by text, and
    for each of `prefixes` the hash of so many first bytes (0 where a run is shorter)."""
    n, size, a = len(offsets) - 1, len(data), 0
    parts: list[tuple] = []
    while a < size:
        b = min(size, a + SEGMENT)
        while b < size:
            ws = np.flatnonzero(_IS_WS[data[a:b]])
            k = int(np.searchsorted(offsets, b, "right")) - 1
            cut = max(a + int(ws[-1]) + 1 if len(ws) else a, int(offsets[k]))
            if cut > a:
                b = cut
                break
            b = min(size, b + SEGMENT)
        x = data[a:b]
        kind = _KIND[x]
        start = kind > 0
        start[1:] &= kind[1:] != kind[:-1]
        lo, hi = np.searchsorted(offsets[:-1], (a, b))
        heads = offsets[lo:hi] - a
        heads = heads[heads < len(x)]
        start[heads] = kind[heads] > 0
        starts = np.flatnonzero(start)
        if len(starts):
            up, down = _POWERS.get(len(x))
            value = _BYTE[x] * up
            fronts = np.zeros((len(starts), len(prefixes)), np.uint64)
            front, ok = np.zeros(len(starts), np.uint64), np.ones(len(starts), bool)
            nexts = np.r_[starts[1:], len(x)]
            for j in range(max(prefixes, default=0)):
                at = np.minimum(starts + j, len(x) - 1)
                ok &= (starts + j < nexts) & (kind[at] > 0)
                front += _BYTE[x[at]] * _STEP[j]
                for c, p in enumerate(prefixes):
                    if p == j + 1:
                        fronts[:, c] = np.where(ok, mix(front + _U64(p)), _U64(0))
            parts.append((mix(np.add.reduceat(value, starts) * down[starts]), kind[starts], np.add.reduceat(_UPPER[x], starts, dtype=np.int32), fronts, starts + a))
        a = b
    if not parts:
        z = np.zeros(0, np.uint64)
        return z, z.astype(np.uint8), z.astype(np.int32), np.zeros(n + 1, np.int64), np.zeros((0, len(prefixes)), np.uint64)
    h, kind, upper, fronts, at = (np.concatenate(c) for c in zip(*parts))
    return h, kind, upper, np.searchsorted(at, offsets).astype(np.int64), fronts
