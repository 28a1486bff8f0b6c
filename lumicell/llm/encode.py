"""Tokenizing large batches with the tokenizers library, each distinct piece once.

Both vocabularies split text before any merge, at white space and between
letters or digits and punctuation.  So a text's ids are those of its pieces put
together, where a piece is a word (with the space before it, if white space
counts), cut further between ASCII letters or digits and plain punctuation, or
a run of white space.  Pieces are found and hashed in numpy over the bytes of a
whole batch; a worker looks their ids up in a table of fixed size by 64-bit
hash, and only pieces that it lacks go to the library, many at a time.  A text
with other Unicode white space, whose runs could straddle pieces, is encoded
whole.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute

from . import tokens
from .common import give_back

#: Slots of a worker's table (a power of two), bytes of the longest piece in it, and ids held before it is emptied.
SLOT_BITS, KEPT_BYTES, POOL_IDS = 21, 48, 8 << 20
#: Pieces that go to the library as one text, and how few go one by one if that can't be cut again.
JOINED, ALONE = 4096, 8

_U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20260131))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | _U64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0D]] = True
_BYTE_WORD = np.where(_WHITE, _U64(0), _BYTE)
#: 1: ASCII letters and digits; 2: ASCII punctuation that never belongs to a contraction or a special token.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[c for c in range(128) if chr(c).isalnum()]] = 1
_CLASS[[ord(c) for c in ".,;:!?()[]{}\"-_/\\*#$%&+=~@^`"]] = 2
#: White space of Unicode beyond space, tab and line ends, and the separators that some engines count as such.
_ODD = "[\x0b\x0c\x1c-\x1f\u0085\u00a0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u3000\ufeff]"


class PieceEncoder:
    """ids of texts.

    `keep_space`: white space is part of the tokens (byte-level vocabularies);
    otherwise it only separates them.
    """

    def __init__(self, path: str, keep_space: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.keep_space = keep_space
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of a token: its letters stand for one byte each
        for token, k in vocabulary.items():
            self.size[k] = len(token.removesuffix("</w>"))
        self._empty()

    def _empty(self) -> None:
        slots = 1 << SLOT_BITS
        self.key, self.first = np.zeros(slots, np.uint64), np.zeros(slots, np.uint8)
        self.at, self.n = np.zeros(slots, np.int32), np.zeros(slots, np.uint8)  # ids of a kept piece are no more than its bytes
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0

    def library(self, texts: list[str]) -> list[np.ndarray]:
        """ids of each text, as the library gives them."""
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """ids of each piece: all as one text, cut again by the tokens' bytes; in halves if the cuts don't fall on tokens."""
        if len(pieces) <= ALONE:
            return self.library(pieces)
        if self.keep_space:
            text, between = "\n".join(pieces), 1
            sizes = np.array([len(p.encode()) for p in pieces])
        else:
            text, between = " ".join(pieces), 0
            sizes = np.array([len(p.lower().encode()) for p in pieces])
        ids = self.library([text])[0]
        ends = np.r_[0, np.cumsum(self.size[ids])]
        stop = np.cumsum(sizes + between) - between
        start = stop - sizes
        a, b = np.searchsorted(ends, start), np.searchsorted(ends, stop)
        if ends[-1] == stop[-1] and (ends[a] == start).all() and (ends[b] == stop).all():
            return [ids[x:y] for x, y in zip(a.tolist(), b.tolist())]
        half = len(pieces) // 2
        return self._pieces(pieces[:half]) + self._pieces(pieces[half:])

    def _add(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Put the ids of new pieces into the pool; their places and lengths."""
        texts = [p.decode() for p in pieces]
        found: list[np.ndarray] = [None] * len(texts)
        white = [i for i, t in enumerate(texts) if t.isspace()]
        for i, ids in zip(white, self.library([texts[i] for i in white])):
            found[i] = ids
        plain = [i for i in range(len(texts)) if found[i] is None]
        for k in range(0, len(plain), JOINED):
            part = plain[k : k + JOINED]
            for i, ids in zip(part, self._pieces([texts[i] for i in part])):
                found[i] = ids
        n = np.array([len(x) for x in found], np.int32)
        more = int(n.sum())
        if self.used + more > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), more), self.dtype)])
        at = self.used + np.cumsum(n, dtype=np.int64) - n
        if more:
            self.pool[self.used : self.used + more] = np.concatenate(found)
        self.used += more
        return at.astype(np.int32), n

    def _starts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where pieces start, in order."""
        white, kind = _WHITE[data], _CLASS[data]
        head = np.zeros(len(data) + 1, bool)
        head[off[:-1]] = True
        head = head[:-1]
        after = head.copy()  # white space or a text's start lies before
        after[1:] |= white[:-1]
        start = ~white & after
        cut = (kind[1:] + kind[:-1] == 3) & (kind[1:] != 0) & (kind[:-1] != 0) & ~head[1:]
        if self.keep_space:
            joined = start.copy()  # words with white space before them in their text
            joined &= ~head
            space = data == 32
            start[1:] &= ~(joined[1:] & space[:-1])
            start |= white & (head | np.r_[True, ~white[:-1]])
            start[:-1] |= joined[1:]
        start[1:] |= cut
        return np.flatnonzero(start)

    def _hashes(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """64-bit hash of each piece, by segments that the cache holds."""
        value = _BYTE if self.keep_space else _BYTE_WORD
        out, k = np.empty(len(starts), np.uint64), 0
        while k < len(starts):
            a = int(starts[k])
            e = max(k + 1, int(np.searchsorted(starts, a + tokens.SEGMENT)))
            b = int(starts[e]) if e < len(starts) else len(data)
            up, down = tokens.powers(b - a)
            at = starts[k:e] - a
            out[k:e] = np.add.reduceat(value[data[a:b]] * up, at) * down[at]
            k = e
        return tokens.mix(out)

    def _split(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, off = tokens.utf8(column)
        starts = self._starts(data, off) if len(data) else np.zeros(0, np.int64)
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(len(off), np.int64)
        if self.used > POOL_IDS:
            self._empty()
        h, first = self._hashes(data, starts), data[starts]
        slot = (h >> _U64(64 - SLOT_BITS)).astype(np.int64)
        at, n = self.at[slot], self.n[slot].astype(np.int32)
        miss = np.flatnonzero((self.key[slot] != h) | (self.first[slot] != first) | (n == 0))
        if len(miss):
            _, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            own = miss[one]
            ends = np.r_[starts[1:], len(data)][own]
            # a piece ends with its text: white space at the next text's front isn't its own
            ends = np.minimum(ends, off[np.searchsorted(off, starts[own], "right")])
            raw = data.tobytes()
            pieces = [raw[a:b] if self.keep_space else raw[a:b].rstrip(b" \t\n\r") for a, b in zip(starts[own].tolist(), ends.tolist())]
            new_at, new_n = self._add(pieces)
            at[miss], n[miss] = new_at[back], new_n[back]
            kept = np.flatnonzero((ends - starts[own] <= KEPT_BYTES) & (new_n > 0))
            s = slot[own[kept]]
            self.key[s], self.first[s], self.at[s], self.n[s] = h[own[kept]], first[own[kept]], new_at[kept], new_n[kept]
        before = np.r_[0, np.cumsum(n, dtype=np.int64)]
        ids = self.pool[np.repeat(at - before[:-1], n) + np.arange(before[-1])]
        return ids, before[np.searchsorted(starts, off)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts of a string column (null: none) in order, and their offsets by text."""
        odd = pa.compute.match_substring_regex(column.fill_null(""), _ODD).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._split(column)
        plain, off = self._split(column.take(pa.array(np.flatnonzero(~odd))))
        parts: list[np.ndarray] = [None] * len(column)
        for k, i in enumerate(np.flatnonzero(~odd)):
            parts[i] = plain[off[k] : off[k + 1]]
        where = np.flatnonzero(odd)
        for i, ids in zip(where, self.library([column[int(i)].as_py() for i in where])):
            parts[i] = ids
        return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts], dtype=np.int64)]


@lru_cache(maxsize=4)
def encoder(path: str, keep_space: bool) -> PieceEncoder:
    """One per worker process, tokenizer and mode."""
    return PieceEncoder(path, keep_space)


def forget() -> None:
    """Free this worker's tables: other work follows, and processes outlive their tasks."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        give_back()
