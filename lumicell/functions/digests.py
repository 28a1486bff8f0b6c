"""MD5 of many short messages at once, by arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_PLACES = [(a * i + b) % 16 for a, b in ((1, 0), (5, 1), (3, 5), (7, 0)) for i in range(16)]
_SINES = np.floor(2.0**32 * np.abs(np.sin(np.arange(1, 65)))).astype(np.uint32)
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _rounds(state: list[np.ndarray], w: np.ndarray) -> list[np.ndarray]:
    """One block of each message: w has its 16 words, state is left as it is."""
    a, b, c, d = (x.copy() for x in state)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _SINES[i]
        f += w[_PLACES[i]]
        np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=t)
        np.left_shift(f, np.uint32(_SHIFTS[i]), out=f)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return [x + y for x, y in zip(state, (a, b, c, d))]


class Prefixes:
    """Texts, each of which begins many messages."""

    def __init__(self, texts: pa.Array) -> None:
        raw = [x.encode() for x in texts.to_pylist()]
        self.length = np.fromiter(map(len, raw), np.int64, len(raw))
        self.width = 64 * ((int(self.length.max(initial=0)) + 28) // 64 + 1)  # 19 digits, the mark and the length
        self.bytes = np.frombuffer(b"".join(x.ljust(self.width, b"\0") for x in raw), np.uint8).reshape(-1, self.width)

    def md5(self, rows: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The digests of texts[row] + decimal number (1 or more), as two unsigned words in the order of their hex digits."""
        text, at, every = self.bytes[rows], self.length[rows], np.arange(len(rows))
        tens = 10 ** np.arange(1, 19)
        digits = 1 + np.searchsorted(tens, numbers, "right")
        for j in range(int(digits.max(initial=0))):
            has = every[digits > j] if j else every
            text[has, at[has] + digits[has] - 1 - j] = 48 + numbers[has] // 10**j % 10
        at = at + digits
        text[every, at] = 0x80
        blocks = (at + 8) // 64 + 1
        words = text.view("<u4")
        words[every, 16 * blocks - 2] = 8 * at
        words = np.ascontiguousarray(words.T).astype(np.uint32, copy=False)
        state = [np.full(len(rows), x, np.uint32) for x in _START]
        for k in range(int(blocks.max(initial=0))):
            new = _rounds(state, words[16 * k : 16 * k + 16])
            live = blocks > k
            state = new if live.all() else [np.where(live, x, y) for x, y in zip(new, state)]
        a, b, c, d = (x.byteswap().astype(np.uint64) for x in state)
        return a << np.uint64(32) | b, c << np.uint64(32) | d
