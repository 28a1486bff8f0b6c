"""Vector bin packing of examples into training sequences.

A sequence has limits on tokens, on segments and on loss-bearing tokens.  From
a window of waiting pieces the packer takes, again and again, the piece that
fits under all limits and has the largest dot product with the room left (both
as shares of the limits).  If none fits and cutting is allowed, it cuts the
longest piece to fill the sequence; the rest waits on.  Documents longer than
a sequence first give whole sequences.

`pack_documents` packs plain documents, all of whose tokens but the first bear
loss; its limits on segments and loss are as wide as the sequence unless they
are given, since closer ones can only leave room unused.  `pack_instructions`
packs pairs of prompt and response, of which only the response bears loss;
there all three limits bind.

Scale.  Each input partition is packed by itself in one pass that holds at most
WINDOW pieces shorter than a sequence: no shuffle, and no state grows with the
input.  Only a partition's last sequences can fall short; documents are cut to
powers of two there, so even they need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .encode import encoder

#: Tokens of a sequence.
MAX_TOKENS = 1024
#: Limits for instruction data: examples of a sequence, and tokens of it that bear loss.
MAX_SEGMENTS, MAX_LOSS = 64, 768
#: Pieces that wait at most.
WINDOW = 1024


class VectorPacker:
    """Packs pieces (key, start, length, loss) as they come.

    `loss_of(key, start, length)` counts the loss-bearing tokens of a piece.
    Results are tuples (key, start, length, sequence, offset).  A piece over a
    limit by itself raises ValueError unless it can be cut.
    """

    def __init__(self, limits: tuple[int, int, int], loss_of: Callable[[object, int, int], int], cut: bool = True, window: int = WINDOW) -> None:
        if min(limits) < 1 or window < 2:
            raise ValueError(f"limits must be 1 at least and the window 2, not {limits} and {window}")
        self.limits, self.loss_of, self.cut, self.window = np.array(limits, np.int64), loss_of, cut, window
        self.keys: list = []
        self.starts: list[int] = []
        self.need = np.zeros((0, 3), np.int64)
        self.fresh: list[tuple[int, int, int]] = []
        self.sequence = 0

    def _add(self, key, start: int, length: int) -> None:
        need = (length, 1, self.loss_of(key, start, length))
        if not self.cut and any(n > m for n, m in zip(need, self.limits)):
            raise ValueError(f"example {key!r} needs {need}, over the limits {tuple(self.limits)}")
        self.keys.append(key)
        self.starts.append(start)
        self.fresh.append(need)

    def add(self, key, length: int) -> Iterator[tuple]:
        start, most = 0, int(self.limits[0])
        if self.cut:
            while length - start >= most and self.loss_of(key, start, most) <= self.limits[2]:
                yield (key, start, most, self.sequence, 0)
                self.sequence += 1
                start += most
        if length > start:
            self._add(key, start, length - start)
        if len(self.keys) >= self.window:
            while len(self.keys) > self.window // 2:
                yield from self._fill(most)

    def flush(self) -> Iterator[tuple]:
        self._settle()
        while self.keys:
            left = int(self.need[:, 0].sum())
            most = int(self.limits[0])
            if self.cut and left < most:
                most = 1 << (left.bit_length() - 1)
            yield from self._fill(most)

    def _settle(self) -> None:
        if self.fresh:
            self.need = np.concatenate([self.need, np.array(self.fresh, np.int64).reshape(-1, 3)])
            self.fresh = []

    def _fill(self, tokens: int) -> Iterator[tuple]:
        """Fill and close one sequence of at most `tokens` tokens."""
        self._settle()
        limits = self.limits.copy()
        limits[0] = tokens
        room, offset = limits.copy(), 0
        open_ = np.ones(len(self.keys), bool)
        shares = self.need / self.limits
        while room[0] > 0 and room[1] > 0 and open_.any():
            fits = open_ & (self.need <= room).all(axis=1)
            if fits.any():
                k = int(np.argmax(np.where(fits, shares @ (room / self.limits), -1.0)))
                yield (self.keys[k], self.starts[k], int(self.need[k, 0]), self.sequence, offset)
                offset += int(self.need[k, 0])
                room -= self.need[k]
                open_[k] = False
                continue
            if not self.cut:
                break
            k = int(np.argmax(np.where(open_, self.need[:, 0], -1)))
            piece = self._cut_length(k, room)
            if piece <= 0:
                break
            key, start = self.keys[k], self.starts[k]
            yield (key, start, piece, self.sequence, offset)
            offset += piece
            room -= (piece, 1, self.loss_of(key, start, piece))
            self.starts[k] = start + piece
            rest = int(self.need[k, 0]) - piece
            if rest:
                self.need[k] = (rest, 1, self.loss_of(key, start + piece, rest))
                if room[0] > 0:  # stopped by the loss limit
                    break
            else:
                open_[k] = False
        self.sequence += 1
        self.keys = [x for x, o in zip(self.keys, open_) if o]
        self.starts = [x for x, o in zip(self.starts, open_) if o]
        self.need = self.need[open_]

    def _cut_length(self, k: int, room: np.ndarray) -> int:
        """Longest front of a piece that keeps both token limits."""
        lo, hi = 0, int(min(room[0], self.need[k, 0]))
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.loss_of(self.keys[k], self.starts[k], mid) <= room[2]:
                lo = mid
            else:
                hi = mid - 1
        return lo


def _task_base() -> int:
    """First sequence number of this task."""
    task = TaskContext.get()
    return (task.partitionId() if task else 0) << 40


def _document_loss(key, start: int, length: int) -> int:
    """All tokens of a document but its first are predicted from something."""
    return length - (start == 0)


def pack_documents(
    docs: DataFrame, tokenizer: str, keep_space: bool = True, end_id: int = 0, max_tokens: int = MAX_TOKENS, max_segments: int | None = None, max_loss: int | None = None
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then `end_id`; a null or empty text has the end
    id alone, a very long one fills sequences of its own.  Every row is a
    document of its own, also when doc_ids repeat or are null or whole rows are
    equal.  An empty table gives an empty result; other columns are ignored,
    whatever their names.  Limits on segments and loss-bearing tokens are
    `max_tokens` unless given.
    """
    limits = (max_tokens, max_segments or max_tokens, max_loss or max_tokens)
    VectorPacker(limits, _document_loss)  # an impossible limit fails here, not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base = encoder(tokenizer, keep_space), _task_base()
        ids_of: dict[int, list] = {}
        packer = VectorPacker(limits, _document_loss)

        def batch(pieces: list[tuple]) -> pa.RecordBatch:
            cols: list[list] = [[], [], [], [], [], [], []]
            for row, start, length, sequence, offset in pieces:
                held = ids_of[row]
                values = (held[0], start, length, zlib.crc32(held[1][4 * start : 4 * (start + length)]), len(held[1]) // 4, base + sequence, offset)
                for c, v in zip(cols, values):
                    c.append(v)
                held[2] -= length
                if held[2] == 0:
                    del ids_of[row]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], _NAMES)

        row = 0
        for b in slices(batches, "text"):
            out: list[tuple] = []
            ids, off = enc.encode(b.column("text"))
            raw = np.insert(ids.astype("<u4"), off[1:], end_id).tobytes()
            off = (4 * (off + np.arange(len(off)))).tolist()
            for doc, a, e in zip(b.column("doc_id").to_pylist(), off[:-1], off[1:]):
                ids_of[row] = [doc, raw[a:e], (e - a) // 4]
                out += packer.add(row, (e - a) // 4)
                row += 1
            if out:
                yield batch(out)
        out = list(packer.flush())
        if out:
            yield batch(out)

    _NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    src = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return src.mapInArrow(run, ", ".join(f"`{c}` bigint" for c in _NAMES))


def pack_instructions(
    examples: DataFrame, tokenizer: str, keep_space: bool = True, end_id: int = 0, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS
) -> DataFrame:
    """One row per piece of (example_id, prompt, response): example_id, start, length, loss_tokens, sequence_id, offset, example_tokens.

    An example is the ids of prompt and response and then `end_id`; those of
    the response and the end id bear loss.  An example stays whole unless it is
    over a limit by itself: then it is cut from the front into the fewest
    pieces.  Null prompts and responses count as empty; repeated, null and
    clashing ids, empty tables and other columns are as in pack_documents.
    """
    limits = (max_tokens, max_segments, max_loss)
    VectorPacker(limits, _document_loss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base = encoder(tokenizer, keep_space), _task_base()
        held: dict[int, list] = {}  # piece: id, start in its example, prompt tokens of it, tokens of the example

        def loss(piece: int, start: int, length: int) -> int:
            return max(0, start + length - max(start, held[piece][2]))

        packer = VectorPacker(limits, loss, cut=False)

        def batch(placed: list[tuple]) -> pa.RecordBatch:
            rows = []
            for piece, _, length, sequence, offset in placed:
                i, start, _, total = held[piece]
                rows.append((i, start, length, loss(piece, 0, length), base + sequence, offset, total))
                del held[piece]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], _NAMES)

        piece = 0
        for b in slices(batches, "response"):
            out: list[tuple] = []
            first, second = (np.diff(enc.encode(b.column(c))[1]).tolist() for c in ("prompt", "response"))
            for i, prompt, response in zip(b.column("example_id").to_pylist(), first, second):
                total, start = prompt + response + 1, 0
                while start < total:
                    lead = max(0, prompt - start)
                    length = min(total - start, max_tokens, lead + max_loss)
                    held[piece] = [i, start, lead, total]
                    out += packer.add(piece, length)
                    piece, start = piece + 1, start + length
            if out:
                yield batch(out)
        out = list(packer.flush())
        if out:
            yield batch(out)

    _NAMES = ["example_id", "start", "length", "loss_tokens", "sequence_id", "offset", "example_tokens"]
    src = examples.select(F.col("example_id").cast("bigint"), F.col("prompt").cast("string"), F.col("response").cast("string"))
    return src.mapInArrow(run, ", ".join(f"`{c}` bigint" for c in _NAMES))
