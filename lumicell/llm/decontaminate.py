"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, A-Z lower-cased.  The word 3-grams of the
test items are seeds; an item of one or two words is its own seed, and matches
every text that has these words in a row.  A first pass over the corpus counts the documents that
each seed occurs in; a seed is rare if that is at most RARE_FACTOR times the
median of its item's seeds (or RARE_DOCS).  The rule is relative to the item,
so an item that leaked into a third of all documents still has seeds.

A second pass joins documents to items by rare seeds.  Hits on near diagonals
make a window; with enough of them the window is aligned to the whole item
(match +2, other word -1, gap -1).  The score is the alignment's share of the
best possible, 2 x words of the item: 1 for an exact copy, about 1 - 1.5 p
where a share p of the words was replaced.

Scale.  Items are the small side: they are taken in blocks of ITEM_BYTES, each
collected and broadcast, and each needs two passes over the documents without
a shuffle of documents; what is exchanged is a count per seed and task.  The
filter judges each row where it is, so that no ids are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import saved, slices

SEED_WORDS = 3
#: A seed is rare up to RARE_FACTOR x the median document count of its item's seeds, or RARE_DOCS.
RARE_FACTOR, RARE_DOCS = 2.0, 8
#: Different rare seeds that a window needs (or all of an item that has fewer).
MIN_HITS = 2
MATCH, OTHER, GAP = 2, -1, -1
#: Least score of a contaminated document.
THRESHOLD = 0.5
#: Text of the items in one block.
ITEM_BYTES = 16 << 20
#: Blocks whose filters run in one pass.
BLOCKS_AT_ONCE = 4
#: Cells of one batch of alignments (rows x window).
CELLS = 1 << 18


@dataclass
class ItemBlock:
    """Items' words, and their seeds sorted by hash with the item and the place of each."""

    item_ids: list
    words: np.ndarray
    offsets: np.ndarray
    sizes: tuple[int, ...]  # words of a seed that occur
    seeds: np.ndarray
    seed_item: np.ndarray
    seed_at: np.ndarray

    @classmethod
    def build(cls, item_ids: list, texts: pa.Array) -> ItemBlock:
        words, off = tokens.word_hashes(*tokens.utf8(texts), punctuation=False)
        size = np.minimum(np.diff(off), SEED_WORDS)
        hashes, items, places, sizes = [], [], [], []
        for k in range(1, SEED_WORDS + 1):
            g, item, at = _grams(words, off, k)
            own = size[item] == k
            if own.any():
                sizes.append(k)
                hashes.append(g[own])
                items.append(item[own])
                places.append(at[own])
        if not sizes:
            none = np.zeros(0, np.int64)
            return cls(item_ids, words, off, (), none.astype(np.uint64), none, none)
        g, item, at = np.concatenate(hashes), np.concatenate(items), np.concatenate(places)
        order = np.argsort(g, kind="stable")
        return cls(item_ids, words, off, tuple(sizes), g[order], item[order], at[order])

    def keep(self, rare: np.ndarray) -> ItemBlock:
        return ItemBlock(self.item_ids, self.words, self.offsets, self.sizes, self.seeds[rare], self.seed_item[rare], self.seed_at[rare])


def _grams(words: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of every run of k words."""
    g, go = tokens.ngram_hashes(words, off, k, short=False)
    text = np.repeat(np.arange(len(off) - 1), np.diff(go))
    return g, text, np.arange(len(g)) - go[text]


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tokens.word_hashes(*tokens.utf8(batch.column("text")), punctuation=False)


def smith_waterman(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each pair of word sequences; all pairs at once."""
    rows, width, n = max(map(len, items)), max(map(len, windows)), len(items)
    a = np.zeros((n, rows), np.uint64)
    b = np.ones((n, width), np.uint64)  # pads never match: 0 against 1
    for k, (x, y) in enumerate(zip(items, windows)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    ramp = -GAP * np.arange(1, width + 1, dtype=np.int32)
    h = np.zeros((n, width + 1), np.int32)
    best = np.zeros(n, np.int32)
    for i in range(rows):
        t = np.maximum(h[:, :-1] + np.where(b == a[:, i : i + 1], MATCH, OTHER), h[:, 1:] + GAP)
        np.maximum(t, 0, out=t)
        h[:, 1:] = np.maximum.accumulate(t + ramp, axis=1) - ramp
        np.maximum(best, h.max(axis=1), out=best)
    return best


def _windows(block: ItemBlock, need: np.ndarray, words: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, item, first word, end word) of every window with enough hits."""
    docs, seeds, starts = [], [], []
    for k in block.sizes if len(block.seeds) else ():
        g, doc, place = _grams(words, off, k)
        if not len(g):
            continue
        lo = np.searchsorted(block.seeds, g, "left")
        hit = np.flatnonzero(block.seeds[np.minimum(lo, len(block.seeds) - 1)] == g)
        times = np.searchsorted(block.seeds, g[hit], "right") - lo[hit]
        at = np.repeat(hit, times)
        seed = np.repeat(lo[hit], times) + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        docs.append(doc[at])
        seeds.append(seed)
        starts.append(place[at] - block.seed_at[seed])
    if not docs or not sum(map(len, docs)):
        return []
    doc, seed, start = np.concatenate(docs), np.concatenate(seeds), np.concatenate(starts)
    item = block.seed_item[seed]
    order = np.lexsort((seed, start, item, doc))
    doc, item, start, seed = doc[order], item[order], start[order], seed[order]
    size = np.diff(block.offsets)
    out, a, n = [], 0, len(doc)
    while a < n:
        length, b = int(size[item[a]]), a
        while b < n and doc[b] == doc[a] and item[b] == item[a] and start[b] - start[a] <= length:
            b += 1
        if len(np.unique(seed[a:b])) >= need[item[a]]:
            slack = length // 4 + 2
            end = int(off[doc[a] + 1] - off[doc[a]])
            out.append((int(doc[a]), int(item[a]), max(0, int(start[a]) - slack), min(end, int(start[b - 1]) + length + slack)))
        a = b
    return out


def _prepared(docs: DataFrame, items: DataFrame) -> tuple[ItemBlock, np.ndarray]:
    """A block of items with its rare seeds, and the hits that each item needs."""
    held = items.toPandas()
    block = ItemBlock.build(held["item_id"].tolist(), pa.array(held["text"].tolist(), pa.string()))
    known = np.unique(block.seeds)
    shared = docs.sparkSession.sparkContext.broadcast((known, block.sizes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sizes = shared.value
        total = np.zeros(len(known), np.int64)
        for b in slices(batches, "text"):
            words, off = _words(b)
            for k in sizes:
                g, doc, _ = _grams(words, off, k)
                if not len(g):
                    continue
                at = np.minimum(np.searchsorted(known, g), len(known) - 1)
                hit = np.flatnonzero(known[at] == g)
                once = np.unique(doc[hit] * len(known) + at[hit])
                total += np.bincount(once % len(known), minlength=len(known))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["seed", "docs"])

    got = docs.select("text").mapInArrow(count, "seed bigint, docs bigint").groupBy("seed").agg(F.sum("docs").alias("docs")).toPandas()
    df = np.zeros(len(known), np.int64)
    df[got["seed"].to_numpy(np.int64)] = got["docs"].to_numpy(np.int64)
    of_seed = df[np.searchsorted(known, block.seeds)]
    median = np.zeros(len(block.item_ids))
    for k in np.unique(block.seed_item):
        median[k] = np.median(of_seed[block.seed_item == k])
    rare = block.keep(of_seed <= np.maximum(RARE_DOCS, RARE_FACTOR * median[block.seed_item]))
    distinct = np.zeros(len(block.item_ids), np.int64)
    pairs = np.unique(np.stack([rare.seed_item.astype(np.uint64), rare.seeds]), axis=1)[0].astype(np.int64) if len(rare.seeds) else np.zeros(0, np.int64)
    np.add.at(distinct, pairs, 1)
    return rare, np.clip(distinct, 1, MIN_HITS)


def _aligned(b: pa.RecordBatch, block: ItemBlock, need: np.ndarray, threshold: float) -> dict[tuple[int, int], tuple[float, int, int]]:
    """Best score and window of each (row, item) that reaches the threshold."""
    words, off = _words(b)
    found = sorted(_windows(block, need, words, off), key=lambda w: w[3] - w[2])
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    a = 0
    while a < len(found):
        e = a + 1
        while e < len(found) and (e - a + 1) * (found[e][3] - found[e][2]) <= CELLS:
            e += 1
        group = found[a:e]
        score = smith_waterman([block.words[block.offsets[i] : block.offsets[i + 1]] for _, i, _, _ in group], [words[off[d] + x : off[d] + y] for d, _, x, y in group])
        for (d, i, x, y), s in zip(group, score):
            share = float(s) / (MATCH * int(block.offsets[i + 1] - block.offsets[i]))
            if share >= threshold and share > best.get((d, i), (0.0, 0, 0))[0]:
                best[d, i] = (share, x, y)
        a = e
    return best


def _item_blocks(items: DataFrame, item_bytes: int) -> list[DataFrame]:
    items = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // item_bytes) or 1
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items for k in range(blocks)]


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word of each document and item that match.

    Score is in [threshold, 1]; the window is in words of the document; of
    windows with equal scores the shortest, then first one is given.  Texts or
    items that are null or without words match nothing; very long ones are read
    whole.  Rows that repeat, also with the same or no doc_id, are documents of
    their own.  An empty table on either side gives an empty result; other
    columns are ignored, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))

    def matches(part: DataFrame) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(_prepared(docs, part))

        def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, need = shared.value
            for b in slices(batches, "text"):
                best = _aligned(b, block, need, threshold)
                ids = b.column("doc_id").to_pylist()
                rows = [(ids[d], block.item_ids[i], s, x, y) for (d, i), (s, x, y) in sorted(best.items())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "score", "first_word", "end_word"])

        return docs.mapInArrow(align, "doc_id bigint, item_id bigint, score double, first_word bigint, end_word bigint")

    return reduce(DataFrame.unionByName, [matches(p) for p in _item_blocks(items, item_bytes)])


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows of docs that match no item, with all their columns.

    Each row is judged by its own text, whatever its doc_id (null, repeated);
    null and empty texts stay, and so does everything if there are no items.
    """
    parts = _item_blocks(items, item_bytes)
    for a in range(0, len(parts), BLOCKS_AT_ONCE):
        shared = [docs.sparkSession.sparkContext.broadcast(_prepared(docs, p)) for p in parts[a : a + BLOCKS_AT_ONCE]]

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text"):
                dirty = {d for s in shared for d, _ in _aligned(b, *s.value, threshold)}
                yield b.filter(pa.array([k not in dirty for k in range(b.num_rows)], pa.bool_())) if dirty else b

        docs = docs.mapInArrow(clean, docs.schema)
        if a + BLOCKS_AT_ONCE < len(parts):
            docs = saved(docs)
    return docs
