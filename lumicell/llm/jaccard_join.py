"""Jaccard join on word shingles with count-vector R-trees.

Texts are sets of hashed word 5-grams; two link when their Jaccard similarity
is at least `threshold`.  The result is the connected components of the links.

Method.  Each set is hashed into G groups (G grows with the set, so that a
group holds about four shingles) and the groups' counts are a point.  Two sets
share at most the sum over groups of the smaller count, so an R-tree over the
points, whose nodes keep the coordinate-wise maximum and the size range of
what is below, finds all partners that could reach the threshold; survivors
are verified on the sets themselves.

In so many dimensions a single tree over a corpus of unrelated texts prunes
nothing above its leaves and would be quadratic.  So trees are built per
bucket of an exact prefix filter: with the shingles of a set in one global
order, two sets that reach the threshold share one of the first
n - ceil(t n) + 1.  The order is by corpus frequency, rare first, read off a
fixed table of hashed counters, so that passages shared by many texts sink out
of the prefixes; any order is exact.

Steps.
 1. One pass counts shingles into the table (2**COUNTER_BITS numbers reach the
    driver).
 2. One pass gives size, set fingerprint, point and prefix of every row, and a
    row number that names it from then on; doc_ids may repeat or be missing.
    Rows with equal sets form a class, whose first row goes on alone as a node.
 3. Prefix shingles shuffle; buckets of one are dropped, and of buckets with
    the same members (shingles of one shared passage) one is kept.  Keys that a
    sample shows to be hot are counted apart, so that none has to meet in one
    task.
 4. Star step: each member is tried with its bucket's centre, the member whose
    prefix meets most others: in a group of edited copies that is what they
    were copied from.  Sizes and the bound of the points prune, the rest is
    verified, links are contracted.
 5. Tree step: buckets of three and more that still span several components
    get R-trees over finer points.  Members outside the bucket's largest
    component are the queries; large buckets are cut into slices of near sizes,
    and queries go to all slices whose sizes could reach the threshold.  A first round verifies the best survivor for
    each query and component, which joins most queries to their group; a second
    round, over buckets that had others and still span components, verifies all.
    A large group of near copies is one component by then, so its pairs are
    never listed.
 6. Components of all links by large-star/small-star contraction.

Nothing that grows with the corpus reaches the driver.  What is broadcast has
a checked size or is left to a shuffle join.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import BROADCAST_KEYS, discard, fewer, saved, slices, unused, without

SHINGLE = 5
#: Hashed frequency counters: 2 MB at the driver and in the broadcast.
COUNTER_BITS = 18
#: Nodes up to which a set of them is broadcast: about 50 MB.
BROADCAST_NODES = 300_000
#: Rows of narrow tables that are worth a task, and pairs of sets.
ROWS_A_TASK, PAIRS_A_TASK = 100_000, 4000
#: Children of an R-tree node.
FANOUT = 16
#: Points of a tree slice, queries of a query slice, and groups of a fine point, at most: 16 MB of points in a task.
TREE_ROWS, FINE_GROUPS = 512, 1 << 13
#: What a row of a slice is.
SEARCH, POINT, BOTH = 0, 1, 2
#: Bytes of a prefix shingle's hash that name its bucket; sharing a key by chance only adds members to a bucket.
KEY_BYTES = 6
#: A key in over 1/HOT_SHARE of the nodes, and in HOT_LEAST, is hot; so many of its rows are aimed at in the sample that finds it.
HOT_SHARE, HOT_LEAST, HOT_SEEN = 1000, 20_000, 64
_U = np.uint64


def groups_for(n: np.ndarray) -> np.ndarray:
    """Number of groups, a power of two: about n / 4, 16 at least."""
    return 1 << np.maximum(4, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64) - 2)


def count_vector(shingles: np.ndarray) -> np.ndarray:
    g = int(groups_for(np.array([len(shingles)]))[0])
    return np.bincount((shingles & _U(g - 1)).astype(np.int64), minlength=g).astype("<u4")


def to_cell(vector: np.ndarray) -> bytes:
    """Width of a count (1, or 4 where a count needs it), then the counts in Huffman codes: about two bits each."""
    width = 1 if vector.max(initial=0) < 256 else 4
    coder = zlib.compressobj(1, zlib.DEFLATED, -9, 1, zlib.Z_HUFFMAN_ONLY)
    return bytes([width]) + coder.compress(vector.astype(f"<u{width}").tobytes()) + coder.flush()


def from_cell(cell) -> np.ndarray:
    raw = memoryview(cell)
    return np.frombuffer(zlib.decompress(raw[1:], -9), f"<u{raw[0]}").astype("<u4")


def to_keys(shingles: np.ndarray) -> bytes:
    """The upper KEY_BYTES bytes of each hash."""
    return shingles.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def from_keys(cell) -> np.ndarray:
    keys = np.frombuffer(cell, np.uint8).reshape(-1, KEY_BYTES)
    return np.pad(keys, ((0, 0), (8 - KEY_BYTES, 0))).view(">u8").ravel().astype(np.int64)


def fold(vector: np.ndarray, g: int) -> np.ndarray:
    """The same counts over fewer groups."""
    return vector.reshape(-1, g).sum(axis=0) if len(vector) > g else vector


def needed(a, b, num: int, den: int):
    """Least overlap of sets of a and b with Jaccard similarity >= num / den."""
    return -(-num * (a + b) // (num + den))


def possible(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether the bound of two points, over as many groups as both have, allows the threshold."""
    g = min(len(x), len(y))
    return int(np.minimum(fold(x, g), fold(y, g)).sum()) >= needed(int(x.sum()), int(y.sum()), num, den)


class CountRTree:
    """Static R-tree over count vectors, packed by total and then by the largest spread."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, num: int, den: int) -> None:
        self.num, self.den = num, den
        order = np.argsort(sizes, kind="stable")
        if len(order) > FANOUT:  # within runs of near sizes, next to each other by the most telling group
            spread = int(np.argmax(vectors.astype(np.float64).var(axis=0)))
            run = FANOUT * FANOUT
            order = np.concatenate([c[np.argsort(vectors[c, spread], kind="stable")] for c in np.split(order, range(run, len(order), run))])
        self.order, self.points, self.sizes = order, vectors[order], sizes[order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        top, low, high = self.points, self.sizes, self.sizes
        while len(top) > 1:
            at = np.arange(0, len(top), FANOUT)
            top, low, high = np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((top, low, high))

    def search(self, vector: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Points whose overlap bound with `vector` allows the threshold, and the bounds."""
        at = np.arange(len(self.levels[-1][0])) if self.levels else np.arange(len(self.points))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            bound = np.minimum(top[at], vector).sum(axis=1)
            keep = (bound >= needed(size, low[at], self.num, self.den)) & (self.den * size >= self.num * low[at]) & (self.den * high[at] >= self.num * size)
            below = self.levels[depth - 1][0] if depth else self.points
            at = (at[keep][:, None] * FANOUT + np.arange(FANOUT)).ravel()
            at = at[at < len(below)]
        other = self.sizes[at]
        bound = np.minimum(self.points[at], vector).sum(axis=1)
        ok = bound >= needed(size, other, self.num, self.den)
        ok &= (self.den * size >= self.num * other) & (self.den * other >= self.num * size)
        return self.order[at[ok]], bound[ok]


def _shingles(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tokens.ngram_hashes(*tokens.word_hashes(*tokens.utf8(batch.column("text"))), SHINGLE)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << COUNTER_BITS, np.int64)
    for b in slices(batches, "text"):
        total += np.bincount((_shingles(b)[0] >> _U(64 - COUNTER_BITS)).astype(np.int64), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "n"])


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text; id and hash find a row again."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).withColumn("th", F.xxhash64("text"))


def _features(docs: DataFrame, counters: np.ndarray, num: int, den: int) -> DataFrame:
    """doc_id, th, n, set fingerprint (a, b), point, prefix of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value
        for batch in slices(batches, "text"):
            g, off = _shingles(batch)
            n, a, b, points, prefixes = [], [], [], [], []
            for i in range(batch.num_rows):
                s = np.unique(g[off[i] : off[i + 1]])
                n.append(len(s))
                a.append(int(tokens.mix(s).sum(dtype=_U).view(np.int64)))
                b.append(int(tokens.mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U).view(np.int64)))
                points.append(to_cell(count_vector(s)))
                m = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
                if 0 < m < len(s):
                    s = s[np.lexsort((s, freq[(s >> _U(64 - COUNTER_BITS)).astype(np.int64)]))[:m]]
                prefixes.append(to_keys(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), *(pa.array(c, pa.int64()) for c in (n, a, b)), pa.array(points, pa.binary()), pa.array(prefixes, pa.binary())],
                ["doc_id", "th", "n", "a", "b", "point", "prefix"],
            )

    return docs.mapInArrow(run, "doc_id bigint, th bigint, n bigint, a bigint, b bigint, point binary, prefix binary")


def _postings(prefixes: DataFrame, hot: np.ndarray, inside: bool) -> DataFrame:
    """(h, node) of every key of (node, prefix), once each, of the hot keys only or of all others."""
    shared = prefixes.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for b in slices(batches, "prefix"):
            keys = [np.unique(from_keys(x.as_buffer())) for x in b.column("prefix")]
            h = np.concatenate(keys)
            nodes = np.repeat(b.column("node").to_numpy(), list(map(len, keys)))
            if len(hot):
                keep = np.isin(h, hot) == inside
                h, nodes = h[keep], nodes[keep]
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(nodes)], ["h", "node"])

    return prefixes.select("node", "prefix").mapInArrow(run, "h bigint, node bigint")


def _met(nodes: DataFrame) -> DataFrame:
    """(h, node, members) of all buckets with two members or more."""
    none, n = np.zeros(0, np.int64), nodes.count()
    aim = max(HOT_LEAST, n // HOT_SHARE)
    hot = none
    if n >= HOT_LEAST:  # a sample of nodes shows which keys are hot; it decides how they are counted, not what is found
        some = nodes.where(F.pmod(F.xxhash64("node"), F.lit(aim // HOT_SEEN)) == 0)
        often = _postings(some, none, False).groupBy("h").count().where(F.col("count") >= HOT_SEEN // 2).select("h")
        hot = np.sort(often.toPandas()["h"].to_numpy(np.int64))  # 64 * prefix keys of HOT_SHARE texts at most
    met = _postings(nodes, hot, False).withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("members > 1")
    if len(hot):
        own = saved(_postings(nodes, hot, True))
        met = met.unionByName(own.join(F.broadcast(own.groupBy("h").agg(F.count(F.lit(1)).alias("members"))), "h").select("h", "node", "members"))
    return saved(met)


def _only(docs: DataFrame, rows: DataFrame, nodes: DataFrame, twice: DataFrame) -> DataFrame:
    """node and text of the wanted nodes; rows (node, doc_id, th) tells where they are, twice (doc_id, th) which rows repeat as a whole."""
    small = nodes.count() <= BROADCAST_NODES
    want = rows.join(F.broadcast(nodes) if small else nodes.hint("merge"), "node", "left_semi")
    want = saved(want.select("node", F.col("doc_id").alias("_id"), F.col("th").alias("_th")))
    found = docs.join(F.broadcast(want) if small else want.hint("merge"), docs["doc_id"].eqNullSafe(want["_id"]) & (docs["th"] == want["_th"])).select("node", "doc_id", "th", "text")
    if twice is None:
        return found.select("node", "text")
    key = F.broadcast(twice) if twice.count() <= BROADCAST_KEYS else twice.hint("merge")
    on = found["doc_id"].eqNullSafe(twice["_id"]) & (found["th"] == twice["_th"])
    return found.join(key, on, "left_anti").unionByName(found.join(key, on, "left_semi").dropDuplicates(["node"])).select("node", "text")


def _bounded(pairs: DataFrame, points: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (u, v) that the bound of their points leaves."""
    p = points.select("node", "point")
    joined = pairs.join(p.withColumnsRenamed({"node": "u", "point": "pu"}), "u").join(p.withColumnsRenamed({"node": "v", "point": "pv"}), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("pu"), b.column("pv")):
                keep.append(possible(from_cell(x.as_buffer()), from_cell(y.as_buffer()), num, den))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return fewer(joined, pairs.count(), 4 * PAIRS_A_TASK).mapInArrow(run, "u bigint, v bigint")


def _verified(pairs: DataFrame, texts_of, num: int, den: int) -> DataFrame:
    """Pairs (u, v) whose sets reach the threshold; texts_of(nodes) gives node and text.

    Of a pair the v side's set travels to u, so that the set of a u with very
    many pairs, a bucket's centre, travels once.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            g, off = _shingles(batch)
            cells = [np.unique(g[off[i] : off[i + 1]]).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(cells, pa.binary())], ["node", "shingles"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("su"), b.column("sv")):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    n = pairs.count()
    nodes = saved(fewer(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), n, ROWS_A_TASK))
    found = saved(fewer(texts_of(nodes), n, PAIRS_A_TASK).mapInArrow(sets, "node bigint, shingles binary"))
    centres = found.join(pairs.select(F.col("u").alias("node")).distinct(), "node", "left_semi")
    joined = pairs.join(found.select(F.col("node").alias("v"), F.col("shingles").alias("sv")), "v").join(centres.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u")
    out = saved(fewer(joined, n, PAIRS_A_TASK).mapInArrow(check, "u bigint, v bigint"))
    discard(nodes, found)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (u, v); root is the smallest node reachable.

    Alternating large-star and small-star steps; a few rounds for any shape.
    The smallest neighbours are written before they are joined, so that a node
    with many neighbours is an ordinary skewed join that AQE splits.
    """

    held: list[DataFrame] = []
    small = lambda df: fewer(df, n, ROWS_A_TASK)

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
        if large:
            both = both.unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
            least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
            held.append(saved(small(least)))
            out = both.join(held[-1], "x").where("y > x").select(F.col("m").alias("v"), F.col("y").alias("u"))
        else:  # u > v in every edge
            least = both.groupBy("x").agg(F.min("y").alias("m"))
            held.append(saved(small(least)))
            out = both.join(held[-1], "x").select(F.explode(F.array(F.struct(F.col("x").alias("u"), F.col("m").alias("v")), F.struct(F.col("y").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        return small(small(out.where("u <> v").select("u", "v")).distinct())

    edges = saved(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state, n = None, edges.count()
    while True:
        before, edges = edges, saved(star(star(edges, True), False))
        discard(before, *held)
        held.clear()
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum("u"), F.sum("v"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state:
            break
        state, n = now, now[0]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _fine_points(texts: DataFrame) -> DataFrame:
    """node, n and the fine point (one to two groups a shingle) of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            g, off = _shingles(batch)
            sets = [np.unique(g[off[i] : off[i + 1]]) for i in range(batch.num_rows)]
            cells = []
            for s in sets:
                fine = min(FINE_GROUPS, 4 * int(groups_for(np.array([len(s)]))[0]))
                cells.append(to_cell(np.bincount((s & _U(fine - 1)).astype(np.int64), minlength=fine).astype("<u4")))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(map(len, sets), pa.int64()), pa.array(cells, pa.binary())], ["node", "n", "point"])

    return texts.mapInArrow(run, "node bigint, n bigint, point binary")


def _slice_pairs(rows: list[tuple], num: int, den: int, best: bool) -> tuple[list[int], list[int], bool]:
    """Pairs across components that R-trees leave, of rows (node, comp, n, point, query, role).

    role tells points (POINT, BOTH) and rows that search among them (SEARCH,
    BOTH); query that a node searches, here or elsewhere, so that each pair of
    such nodes comes once.  There is a tree for each number of groups, searched at the coarser
    of its and the searching row's resolution.  best: only the likeliest for
    each row and component; the last value tells whether others were left out.
    """
    ids, comp, n = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2))
    points = [from_cell(r[3]) for r in rows]
    query, role = np.array([r[4] for r in rows], bool), np.array([r[5] for r in rows])
    home = role != SEARCH
    groups = np.array([len(p) for p in points])
    trees: dict[tuple[int, int], tuple[np.ndarray, CountRTree]] = {}
    us, vs, rest = [], [], False
    for i in np.flatnonzero(role != POINT):
        for g in np.unique(groups[home]):
            if not groups[i] <= 2 * g <= 4 * groups[i]:  # sizes of a link are within a factor of two
                continue
            at = min(int(g), int(groups[i]))
            if (g, at) not in trees:
                own = np.flatnonzero(home & (groups == g))
                flat = np.array([fold(points[k], at) for k in own])
                trees[g, at] = own, CountRTree(flat.astype(np.uint8) if flat.max() < 256 else flat, n[own], num, den)
            own, tree = trees[g, at]
            found, bound = tree.search(fold(points[i], at), int(n[i]))
            j = own[found]
            keep = (comp[j] != comp[i]) & (~query[j] | (ids[j] > ids[i]))
            j, bound = j[keep], bound[keep]
            if best and len(j):
                order = np.lexsort((ids[j], -bound / (n[j] + n[i])))
                first = np.unique(comp[j][order], return_index=True)[1]
                rest |= len(first) < len(j)
                j = j[order[first]]
            us += [int(ids[i])] * len(j)
            vs += ids[j].tolist()
    return us, vs, rest


def _tree_pairs(batches: Iterator[pa.RecordBatch], num: int, den: int, best: bool) -> Iterator[pa.RecordBatch]:
    """Pairs (u < v) of each run of rows with the same bucket and slices; a row with `rest` names a bucket with more pairs."""
    held: list[tuple] = []
    at = None

    def emit() -> pa.RecordBatch:
        us, vs, rest = _slice_pairs(held, num, den, best)
        pairs = [(min(p), max(p), None) for p in zip(us, vs)] + [(None, None, at[0])] * rest
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in range(3)], ["u", "v", "rest"])

    for b in batches:
        for h, part, *row in zip(*(b.column(c).to_pylist() for c in ("h", "part", "node", "comp", "n", "point", "query", "role"))):
            if (h, part) != at and held:
                yield emit()
                held = []
            at = h, part
            held.append(tuple(row))
    if held:
        yield emit()


def _with_partners(wide: DataFrame, num: int, den: int) -> DataFrame:
    """Rows of wide (h, node, n, members) without those of small buckets whose
    size reaches the threshold with no other member's; large buckets stay as they are."""
    by_size = Window.partitionBy("h").orderBy("n")
    small = wide.where(F.col("members") <= TREE_ROWS).select("*", F.lag("n").over(by_size).alias("less"), F.lead("n").over(by_size).alias("more"))
    small = small.where((F.col("less") * den >= F.col("n") * num) | (F.col("n") * den >= F.col("more") * num))
    return small.select(*wide.columns).unionByName(wide.where(F.col("members") > TREE_ROWS))


def _open_slices(wide: DataFrame, comp: DataFrame, num: int, den: int) -> DataFrame:
    """Slices (h, part) of the buckets in wide (h, node, n, members) that span several components.

    Rows outside the bucket's largest component are queries.  A large bucket is
    cut into bands of sizes a threshold wide; a query goes to all bands that its
    partners can be in.  Points and queries of a band are cut into slices of
    TREE_ROWS, and each query slice meets each slice of points.
    """
    small = lambda df: fewer(df, n, ROWS_A_TASK)
    n = wide.count()
    wide = wide.join(comp.withColumnsRenamed({"root": "comp"}), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    largest = wide.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("h").agg(F.max(F.struct("k", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"))
    largest = saved(small(largest).where("comps > 1").select("h", F.col("top.comp").alias("main")))
    at = F.when(F.col("members") > TREE_ROWS, F.log(F.col("n").cast("double")) / math.log(den / num)).otherwise(F.lit(0.0)) if num < den else F.lit(0.0)
    reach = F.when(F.col("members") > TREE_ROWS, F.lit(1 + 1e-6)).otherwise(F.lit(0.0)) if num < den else F.lit(0.0)
    rows = saved(
        small(wide.join(largest, "h")).select("h", "node", "comp", (F.col("comp") != F.col("main")).alias("query"), *(F.floor(at + sign * reach).cast("int").alias(c) for c, sign in (("band", 0), ("low", -1), ("high", 1))))
    )
    asked = rows.where("query").select("h", "node", "comp", F.col("band").alias("own"), F.explode(F.sequence("low", "high")).alias("band"))
    parts = rows.groupBy("h", "band").agg(F.ceil(F.count(F.lit(1)) / TREE_ROWS).cast("int").alias("parts"))
    parts = saved(small(parts.join(asked.groupBy("h", "band").agg(F.ceil(F.count(F.lit(1)) / TREE_ROWS).cast("int").alias("queries")), ["h", "band"])))
    slot = lambda seed, of: F.expr(f"cast(pmod(xxhash64(node, {seed}), {of}) as int)")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    homes = rows.join(parts, ["h", "band"]).select("h", "band", slot(1, "parts").alias("at"), every("queries").alias("asks"), "node", "comp", "query", slot(2, "queries").alias("own"))
    homes = homes.withColumn("role", F.when(F.col("query") & (F.col("asks") == F.col("own")), BOTH).otherwise(POINT)).drop("own")
    asked = asked.join(parts, ["h", "band"]).select("h", "band", "own", slot(1, "parts").alias("home"), every("parts").alias("at"), slot(2, "queries").alias("asks"), "node", "comp")
    asked = asked.where("band <> own or at <> home").select("h", "band", "at", "asks", "node", "comp", F.lit(True).alias("query"), F.lit(SEARCH).alias("role"))
    part = F.expr("(cast(band as bigint) << 48) + (cast(at as bigint) << 24) + asks").alias("part")
    return saved(small(homes.unionByName(asked)).select("h", part, "node", "comp", "query", "role"))


def _rows(docs: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows (doc_id, th, n, a, b), all classes (a, b, n, size, root, component_id) and what doc_id and th are shared by several rows.

    root is the number of a row that stands for the component, component_id the
    smallest doc_id in it.
    """
    docs = _hashed(docs)
    counters = np.zeros(1 << COUNTER_BITS, np.int64)
    slots = docs.select("text").mapInArrow(_count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counters[slots["slot"].to_numpy()] = slots["n"].to_numpy()

    features = saved(_features(docs, counters, num, den).withColumn("row", F.monotonically_increasing_id()))
    classes = saved(features.where("n > 0").groupBy("a", "b", "n").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size")))
    twice = saved(features.where("n > 0").groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).count().where("count > 1").select("_id", "_th"))
    twice = twice if twice.count() else None
    # rows that are not their class's node: few texts are copies, so mostly a broadcast of row numbers
    copies = features.select("row", "a", "b", "n").join(classes.where("size > 1").select("a", "b", "n", "node"), ["a", "b", "n"]).where("row <> node")
    copies = saved(copies.select("row"))
    nodes = features.where("n > 0").join(F.broadcast(copies) if copies.count() <= BROADCAST_NODES else copies.hint("merge"), "row", "left_anti").withColumnRenamed("row", "node")
    texts_of = lambda wanted: _only(docs, features.withColumnRenamed("row", "node").select("node", "doc_id", "th"), wanted, twice)

    met = _met(nodes)
    n = met.count()
    small = lambda df: fewer(df, n, ROWS_A_TASK)
    reach = met.groupBy("node").agg(F.sum("members").alias("reach"))
    buckets = met.join(reach, "node").groupBy("h").agg(
        F.max(F.struct("reach", (-F.col("node")).alias("m"))).alias("top"), F.first("members").alias("members"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.pmod(F.xxhash64("node", "node"), F.lit(1 << 40))).alias("s")
    )
    buckets = saved(small(buckets.groupBy("members", "x", "s").agg(F.min("h").alias("h"), F.first(-F.col("top.m")).alias("centre"))).select("h", "centre"))
    postings = saved(small(met.join(buckets, "h")))
    n = postings.count()
    discard(met, buckets)

    star = saved(small(postings.where("node <> centre").select(F.col("centre").alias("u"), F.col("node").alias("v")).distinct()))
    links = _verified(saved(_bounded(star, nodes, num, den)), texts_of, num, den)
    comp = saved(components(links))

    sizes = classes.select("node", "n")
    wide = saved(small(_with_partners(postings.where("members > 2").select("h", "node", "members").join(sizes, "node"), num, den)))
    discard(postings)
    tried = star.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    fine = None
    for best in (True, False):
        open_ = _open_slices(wide, comp, num, den)
        n = open_.count()
        if fine is None:  # the second round's nodes are among the first's
            fine = saved(_fine_points(fewer(texts_of(saved(small(open_.select("node").distinct()))), n, PAIRS_A_TASK)))
        dealt = open_.join(fine, "node").repartition("h", "part").sortWithinPartitions("h", "part")
        found = saved(fewer(dealt, n, 4 * TREE_ROWS).mapInArrow(lambda it, best=best: _tree_pairs(it, num, den, best), "u bigint, v bigint, rest bigint"))
        discard(open_)
        wide = wide.join(found.where("rest is not null").select(F.col("rest").alias("h")).distinct(), "h", "left_semi")
        pairs = saved(small(found.where("u is not null").select("u", "v").distinct().join(tried, ["u", "v"], "left_anti")))
        if pairs.isEmpty():  # in the first round all best pairs may be tried ones
            continue
        more = _verified(pairs, texts_of, num, den)
        tried = tried.unionByName(pairs)
        if not more.isEmpty():
            links = links.unionByName(more)
            comp = saved(components(links))
    discard(fine)

    joined = classes.join(comp, "node", "left")
    linked = saved(joined.where("root is not null"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    columns = ["a", "b", "n", "size", "root", "component_id"]
    roots = linked.join(least, "root").select(columns).unionByName(joined.where("root is null").select("a", "b", "n", "size", F.col("node").alias("root"), F.col("least").alias("component_id")))
    return features.select("doc_id", "th", "n", "a", "b"), saved(roots), twice


def _with_classes(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with root and component_id; a class with very many copies is broadcast, so its rows never meet in one task."""
    hot = F.col("size") > max(256, rows.count() // 1000)  # a thousand classes at most
    tried = rows.join(F.broadcast(roots.where(hot).drop("size")), ["a", "b", "n"], "left")
    cold = tried.where("root is null").drop("root", "component_id").join(roots.where(~hot).drop("size"), ["a", "b", "n"], "left")
    return tried.where("root is not null").unionByName(cold)


def jaccard_components(docs: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of (doc_id, text).

    Two texts link if den * intersection >= num * union of their shingle sets;
    component_id is the smallest doc_id that links reach, the own one included.
    A text of fewer than five words is one shingle; one without words (or
    null) has none, n_shingles 0, and links with nothing.  Very long texts are
    read whole.  Each row is a text of its own, also when doc_ids repeat, with
    equal or different texts, or are null: a component is one of rows, and its
    id the smallest doc_id among them, null if none has any.  An empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    rows, roots, _ = _rows(docs, num, den)
    out = _with_classes(rows, roots)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """One row of each component, that with the smallest doc_id, with all its columns.

    Rows without doc_id come after others; of a doc_id with several texts in a
    component that with the least hash stays, of rows that share doc_id and
    text one (which one is not defined if their other columns differ).  All
    texts without words stay.  An empty table stays empty.
    """
    rows, roots, twice = _rows(docs, num, den)
    found = _with_classes(rows, roots).where("n > 0").select("doc_id", "th", "root")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "th")).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    first = saved(first)
    hot = F.col("rows") > max(256, rows.count() // 1000)  # a thousand components at most
    stays = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.th") == F.col("th"))
    gone = found.join(F.broadcast(first.where(hot)), "root").unionByName(found.join(first.where(~hot), "root")).where(~stays)
    th = unused(docs, "_text_hash")
    marked = docs.withColumn(th, F.xxhash64(F.col("text").cast("string")))
    out = without(marked, gone.select("doc_id", F.col("th").alias(th)))
    if twice is not None:
        key = F.broadcast(twice) if twice.count() <= BROADCAST_KEYS else twice.hint("merge")
        on = out["doc_id"].eqNullSafe(twice["_id"]) & (out[th] == twice["_th"])
        out = out.join(key, on, "left_anti").unionByName(out.join(key, on, "left_semi").dropDuplicates(["doc_id", th]))
    return out.drop(th)
