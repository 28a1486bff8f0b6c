"""Neighbours and distances over embeddings (cell, vec), and what is built on them.

Exact neighbours: the reference rows are held in blocks of checked size, each
broadcast in turn; every task keeps the best k of its rows so far, so that no
pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio

#: Reference rows of a block: with 64 floats, 13 MB.
BLOCK_ROWS = 50_000
#: Pairs of distances worked out at once.
TILE = 1 << 22


def _best(q: np.ndarray, ids: np.ndarray, r: np.ndarray, rid: np.ndarray, k: int, metric: str, skip_self: bool) -> tuple[np.ndarray, np.ndarray]:
    if metric == "cosine":
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        r = r / np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-12)
        d = 1 - q @ r.T
    else:
        d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (r * r).sum(1)[None] - 2 * q @ r.T, 0))
    d = np.round(d, 9)
    if skip_self:
        d[ids[:, None] == rid[None]] = np.inf
    k = min(k, len(rid))
    out = np.empty((len(q), k), np.int64)
    for i in range(len(q)):
        cut = np.partition(d[i], k - 1)[k - 1]
        near = np.flatnonzero(d[i] <= cut)
        out[i] = near[np.lexsort((rid[near], d[i, near]))][:k]
    return rid[out], np.take_along_axis(d, out, 1)


def knn(queries: DataFrame, reference: DataFrame, k: int = 15, metric: str = "euclidean", skip_self: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(cell, neighbour, distance, rank) of the k nearest reference rows; ties by the smaller id."""
    n = reference.count()
    blocks = -(-n // block_rows) or 1
    out = None
    for b in range(blocks):
        part = reference.where(F.pmod(F.xxhash64("cell"), F.lit(blocks)) == b) if blocks > 1 else reference
        held = part.select("cell", "vec").toPandas()
        rid = held["cell"].to_numpy(np.int64)
        vec = np.array(held["vec"].tolist(), np.float64).reshape(len(rid), -1)
        shared = queries.sparkSession.sparkContext.broadcast((rid, vec))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            rid, r = shared.value
            for batch in batches:
                if batch.num_rows == 0 or not len(rid):
                    continue
                ids = batch.column("cell").to_numpy(zero_copy_only=False)
                q = np.array(batch.column("vec").to_pylist(), np.float64)
                step = max(1, TILE // len(rid))
                for a in range(0, len(q), step):
                    to, d = _best(q[a : a + step], ids[a : a + step], r, rid, k, metric, skip_self)
                    ok = np.isfinite(d.ravel())
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[a : a + step], to.shape[1])[ok]), pa.array(to.ravel()[ok]), pa.array(d.ravel()[ok])], ["cell", "neighbour", "distance"])

        found = queries.select(F.col("cell").cast("bigint"), "vec").mapInArrow(run, "cell bigint, neighbour bigint, distance double")
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("cell").orderBy("distance", "neighbour")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def squared_distance(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> (cast(x as double) - cast(y as double)) * (cast(x as double) - cast(y as double))), 0D, (s, v) -> s + v)")


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """Mean vector of each group and its size; partial sums by group and place are combined map-side."""
    x = vectors.select(key, F.posexplode("vec").alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    return x.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"), F.max("n").alias("n"))


def centroid_distances(vectors: DataFrame, key: str) -> DataFrame:
    """Distances of group centroids, which are few."""
    c = centroids(vectors, key)
    a, b = c.select(F.col(key).alias("a"), F.col("centre").alias("ca")), c.select(F.col(key).alias("b"), F.col("centre").alias("cb"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.sqrt(squared_distance("ca", "cb")).alias("distance"))


def own_and_other_centroid(vectors: DataFrame, key: str) -> DataFrame:
    """Distance to the own centroid, to the nearest other, and their ratio."""
    c = centroids(vectors, key).select(F.col(key).alias("g"), "centre")
    listed = c.agg(F.collect_list(F.struct("g", "centre")).alias("c"))  # one row for each group
    d = vectors.join(F.broadcast(listed)).select("cell", key, F.explode("c").alias("c"), "vec").select("cell", key, F.col("c.g").alias("g"), F.sqrt(squared_distance("vec", "c.centre")).alias("d"))
    x = d.groupBy("cell", key).agg(F.max(F.when(F.col("g") == F.col(key), F.col("d"))).alias("own"), F.min(F.when(F.col("g") != F.col(key), F.col("d"))).alias("other"))
    return x.withColumn("ratio", ratio(F.col("own"), F.col("other")))


def calinski_harabasz(vectors: DataFrame, key: str) -> DataFrame:
    x = vectors.select(key, F.posexplode("vec").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    g = x.groupBy(key, "i").agg(F.sum("x").alias("s1"), F.sum(F.col("x") * F.col("x")).alias("s2"), F.count(F.lit(1)).alias("n"))
    t = g.groupBy("i").agg(F.sum("s1").alias("t1"), F.sum("s2").alias("t2"), F.sum(F.col("s1") * F.col("s1") / F.col("n")).alias("b"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    y = t.agg(F.sum(F.col("b") - F.col("t1") * F.col("t1") / F.col("n")).alias("between"), F.sum(F.col("t2") - F.col("b")).alias("within"), F.max("n").alias("n"), F.max("k").alias("k"))
    return y.select(ratio(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))).alias("score"))


def transfer_labels(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """Label with most weight 1/d among the neighbours, and its share; ties by the smaller label."""
    x = neighbours.join(labels.select(F.col("cell").alias("neighbour"), "label"), "neighbour").groupBy("cell", "label").agg(F.sum(1 / (F.col("distance") + 1e-10)).alias("w"))
    x = x.withColumn("share", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("cell")), 9))
    best = Window.partitionBy("cell").orderBy(F.desc("share"), "label")
    return x.withColumn("k", F.row_number().over(best)).where("k = 1").select("cell", "label", F.col("share").alias("confidence"))


def neighbour_mix(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """Entropy (bits) and inverse Simpson index of the labels around each cell."""
    x = neighbours.join(labels.select(F.col("cell").alias("neighbour"), "label"), "neighbour").groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("cell"))
    return x.withColumn("p", p).groupBy("cell").agg(F.sum(-F.col("p") * F.log2("p")).alias("entropy"), (1 / F.sum(F.col("p") * F.col("p"))).alias("lisi"))


def group_edges(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between groups over what chance would give (sizes' product over all)."""
    s = labels.select(F.col("cell"), F.col("label").alias("a"))
    t = labels.select(F.col("cell").alias("neighbour"), F.col("label").alias("b"))
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    e = neighbours.join(s, "cell").join(t, "neighbour").where("a < b or b < a").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("edges"))
    e = e.join(F.broadcast(sizes.select(F.col("label").alias("a"), F.col("n").alias("na"))), "a").join(F.broadcast(sizes.select(F.col("label").alias("b"), F.col("n").alias("nb"))), "b")
    return e.select("a", "b", "edges", (F.col("edges") / (2 * F.col("na") * F.col("nb"))).alias("connectivity"))


def shared_neighbours(neighbours: DataFrame, k: int) -> DataFrame:
    """Jaccard weight of neighbouring cells: shared / (2 k - shared)."""
    e = neighbours.select("cell", "neighbour")
    x = e.join(e.select(F.col("cell").alias("c"), F.col("neighbour").alias("m")).withColumnRenamed("c", "a"), F.col("cell") == F.col("a"))
    shared = x.join(e.select(F.col("cell").alias("o"), F.col("neighbour").alias("om")), (F.col("neighbour") == F.col("o")) & (F.col("m") == F.col("om")))
    return shared.groupBy("cell", "neighbour").agg(F.count(F.lit(1)).alias("shared")).withColumn("weight", F.col("shared") / (2 * k - F.col("shared")))


def mutual_neighbours(a_to_b: DataFrame, b_to_a: DataFrame) -> DataFrame:
    """Pairs that are among each other's neighbours."""
    back = b_to_a.select(F.col("cell").alias("neighbour"), F.col("neighbour").alias("cell"))
    return a_to_b.select("cell", "neighbour", "distance").join(back, ["cell", "neighbour"])


def impute(neighbours: DataFrame, values: DataFrame) -> DataFrame:
    """Mean of the neighbours' values (cell, value), weighted by 1/d; missing values are zero."""
    w = 1 / (F.col("distance") + 1e-10)
    x = neighbours.join(values.select(F.col("cell").alias("neighbour"), "value"), "neighbour", "left")
    return x.groupBy("cell").agg((F.sum(F.coalesce("value", F.lit(0.0)) * w) / F.sum(w)).alias("imputed"))


def morans_i(neighbours: DataFrame, values: DataFrame) -> DataFrame:
    """Moran's I of values (cell, value) over the neighbour graph with weight 1."""
    m = values.agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    c = values.join(F.broadcast(m)).select("cell", (F.col("value") - F.col("m")).alias("z"), "v")
    x = neighbours.select("cell", "neighbour").join(c, "cell").join(c.select(F.col("cell").alias("neighbour"), F.col("z").alias("zn")), "neighbour")
    return x.agg(ratio(F.avg(F.col("z") * F.col("zn")), F.max("v")).alias("moran"))


def silhouette(vectors: DataFrame, key: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact silhouette of each cell: mean distances to every group, from blocks of the data."""
    n = vectors.count()
    blocks = -(-n // block_rows) or 1
    out = None
    for b in range(blocks):
        held = (vectors.where(F.pmod(F.xxhash64("cell"), F.lit(blocks)) == b) if blocks > 1 else vectors).select(key, "vec").toPandas()
        shared = vectors.sparkSession.sparkContext.broadcast((held[key].to_numpy(), np.array(held["vec"].tolist(), np.float64)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            labels, r = shared.value
            names, at = np.unique(labels, return_inverse=True)
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                kind = batch.schema.field(key).type
                ids, own = batch.column("cell").to_numpy(zero_copy_only=False), batch.column(key).to_numpy(zero_copy_only=False)
                q = np.array(batch.column("vec").to_pylist(), np.float64).reshape(len(ids), -1)
                s = np.empty((len(ids), len(names)))
                for i in range(len(ids)):
                    s[i] = np.bincount(at, np.sqrt(((q[i] - r) ** 2).sum(1)), len(names))
                k, c = len(names), np.bincount(at, minlength=len(names))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, k)), pa.array(np.repeat(own, k), kind), pa.array(np.tile(names, len(ids)), kind), pa.array(s.ravel()), pa.array(np.tile(c, len(ids)), pa.int64())], ["cell", "own", "other", "s", "n"]
                )

        kind = dict(vectors.dtypes)[key]
        found = vectors.select(F.col("cell").cast("bigint"), key, "vec").mapInArrow(run, f"cell bigint, own {kind}, other {kind}, s double, n bigint")
        out = found if out is None else out.unionByName(found)
    x = out.groupBy("cell", "own", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    a = F.max(F.when(F.col("own") == F.col("other"), F.when(F.col("n") > 1, F.col("s") / (F.col("n") - 1))))
    y = x.groupBy("cell", F.col("own").alias(key)).agg(a.alias("a"), F.min(F.when(F.col("own") != F.col("other"), F.col("s") / F.col("n"))).alias("b"))
    return y.select("cell", key, F.coalesce(ratio(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("silhouette"))


def pca(vectors: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """Scores on the first k axes and the variance ratios: the Gram matrix is summed up
    in one pass (width squared numbers a task), solved at the driver."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = np.array(b.column("vec").to_pylist(), np.float64)
                x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["g"])

    parts = [np.frombuffer(r.g) for r in vectors.select("vec").mapInArrow(gram, "g binary").collect()]
    g = sum(parts)
    w = int(np.sqrt(len(g)))
    g = g.reshape(w, w)
    n, mean = g[0, 0], g[0, 1:] / g[0, 0]
    values, axes = np.linalg.eigh((g[1:, 1:] - n * np.outer(mean, mean)) / max(1.0, n - 1))
    order = np.argsort(-values)[:k]
    axes = axes[:, order] * np.sign(axes[np.abs(axes[:, order]).argmax(0), order])
    shared = vectors.sparkSession.sparkContext.broadcast((mean, axes))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, axes = shared.value
        for b in batches:
            if b.num_rows:
                s = (np.array(b.column("vec").to_pylist(), np.float64) - mean) @ axes
                yield pa.RecordBatch.from_arrays([b.column("cell"), pa.array(s.tolist(), pa.list_(pa.float64()))], ["cell", "vec"])

    return vectors.select(F.col("cell").cast("bigint"), "vec").mapInArrow(score, "cell bigint, vec array<double>"), values[order] / values.sum()
