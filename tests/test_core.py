"""Core operators: every query against DuckDB on the smallest tables, and edge cases."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumicell.functions import stats
from lumicell.model import CellData
from lumicell.operators import cells, markers, reads, vectors
from lumicell.plans.all_queries import QUERIES, SQL
from lumicell.sources import tables
from lumicell.streaming import events

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(D):
        if os.path.isfile(f"{D}/{f}"):
            con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    return con


def canonical(rows):
    def cell(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        return round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__name__ == "Decimal" else str(x)

    return sorted((tuple(map(cell, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, D)
    columns = sorted(got.columns)
    got = canonical(got.select(*columns).collect())
    want = canonical(duck.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-5 for x, y in zip(a, b)), (a, b)


def small(spark, triples, labels):
    counts = spark.createDataFrame(triples, "cell bigint, gene bigint, value double")
    obs = spark.createDataFrame(labels, "cell bigint, cluster string")
    genes = sorted({g for _, g, _ in triples} | {0})
    return CellData(counts, obs, spark.createDataFrame([(g, "a") for g in genes], "gene bigint, gset string"))


def test_rank_sums_with_ties_and_zeros(spark):
    rng = np.random.default_rng(0)
    x = rng.poisson(0.7, (30, 4)).astype(float)
    labels = [(i, "ab"[i % 3 > 0]) for i in range(30)]
    d = small(spark, [(i, g, float(x[i, g])) for i in range(30) for g in range(4) if x[i, g]], labels)
    for r in markers.rank_sums(d, "cluster").collect():
        v = x[:, r.gene]
        rank = np.array([(v < y).sum() + ((v == y).sum() + 1) / 2 for y in v])
        inside = np.array([c == r.cluster for _, c in labels])
        u = rank[inside].sum() - inside.sum() * (inside.sum() + 1) / 2
        assert abs(r.u - u) < 1e-9 and abs(r.mean_in - v[inside].mean()) < 1e-9 and abs(r.mean_out - v[~inside].mean()) < 1e-9


def test_single_group_and_empty_data_give_no_statistic(spark):
    d = small(spark, [(1, 1, 2.0), (2, 1, 3.0)], [(1, "a"), (2, "a"), (3, "a")])
    assert [r.z for r in markers.rank_sums(d, "cluster").collect()] == [None]
    none = small(spark, [(1, 1, 1.0)], [(1, "a")])
    none = none.with_counts(none.counts.where("value < 0"))
    assert cells.normalize(none).counts.count() == 0 and markers.rank_genes_groups(none, "cluster").count() == 0
    assert cells.qc_cells(none).first().total == 0


def test_bh_matches_plain_version(spark):
    p = [0.01, 0.04, 0.03, 0.2, 0.2, 1.0]
    got = stats.adjust_bh(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p", "q", [], ["i"]).collect()
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((np.array(p)[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    assert np.allclose([r.q for r in sorted(got, key=lambda r: r.i)], np.minimum(q, 1)[np.argsort(order)])


def test_normal_tail_matches_erfc(spark):
    z = [-4.0, -1.0, 0.0, 0.5, 2.5, 6.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select(stats.normal_tail(F.col("z"))).collect()
    assert np.allclose([r[0] for r in got], [math.erfc(abs(x) / math.sqrt(2)) for x in z], atol=2e-7)


def test_blocks_of_neighbours_agree(spark):
    v = tables.vectors(spark, D)
    one, many = (sorted(vectors.knn(v, v, 5, block_rows=b).collect()) for b in (10_000, 120))
    assert [r[:2] for r in one] == [r[:2] for r in many]
    a, b = (sorted(vectors.silhouette(v, "label", block_rows=n).collect()) for n in (10_000, 120))
    assert np.allclose([r.silhouette for r in a], [r.silhouette for r in b])


def test_pca_matches_numpy(spark):
    v = tables.vectors(spark, D)
    scores, ratio = vectors.pca(v, 3)
    rows = sorted(v.collect(), key=lambda r: r.cell)
    x = np.array([r.vec for r in rows], float)
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    got = np.array([r.vec for r in sorted(scores.collect(), key=lambda r: r.cell)])
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]), atol=1e-6) and np.allclose(ratio, s[:3] ** 2 / (s**2).sum())


def test_encode_bases(spark):
    df = spark.createDataFrame([("ACGT",), ("TTTT",), ("ACGN",), ("ACG",), (None,)], "s string")
    assert [r[0] for r in df.select(reads.encode_bases("s", 4)).collect()] == [27, 255, None, None, None]


def test_round_trip_and_slice(spark, tmp_path):
    d = tables.from_tables(spark, D)
    tables.write(d, str(tmp_path / "x"))
    back = tables.read(spark, str(tmp_path / "x"))
    assert canonical(back.counts.collect()) == canonical(d.counts.collect())
    cut = tables.slice_cells(back, "cluster = '1-URGENT'", 5)
    assert cut.obs.count() == 5 and cut.counts.join(cut.obs, "cell", "left_anti").count() == 0
    with pytest.raises(KeyError):
        cells.obs_values(d, ["nothing"], 1)


def test_stream_matches_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    batch = tables.events(spark, D)
    batch.repartition(1).sortWithinPartitions("ts").write.parquet(src)
    stream = events.watermarked(spark.readStream.schema(batch.schema).parquet(src), "0 seconds")
    got = events.run_once(events.tumbling(stream, "6 hours", "event_type"), str(tmp_path / "out"), str(tmp_path / "cp"))
    want = canonical(events.tumbling(events.watermarked(batch, "0 seconds"), "6 hours", "event_type").collect())
    found = canonical(got.collect())
    assert found and set(map(repr, found)) <= set(map(repr, want))
