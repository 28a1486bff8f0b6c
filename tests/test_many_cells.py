"""Rank sums of so many cells that the product of their numbers is beyond a bigint."""

import math

import pytest
from pyspark.sql import functions as F

from lumicell.model import CellData
from lumicell.operators import markers, scores

N = 4_000_000  # N / 2 * N / 2 * (N + 1) is 1.6e19


@pytest.fixture(scope="module")
def many(spark):
    """Gene g is held by the cells below 10 * g of group a, or b if g is odd, with values 1, 2, ...; gene 0 by none."""
    obs = spark.range(N).select(F.col("id").alias("cell"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("cluster"))
    counts = spark.createDataFrame([(2 * i + g % 2, g, float(i + 1)) for g in range(1, 7) for i in range(10 * g)], "cell bigint, gene bigint, value double")
    return CellData(counts, obs, spark.createDataFrame([(g, "xy"[g % 2]) for g in range(7)], "gene bigint, gset string"))


def z_of(g, group):
    """z of gene g: its 10 * g holders are the last in rank."""
    k, half = 10 * g, N // 2
    zeros = N - k
    held = k if (group == "b") == (g % 2 == 1) else 0
    doubled = 2 * sum(zeros + i + 1 for i in range(held)) + (half - held) * (zeros + 1) - half * (half + 1)  # 2 u, a whole number
    return (doubled - half * half) / 2 / math.sqrt(half * half * (N + 1) / 12)


def test_rank_sums(many):
    rows = markers.rank_sums(many, "cluster").collect()
    assert len(rows) == 12
    assert all(math.isclose(r.z, z_of(r.gene, r.cluster), rel_tol=1e-12) and r.n_in == r.n_out == N // 2 for r in rows)


def test_rank_genes_groups(many):
    rows = {(r.cluster, r["rank"]): r for r in markers.rank_genes_groups(many, "cluster").collect()}
    assert len(rows) == 12
    for group, order in (("a", [6, 4, 2, 1, 3, 5]), ("b", [5, 3, 1, 2, 4, 6])):
        assert [rows[group, k].gene for k in range(1, 7)] == order
        assert all(rows[group, k].zr == round(z_of(g, group), 6) for k, g in enumerate(order, 1))
        assert all(abs(rows[group, k].pval - math.erfc(abs(z_of(g, group)) / math.sqrt(2))) < 1e-6 for k, g in enumerate(order, 1))


def test_filtered_rankings(many):
    rows = scores.filter_ranked(markers.rank_genes_groups(many, "cluster"), 1.0, 1.0).where("log2fc > 0").orderBy("cluster", "rank").collect()
    assert [(r.cluster, r["rank"], r.gene) for r in rows] == [("a", 1, 6), ("a", 2, 4), ("a", 3, 2), ("b", 1, 5), ("b", 2, 3), ("b", 3, 1)]
    assert all(r.zr == round(z_of(r.gene, r.cluster), 6) > 0 for r in rows)


def test_set_enrichment(many):
    rows = {(r.cluster, r.gset): r for r in markers.set_enrichment(many, "cluster", "gset", n_top=3).collect()}
    assert {k: r.overlap for k, r in rows.items()} == {("a", "x"): 3, ("a", "y"): 0, ("b", "x"): 0, ("b", "y"): 3}
    assert abs(rows["a", "x"].pvalue - 4 / 35) < 1e-6 and abs(rows["b", "y"].pvalue - 1 / 35) < 1e-6  # of 7 genes 4 are x and 3 y


def test_marker_overlap(many):
    rows = markers.marker_overlap(markers.rank_genes_groups(many, "cluster", 2), many.var, "cluster", "gset").collect()
    assert sorted((r.cluster, r.gset, r.shared, r.jaccard) for r in rows) == [("a", "x", 2, 0.5), ("b", "y", 2, 2 / 3)]
