"""Operators whose results SQL doesn't check, or not at their edges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumicell.functions import stats
from lumicell.model import CellData
from lumicell.operators import alignments, catalog, cells, graphs, markers, receptors, scores, tags, vectors


def planted(spark, groups=4, size=12, seed=1):
    """A graph of dense groups with few edges between them, both directions."""
    rng, edges = random.Random(seed), {}
    for a in range(groups * size):
        for b in range(a):
            if rng.random() < (0.7 if a // size == b // size else 0.02):
                edges[a, b] = edges[b, a] = 1.0
    return spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "cell bigint, neighbour bigint, weight double")


def test_louvain_finds_planted_communities(spark):
    g = planted(spark)
    found = graphs.louvain(g)
    got = {r.cell: r.community for r in found.collect()}
    assert len(got) == 48 and all(got[a] == got[b] for a in got for b in got if a // 12 == b // 12) and len(set(got.values())) == 4
    assert all(c == min(k for k in got if got[k] == c) for c in set(got.values()))
    q = graphs.modularity(g, found).first()[0]
    one = graphs.modularity(g, found.withColumn("community", F.lit(0))).first()[0]
    assert q > 0.6 and abs(one) < 1e-9
    again = {r.cell: r.community for r in graphs.louvain(g.repartition(7)).collect()}
    assert again == got
    assert len({r.community for r in graphs.louvain(g, resolution=50.0).collect()}) > 10


def test_louvain_of_an_empty_graph(spark):
    assert graphs.louvain(spark.createDataFrame([], "cell bigint, neighbour bigint, weight double")).count() == 0


def test_spanning_tree_takes_the_heaviest_edges(spark):
    e = spark.createDataFrame([("a", "a", 9.0), ("a", "b", 0.5), ("a", "c", 0.4), ("b", "c", 0.45), ("d", "e", 0.1)], "a string, b string, connectivity double")
    assert graphs.maximum_spanning_tree(e) == [("a", "b", 0.5), ("b", "c", 0.45), ("d", "e", 0.1)]


def test_gamma_functions(spark):
    rows = [(x, k) for x in (0.5, 1.0, 2.5, 30.0, 400.0) for k in (1.0, 2.0, 7.0, 300.0)]
    df = spark.createDataFrame(rows, "x double, k double")
    got = df.select("x", "k", stats.log_gamma(F.col("x")).alias("g"), stats.poisson_tail(F.col("k"), F.col("x")).alias("p"), stats.chi2_tail(F.col("x"), F.lit(4.0)).alias("c")).collect()
    for r in got:
        assert abs(r.g - math.lgamma(r.x)) < 1e-9 * max(1, abs(r.g))
        below = sum(math.exp(i * math.log(r.x) - r.x - math.lgamma(i + 1)) for i in range(int(r.k)))
        assert abs(r.p - (1 - below)) < 1e-9
        assert abs(r.c - math.exp(-r.x / 2) * (1 + r.x / 2)) < 1e-9


def test_hypergeometric_tail_matches_counting(spark):
    df = spark.createDataFrame([(2, 5, 6, 20), (0, 5, 6, 20), (5, 5, 6, 20), (3, 8, 4, 12)], "a bigint, m bigint, k bigint, n bigint")
    for r in df.select("*", stats.hypergeometric_tail(*map(F.col, "amkn")).alias("p")).collect():
        want = sum(math.comb(r.k, i) * math.comb(r.n - r.k, r.m - i) for i in range(r.a, min(r.m, r.k) + 1)) / math.comb(r.n, r.m)
        assert abs(r.p - want) < 1e-9


def small(spark, x, groups):
    n, m = x.shape
    counts = spark.createDataFrame([(i, g, float(x[i, g])) for i in range(n) for g in range(m) if x[i, g]], "cell bigint, gene bigint, value double")
    return CellData(counts, spark.createDataFrame(list(enumerate(groups)), "cell bigint, cluster string"), spark.createDataFrame([(g, "ab"[g % 2]) for g in range(m)], "gene bigint, gset string"))


def test_filters_keep_obs_and_var_in_step(spark):
    x = np.array([[1, 2, 0, 0], [0, 0, 0, 0], [5, 0, 1, 0]], float)
    d = small(spark, x, "aab")
    kept = cells.filter_cells(d, min_genes=1)
    assert sorted(r.cell for r in kept.obs.collect()) == [0, 2] and kept.counts.count() == 4
    assert sorted(r.cell for r in cells.filter_cells(d, max_counts=3).obs.collect()) == [0, 1]
    genes = cells.filter_genes(d, min_cells=2)
    assert [r.gene for r in genes.var.collect()] == [0] and genes.counts.count() == 2
    assert cells.subsample(d, fraction=0.1).count() == 1 and cells.subsample_balanced(d, "cluster", fraction=0.5).count() == 2
    with pytest.raises(ValueError):
        cells.subsample(d)


def test_rank_sums_of_a_group_without_counts(spark):
    x = np.array([[0, 0], [0, 0], [3, 1], [3, 0], [1, 2]], float)
    rows = {(r.cluster, r.gene): r for r in markers.rank_sums(small(spark, x, "aabbb"), "cluster").collect()}
    assert len(rows) == 4 and rows["a", 0].nnz_in == 0 and rows["a", 0].u == 0 and rows["b", 0].u == 6


def test_scores_without_counts_and_bad_methods(spark):
    d = small(spark, np.array([[1.0, 2.0], [0.0, 0.0]]), "ab")
    assert {r.cell: r.score for r in scores.ambient_score(d).collect()}[1] == 0
    assert {r.cell: r.top_lineage for r in scores.bipotent(d, "gset").collect()} == {0: "b", 1: "a"}
    for f in (lambda: scores.activity(d, "gset", "x"), lambda: scores.network(d.counts, 2), lambda: graphs.hotspots(None, None, "x"), lambda: markers.composition(d.obs, "a", "b", "c", "x")):
        with pytest.raises(ValueError):
            f()


def test_fisher_matches_enumeration(spark):
    obs = spark.createDataFrame([("g", "F")] * 7 + [("g", "O")] * 2 + [("h", "F")] * 3 + [("h", "O")] * 9, "cluster string, condition string")
    got = {r.cluster: r for r in scores.differential_abundance(obs, "cluster", "condition").collect()}
    p = lambda i: math.comb(10, i) * math.comb(11, 9 - i) / math.comb(21, 9)
    assert abs(got["g"].pvalue - sum(p(i) for i in range(10) if p(i) <= p(7) * (1 + 1e-7))) < 1e-9 and got["g"].log2fc > 0 > got["h"].log2fc


def test_sequences_and_names(spark):
    df = spark.createDataFrame([("ACGTNA",), ("ACGTTA",), ("NNGTTA",), ("AAAAAC",), ("GACGTA",)], "s string")
    rows = df.select("s", tags.fill_unknown(F.col("s")).alias("f"), tags.reverse_complement(F.col("s")).alias("r"), tags.unmatched_class(F.col("s"), ["ACGTAC"]).alias("c"), tags.window_before(F.col("s"), "GT", 2).alias("w"), tags.window_at(F.col("s"), 2, 4).alias("o")).collect()
    assert [r.f for r in rows] == [["ACGTAA", "ACGTCA", "ACGTGA", "ACGTTA"], None, None, None, None]
    assert rows[1].r == "TAACGT" and [r.c for r in rows] == ["other", "other", "other", "low_complexity", "shifted"]
    assert [r.w for r in rows] == ["AC", "AC", "NN", None, "AC"] and rows[0].o == "GTNA"
    codes = spark.range(0, 64).select(F.col("id"), tags.decode_bases(F.col("id"), 3).alias("b")).collect()
    assert [r.b for r in codes] == [a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT"]


def test_files_of_persons_are_restricted(spark):
    paths = [("private/x", True), ("samples/GSM1/donor/donor_assignments.tsv", False), ("samples/GSM1/mt/other.tsv", True), ("samples/notes/snp_x", False), ("a/b.bcf", True), ("counts.mtx", False), ("donor\\x", True)]
    got = spark.createDataFrame(paths, "p string, want boolean").select("want", catalog.restricted_path(F.col("p")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_equal_and_single_rows_of_receptors(spark):
    rows = [("x", "TRA", "C", "N", "V", "J", 5, True, True)] * 3 + [("y", "TRB", "C", "N", "V", "J", 1, False, True)]
    c = spark.createDataFrame(rows, "barcode string, chain string, cdr3 string, cdr3_nt string, v_gene string, j_gene string, umis bigint, kept boolean, productive boolean")
    r = receptors.cell_chains(c).collect()
    assert [(x.barcode, x.excess_chains, x.receptor, x.paired) for x in r] == [("x", 1, "TCR", False)]
    assert [x.clonotype_size for x in receptors.t_clonotypes(c).collect()] == [1]


def test_pairs_within_a_radius_over_grid_cells(spark):
    rng = np.random.default_rng(2)
    xy = rng.normal(size=(60, 2))
    got = {(r.cell, r.neighbour) for r in graphs.within_radius(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "cell bigint, x double, y double"), 0.3).collect()}
    assert got == {(i, j) for i in range(60) for j in range(60) if i != j and np.linalg.norm(xy[i] - xy[j]) <= 0.3}
    assert vectors is not None


def test_equal_values_share_their_rank(spark):
    c = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (1, 3, 2.0), (2, 1, 1.0)], "cell bigint, gene bigint, value double")
    got = {(r.cell, r.gene): r.s for r in alignments.rank_signal(c, 3).collect()}
    assert np.allclose([got[1, 1], got[1, 2], got[1, 3], got[2, 1]], [1 - 0.5 / 3, 1 - 0.5 / 3, 1 / 3, 1])
    assert len(alignments.rank_signal(c, 2).collect()) == 3
    z = alignments.null_zscores(spark.createDataFrame([(0.5, 0.4, 0.0), (0.5, 0.0, 0.0)], "auc double, null_mean double, null_sd double")).collect()
    assert [round(r.z, 6) for r in z] == [2.5, 250.0]


def test_depth_curves_and_duplicates(spark):
    m = spark.createDataFrame([(1, "a", 10, 10), (2, "a", 5, 20), (2, "b", 5, 0)], "cell bigint, feature string, molecules bigint, reads bigint")
    got = {r.cell: r for r in alignments.read_stats(m).collect()}
    assert (got[1].dup_reads, got[1].est_complexity) == (0, 10) and (got[2].dup_reads, got[2].est_complexity) == (10, 20)
    curve = {r.fraction: r for r in alignments.saturation_curve(m.where("cell = 1")).collect()}
    assert abs(curve[1.0].mean_umis - 10 * (1 - math.exp(-1))) < 1e-9 and curve[0.5].sampled_reads == 5
    with pytest.raises(ValueError):
        alignments.bin_counts(m, m, 0)
