"""Results are whole: rows that come from zeros alone, all genes, all values."""

import numpy as np
from pyspark.sql import functions as F

from lumicell.model import CellData
from lumicell.operators import cells, markers


def data(spark, x, groups=None, sets=None):
    """Dense array as a data set: cells 0.., genes 0.., only nonzeros stored."""
    n, m = x.shape
    counts = spark.createDataFrame([(i, g, float(x[i, g])) for i in range(n) for g in range(m) if x[i, g]], "cell bigint, gene bigint, value double")
    obs = spark.createDataFrame([(i, groups[i] if groups else "a", float(i % 7), float(i * i % 11)) for i in range(n)], "cell bigint, cluster string, u double, v double")
    return CellData(counts, obs, spark.createDataFrame([(g, sets[g] if sets else "a") for g in range(m)], "gene bigint, gset string"))


def sparse(n, m, seed=0):
    x = np.random.default_rng(seed).poisson(0.4, (n, m)).astype(float)
    x[:, m - 1] = 0  # a gene without counts
    x[0] = 0  # a cell without counts
    return x


def test_scores_of_every_cell_and_set_against_controls_of_the_same_bin(spark):
    x = sparse(12, 20)
    sets = ["abc"[g % 3] for g in range(20)]
    d = data(spark, x, sets=sets)
    got = {(r.cell, r.gset): r.score for r in markers.gene_set_score(d, "gset", ctrl_size=99, n_bins=4).collect()}
    assert len(got) == 12 * 3
    bins = {g: min(i // 5, 3) for i, g in enumerate(sorted(range(20), key=lambda g: (round(x[:, g].mean(), 9), g)))}
    for s in "abc":
        own = [g for g in range(20) if sets[g] == s]
        ctrl = [g for g in range(20) if sets[g] != s and bins[g] in {bins[o] for o in own}]
        want = x[:, own].mean(1) - x[:, ctrl].mean(1)
        assert np.allclose([got[i, s] for i in range(12)], want)
    phases = markers.phase_calls(markers.gene_set_score(d, "gset"), "a", "b", "gset").collect()
    assert len(phases) == 12 and [r.phase for r in phases if r.cell == 0] == ["G1"]


def test_control_sample_has_the_asked_size_and_no_gene_of_the_set(spark):
    x = sparse(12, 20)
    sets = ["s" if g == 3 else "r" for g in range(20)]
    got = [r.gene for r in markers.control_genes(data(spark, x, sets=sets), "gset", ctrl_size=4, n_bins=2).where("gset = 's'").collect()]
    assert len(got) == len(set(got)) == 4 and 3 not in got


def test_correlation_has_every_pair_of_the_genes_of_largest_variance(spark):
    x = sparse(15, 8, 3)
    x[:, 0], x[:, 1] = [1] * 5 + [0] * 10, [0] * 10 + [2] * 5  # never in one cell
    got = {(r.gene, r.g2): r.r for r in markers.gene_correlation(data(spark, x), n_top=6).collect()}
    top = sorted(sorted(range(8), key=lambda g: (-round(x[:, g].var(), 9), g))[:6])
    want = np.corrcoef(x[:, top].T)
    assert {0, 1} <= set(top) and len(got) == 15
    assert all(abs(got[a, b] - want[top.index(a), top.index(b)]) < 1e-9 for a, b in got)


def test_scale_gives_all_genes_and_the_line_of_zeros(spark):
    x = sparse(15, 8, 1)
    rows = cells.scale(data(spark, x), max_value=2.0).collect()
    sd = x.std(0)
    want = np.clip((x - x.mean(0)) / np.where(sd > 0, sd, 1), -2, 2)
    zero = {r.gene: r.z for r in rows if r.cell is None}
    stored = {(r.cell, r.gene): r.z for r in rows if r.cell is not None}
    assert len(zero) == 8 and len(stored) == (x > 0).sum()
    assert np.allclose([[stored.get((i, g), zero[g]) for g in range(8)] for i in range(15)], want)
    chosen = {(r.cell, r.gene): r.z for r in cells.scale(data(spark, x), spark.createDataFrame([(2,), (5,)], "gene bigint"), 2.0).collect()}
    assert len(chosen) == 30 and all(abs(z - want[i, g]) < 1e-9 for (i, g), z in chosen.items())


def test_rank_genes_ranks_all_genes_of_var(spark):
    x = sparse(15, 60, 2)
    d = data(spark, x)
    mean = np.where(x.mean(0) > 0, x.mean(0), 1)
    for method, score in {"variance": x.var(0), "mean": x.mean(0), "dispersion": x.var(0) / mean, "dropout": (x == 0).mean(0), "cv": x.std(0) / mean}.items():
        got = [r.gene for r in cells.rank_genes(d, method).orderBy("rank").collect()]
        assert got == sorted(range(60), key=lambda g: (-round(score[g], 9), g)), method
    assert cells.rank_genes(d, "dropout").where("rank = 1").first().gene == 59
    assert cells.rank_genes(d, n_top=3).count() == 3


def test_variable_genes_are_not_cut_at_50(spark):
    x = sparse(40, 90, 4)
    d = data(spark, x)
    assert markers.hvg_seurat(d).count() == (x.sum(0) > 0).sum() > 50
    assert markers.hvg_cell_ranger(d).count() == (x.var(0) > 0).sum() > 50


def test_regress_out_corrects_values_for_several_covariates(spark):
    x = sparse(40, 6, 5)
    d = data(spark, x)
    obs = np.array([[r.u, r.v] for r in sorted(d.obs.collect())])
    design = np.c_[np.ones(40), obs]
    want = x - obs @ np.linalg.lstsq(design, x, rcond=None)[0][1:]
    rows = cells.regress_out(d, ["u", "v"]).collect()
    assert len(rows) == (x > 0).sum() and all(abs(r.value - want[r.cell, r.gene]) < 1e-9 for r in rows)
    slopes = {r.gene: (r.slope_u, r.slope_v) for r in rows}
    assert all(abs(-np.dot(obs[i], slopes.get(g, (0, 0))) - want[i, g]) < 1e-9 for i in range(40) for g in range(6) if not x[i, g])
    twice = cells.regress_out(d.__class__(d.counts, d.obs.withColumn("w", 2 * F.col("u")), d.var), ["u", "w"]).collect()
    once = {(r.cell, r.gene): r.value for r in cells.regress_out(d, ["u"]).collect()}
    assert all(abs(r.value - once[r.cell, r.gene]) < 1e-9 for r in twice)


def test_groups_without_a_gene_or_cell_type_have_rows(spark):
    x = sparse(12, 4, 6)
    x[:, 0] = [0, 3] * 6  # only in group r
    x[:, 1] = [2, 0] * 6  # only in group t
    groups = ["t", "r"] * 6
    d = data(spark, x, groups)
    t, r = x[0::2], x[1::2]
    shift = {g.gene: g.shift for g in markers.perturbation_signature(d, "cluster", "r").collect()}
    assert set(shift) == {0, 1, 2} and all(abs(shift[g] - (t[:, g].mean() - r[:, g].mean())) < 1e-9 for g in shift)
    w = {(g.cluster, g.gene): g for g in markers.welch(d, "cluster").collect()}
    assert len(w) == 6 and w["t", 0].mean_in == 0 and w["r", 1].mean_in == 0
    se = np.sqrt(t[:, 2].var(ddof=1) / 6 + r[:, 2].var(ddof=1) / 6)
    assert abs(w["t", 2].t - (t[:, 2].mean() - r[:, 2].mean()) / se) < 1e-9
    obs = spark.createDataFrame([("t", "A"), ("t", "B"), ("r", "A"), ("r", "C")], "cluster string, kind string")
    rows = {g.kind: g for g in markers.composition(obs, "kind", "cluster", "r").collect()}
    assert set(rows) == {"A", "B", "C"} and rows["C"].proportion == 0 and rows["C"].fold == 0 and rows["C"].z < 0
    assert rows["B"].proportion == 0.5 and rows["B"].fold is None and rows["B"].z > 0
