"""Scores of cells and groups: ambient signal, lineages, gene sets, marker sets, profiles of two data sets."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import adjust_bh, log_choose, ratio
from ..model import CellData
from . import cells
from .cells import gene_moments


def ambient_score(d: CellData, n_top: int = 100) -> DataFrame:
    """Cosine of each cell of obs with the profile of the genes most like ambient: high dropout, low variance.

    The profile holds the means of the n_top genes of largest dropout minus
    variance over the largest variance; a cell without counts scores 0.
    """
    m = gene_moments(d, every=True)
    m = m.join(F.broadcast(m.agg(F.max("var").alias("most")))).withColumn("share", F.when(F.col("most") > 0, F.col("var") / F.col("most")).otherwise(F.col("var")))
    rank = F.round(1 - F.col("nnz") / F.col("n_cells") - F.col("share"), 9)
    profile = m.orderBy(rank.desc(), "gene").limit(n_top).select("gene", F.col("mean").alias("_p"))
    size = profile.agg(F.sqrt(F.sum(F.col("_p") * F.col("_p"))).alias("_size"))
    own = d.counts.join(F.broadcast(profile), "gene", "left").groupBy("cell").agg(F.sum(F.col("value") * F.coalesce("_p", F.lit(0.0))).alias("_dot"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_own"))
    x = d.obs.select("cell").join(own, "cell", "left").join(F.broadcast(size))
    score = F.coalesce(ratio(F.col("_dot"), F.col("_own") * F.col("_size")), F.lit(0.0))
    return x.select("cell", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))


def bipotent(d: CellData, lineage_key: str, threshold: float = 0.3, method: str = "entropy") -> DataFrame:
    """Whether a cell of obs lies between lineages, which are the gene sets of a key of var.

    Each lineage's mean over its genes, as shares of the cell's sum; the score
    is their entropy over that of equal shares, or the second over the first
    share.  The top lineage is the first of the largest, in order of name.
    """
    sizes = d.var.where(F.col(lineage_key).isNotNull()).groupBy(lineage_key).agg(F.count(F.lit(1)).alias("n"))
    lineages = sizes.agg(F.count(F.lit(1)).alias("_l"), F.min(lineage_key).alias("_first"))
    x = d.counts.join(d.var.select("gene", lineage_key), "gene").groupBy("cell", lineage_key).agg(F.sum("value").alias("s"))
    x = x.join(F.broadcast(sizes), lineage_key).withColumn("m", F.col("s") / F.col("n"))
    p = F.col("m") / F.sum("m").over(Window.partitionBy("cell"))
    x = x.where("m > 0").withColumn("p", p).groupBy("cell").agg(
        F.sum(-F.col("p") * F.log("p")).alias("entropy"), F.sort_array(F.collect_list("p"), False).alias("ps"), F.max(F.struct(F.round("m", 9).alias("m"))).alias("top"), F.collect_list(F.struct(F.round("m", 9).alias("m"), F.col(lineage_key).alias("k"))).alias("all")
    )
    best = F.array_min(F.transform(F.filter("all", lambda s: s["m"] == F.col("top.m")), lambda s: s["k"]))
    if method == "entropy":
        score = F.when(F.col("_l") > 1, F.col("entropy") / F.log("_l"))
    else:
        score = F.coalesce(F.get("ps", F.lit(1)), F.lit(0.0)) / F.get("ps", F.lit(0))
    x = d.obs.select("cell").join(x.withColumn("best", best), "cell", "left").join(F.broadcast(lineages))
    score = F.coalesce(score, F.lit(0.0))
    return x.select("cell", score.alias("score"), F.coalesce("best", "_first").alias("top_lineage"), (score >= threshold).alias("is_bipotent"))


def activity(d: CellData, gene_key: str, method: str = "mean", scale: bool = True) -> DataFrame:
    """Activity of each gene set in each cell of obs: the mean of its genes, weighted by their variance, or of their z-scores.

    A set's score is linear in a cell's values, so that each gene has a weight
    and each set a constant; scale divides by the deviation over all cells.
    """
    if method not in ("mean", "weighted", "z-score"):
        raise ValueError(f"method must be mean, weighted or z-score, not {method!r}")
    m = gene_moments(d, every=True).select("gene", "mean", "var").join(d.var.select("gene", gene_key), "gene").where(F.col(gene_key).isNotNull())
    of = Window.partitionBy(gene_key)
    k, total = F.count(F.lit(1)).over(of), F.sum("var").over(of)
    sd = F.when(F.col("var") > 0, F.sqrt("var")).otherwise(1.0)
    weight = {"mean": 1 / k, "weighted": F.when(total > 0, F.col("var") / total).otherwise(1 / k), "z-score": 1 / (k * sd)}[method]
    w = m.select("gene", gene_key, weight.alias("w"), (weight * F.col("mean") if method == "z-score" else F.lit(0.0)).alias("off"))
    sets = w.groupBy(gene_key).agg(F.sum("off").alias("off"))
    own = d.counts.join(w.select("gene", gene_key, "w"), "gene").groupBy("cell", gene_key).agg(F.sum(F.col("value") * F.col("w")).alias("s"))
    listed = sets.agg(F.collect_list(F.struct(gene_key, "off")).alias("_sets"))  # one row: sets are few
    x = d.obs.select("cell").join(F.broadcast(listed)).select("cell", F.inline("_sets")).join(own, ["cell", gene_key], "left").select("cell", gene_key, (F.coalesce("s", F.lit(0.0)) - F.col("off")).alias("score"))
    if not scale:
        return x
    t = x.groupBy(gene_key).agg(F.avg("score").alias("_m"), F.stddev_pop("score").alias("_sd"))
    z = F.when(F.col("_sd") > 1e-12, (F.col("score") - F.col("_m")) / F.col("_sd")).otherwise(F.col("score"))
    return x.join(F.broadcast(t), gene_key).select("cell", gene_key, z.alias("score"))


def annotate(d: CellData, groupby: str, gene_key: str, min_score: float = 0.1) -> DataFrame:
    """Best marker set of each group: mean detection times log1p of the mean fold over all cells; Unknown below min_score.

    Ties go to the set first in order of name.
    """
    whole = gene_moments(d, every=True).select("gene", F.when(F.col("mean") != 0, F.col("mean")).otherwise(1e-10).alias("_all"))
    g = gene_moments(d, (groupby,), every=True).select(groupby, "gene", "mean", (F.col("nnz") / F.col("n_cells")).alias("pct"))
    x = g.join(whole, "gene").join(d.var.select("gene", gene_key).where(F.col(gene_key).isNotNull()), "gene")
    x = x.groupBy(groupby, gene_key).agg((F.avg("pct") * F.log1p(F.avg(F.col("mean") / F.col("_all")))).alias("score")).withColumn("score", F.round("score", 9))
    best = Window.partitionBy(groupby).orderBy(F.desc("score"), gene_key)
    x = x.withColumn("_k", F.row_number().over(best)).where("_k = 1")
    known = (F.col("score") >= min_score) & (F.col("score") > 0)
    return x.select(groupby, F.when(known, F.col(gene_key)).otherwise("Unknown").alias("cell_type"), F.when(known, F.col("score")).otherwise(0.0).alias("score"))


def filter_ranked(ranked: DataFrame, min_fold_change: float = 1.0, max_pval: float = 0.05) -> DataFrame:
    """Ranked genes (gene, zr, log2fc, padj, ...) with the failing ones blanked: gene null and score 0, ranks kept."""
    keep = (F.col("padj") <= max_pval) & (F.abs("log2fc") >= min_fold_change)
    return ranked.withColumn("gene", F.when(keep, F.col("gene"))).withColumn("zr", F.when(keep, F.col("zr")).otherwise(0.0))


def profile_correlation(a: CellData, b: CellData, key_a: str, key_b: str, mapping: DataFrame | None = None) -> DataFrame:
    """Pearson correlation of the mean profiles of a's and b's groups over their shared genes.

    mapping (gene, other) renames a's genes; without it equal genes match.
    Constant profiles correlate with nothing: 0.
    """
    own = a.var.select("gene")
    pairs = own.join(mapping, "gene", "left").select("gene", F.coalesce("other", "gene").alias("other")) if mapping is not None else own.select("gene", F.col("gene").alias("other"))
    pairs = pairs.join(b.var.select(F.col("gene").alias("other")), "other", "left_semi")
    n = pairs.agg(F.count(F.lit(1)).alias("n"))
    x = gene_moments(a, (key_a,)).join(pairs, "gene").select(F.col(key_a).alias("a"), "other", F.col("mean").alias("x"))
    y = gene_moments(b, (key_b,)).join(pairs.select("other"), F.col("gene") == F.col("other")).select(F.col(key_b).alias("b"), "other", F.col("mean").alias("y"))
    sums = lambda df, k, v: df.groupBy(k).agg(F.sum(v).alias(f"s{v}"), F.sum(F.col(v) * F.col(v)).alias(f"q{v}"))
    both = x.join(y, "other").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    groups = sums(y, "b", "y").agg(F.collect_list(F.struct("b", "sy", "qy")).alias("_g"))  # one row: groups are few
    every = sums(x, "a", "x").join(F.broadcast(groups)).select("a", "sx", "qx", F.inline("_g")).join(both, ["a", "b"], "left").join(F.broadcast(n))
    top = F.coalesce("xy", F.lit(0.0)) - F.col("sx") * F.col("sy") / F.col("n")
    down = F.sqrt(F.greatest(F.lit(0.0), F.col("qx") - F.col("sx") * F.col("sx") / F.col("n"))) * F.sqrt(F.greatest(F.lit(0.0), F.col("qy") - F.col("sy") * F.col("sy") / F.col("n")))
    return every.select("a", "b", F.coalesce(ratio(top, down), F.lit(0.0)).alias("r"))


def variance_partition_keys(d: CellData, keys: list[str], n_top: int = 500) -> DataFrame:
    """Share of variance between the groups of each key, and what the keys leave, for the n_top genes of largest variance."""
    m = gene_moments(d, every=True)
    m = m.orderBy(F.desc(F.round("var", 9)), "gene").limit(n_top).select("gene", "s1", "s2", "n_cells", "var")
    few = d.with_counts(d.counts.join(F.broadcast(m.select("gene")), "gene", "left_semi"))
    mean2 = F.col("s1") * F.col("s1") / F.col("n_cells")
    for k in keys:
        g = gene_moments(few, (k,)).groupBy("gene").agg(F.sum(F.col("s1") * F.col("s1") / F.col("n_cells")).alias(f"_b_{k}"))
        m = m.join(g, "gene", "left")
    shares = [F.coalesce(ratio(F.coalesce(f"_b_{k}", F.lit(0.0)) - mean2, F.col("s2") - mean2), F.lit(0.0)) for k in keys]
    return m.select("gene", *[s.alias(f"eta2_{k}") for s, k in zip(shares, keys)], (1 - F.least(F.lit(1.0), sum(shares, F.lit(0.0)))).alias("residual"))


def rank_genes_by_group(d: CellData, groupby: str, method: str = "mean", n_top: int | None = None) -> DataFrame:
    """Genes of each group by a measure over the group's cells, those without counts included."""
    m = gene_moments(d, (groupby,), every=True)
    mean = F.when(F.col("mean") != 0, F.col("mean")).otherwise(1.0)
    by = {"variance": F.col("var"), "mean": F.col("mean"), "dispersion": F.col("var") / mean, "dropout": 1 - F.col("nnz") / F.col("n_cells"), "cv": F.sqrt("var") / mean}[method]
    w = Window.partitionBy(groupby).orderBy(F.desc("score"), "gene")
    ranked = m.select(groupby, "gene", F.round(by, 9).alias("score")).withColumn("rank", F.row_number().over(w))
    return ranked if n_top is None else ranked.where(F.col("rank") <= n_top)


def network(correlations: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Edges of a correlation table (gene, g2, r) with |r| at or over the threshold."""
    if not 0 <= threshold <= 1:
        raise ValueError(f"threshold must be between 0 and 1, not {threshold}")
    return correlations.where(F.abs("r") >= threshold)


def recipe_zheng17(d: CellData, variable, n_top: int = 1000) -> CellData:
    """Genes found at all, cells scaled to the median size, the most variable genes by `variable` (a function of data and n), log1p."""
    x = cells.normalize(cells.filter_genes(d, min_cells=1), None, log=False)
    top = variable(x, n_top).select("gene")
    x = replace(x, counts=x.counts.join(F.broadcast(top), "gene", "left_semi"), var=x.var.join(F.broadcast(top), "gene", "left_semi"))
    return cells.transform(x, "log1p")


def recipe_seurat(d: CellData, variable, min_genes: int = 200, min_cells: int = 3, n_top: int = 2000, target_sum: float = 1e4, max_value: float = 10.0) -> DataFrame:
    """Cells and genes with enough counts, normalised, the most variable genes, z-scores as `scale` gives them."""
    x = cells.normalize(cells.filter_genes(cells.filter_cells(d, min_genes=min_genes), min_cells=min_cells), target_sum)
    top = variable(x, n_top).select("gene")
    x = replace(x, counts=x.counts.join(F.broadcast(top), "gene", "left_semi"), var=x.var.join(F.broadcast(top), "gene", "left_semi"))
    return cells.scale(x, max_value=max_value)


def differential_abundance(obs: DataFrame, groupby: str, condition: str) -> DataFrame:
    """Fisher's two-sided test of each group between two conditions, log2 fold of the first one's share, adjusted p."""
    t = obs.groupBy(condition).agg(F.count(F.lit(1)).alias("n")).agg(F.min(F.struct(condition, "n")).alias("a"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("conditions"))
    x = obs.groupBy(groupby, condition).agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(t))
    x = x.groupBy(groupby).agg(F.sum("c").alias("n_cells"), F.sum(F.when(F.col(condition) == F.col(f"a.{condition}"), F.col("c")).otherwise(0)).alias("k"), F.first("a.n").alias("m"), F.first("n").alias("n"), F.first("conditions").alias("conditions"))
    k, g, m, n = (F.col(c) for c in ("k", "n_cells", "m", "n"))
    at = lambda i: F.exp(log_choose(m, i) + log_choose(n - m, g - i) - log_choose(n, g))
    p = F.aggregate(F.sequence(F.greatest(F.lit(0).cast("bigint"), g + m - n), F.least(g, m)), F.lit(0.0), lambda s, i: s + F.when(at(i) <= at(k) * (1 + 1e-7), at(i)).otherwise(0.0))
    p = F.when(F.col("conditions") == 2, F.least(F.lit(1.0), p))
    fold = F.log2(((k + 1e-10) / (g + 2e-10)) / (m / n + 1e-10))
    return adjust_bh(x.select(groupby, "n_cells", fold.alias("log2fc"), p.alias("pvalue")), "pvalue", "fdr", [], [groupby])
