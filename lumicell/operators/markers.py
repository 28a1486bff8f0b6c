"""Variable genes, marker tests, gene sets, correlation, composition."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import adjust_bh, hypergeometric_tail, normal_tail, ratio, variance
from ..model import CellData
from .cells import gene_moments, sample_order


def hvg_seurat(d: CellData, n_top: int = 2000, n_bins: int = 20) -> DataFrame:
    """Dispersion of log-normalised values, standardised within bins of equal width of log mean."""
    m = gene_moments(d).where("mean > 0").select("gene", "mean", F.log(ratio(F.col("var"), F.col("mean"))).alias("disp"), F.log1p("mean").alias("lm"))
    lim = m.agg(F.min("lm").alias("lo"), F.max("lm").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / n_bins
    b = m.join(F.broadcast(lim)).withColumn("bin", F.when(width > 0, F.least(F.lit(n_bins - 1), F.floor((F.col("lm") - F.col("lo")) / width))).otherwise(0).cast("int"))
    bins = b.groupBy("bin").agg(F.avg("disp").alias("bm"), F.stddev_pop("disp").alias("bs"))
    z = F.when(F.col("bs") > 1e-12, (F.col("disp") - F.col("bm")) / F.col("bs")).otherwise(0.0)
    return b.join(F.broadcast(bins), "bin").select("gene", "bin", F.round(z, 6).alias("norm_disp")).orderBy(F.desc_nulls_last("norm_disp"), "gene").limit(n_top)


def hvg_cell_ranger(d: CellData, n_top: int = 2000, n_bins: int = 20) -> DataFrame:
    """log10 dispersion against the median and deviation of its bin of mean ranks."""
    m = gene_moments(d).where("mean > 0 and var1 > 0").select("gene", "mean", F.log10(F.col("var1") / F.col("mean")).alias("disp"))
    b = m.withColumn("bin", F.ntile(n_bins).over(Window.orderBy("mean", "gene")) - 1)
    med = b.groupBy("bin").agg(F.median("disp").alias("med"), F.count(F.lit(1)).alias("n"))
    dev = b.join(F.broadcast(med), "bin").withColumn("dev", F.abs(F.col("disp") - F.col("med")))
    mad = dev.groupBy("bin").agg(F.median("dev").alias("mad"))
    z = F.when((F.col("n") >= 2) & (F.col("mad") > 1e-12), (F.col("disp") - F.col("med")) / F.col("mad")).otherwise(0.0)
    return dev.join(F.broadcast(mad), "bin").select("gene", "bin", F.round(z, 6).alias("norm_disp")).orderBy(F.desc("norm_disp"), "gene").limit(n_top)


def rank_sums(d: CellData, groupby: str) -> DataFrame:
    """Rank-sum statistics of each gene and group against the rest.

    Average ranks over all cells of a gene, the unstored ones being ties at
    zero: a stored value's rank is shifted by their number, and each cell of a
    group without the gene adds their mean rank.
    """
    x = d.labelled(groupby).where("value > 0")
    # ranks from counts of equal values: what is dealt by gene and sorted is its values, not its cells, and all that follows stays there
    levels = x.groupBy("gene", "value", groupby).agg(F.count(F.lit(1)).alias("c")).repartition("gene")
    upto = Window.partitionBy("gene").orderBy("value")  # with equal values
    ties = F.sum("c").over(Window.partitionBy("gene", "value"))
    levels = levels.withColumn("ties", ties).withColumn("below", F.sum("c").over(upto) - F.col("ties"))
    sums = levels.groupBy("gene", groupby).agg(F.sum(F.col("c") * (F.col("below") + (F.col("ties") + 1) / 2)).alias("r"), F.sum("c").alias("k"), F.sum(F.col("c") * F.col("value")).alias("s1"))
    held = F.map_from_entries(F.collect_list(F.struct(groupby, F.struct("r", "k", "s1"))))  # groups are few
    genes = sums.groupBy("gene").agg(held.alias("_own"), F.sum("k").alias("nnz"), F.sum("s1").alias("all_s1"))
    groups = d.group_sizes(groupby).where(F.col(groupby).isNotNull())
    listed = groups.agg(F.collect_list(F.struct(groupby, F.col("n_cells").alias("n_in"))).alias("_groups")).join(F.broadcast(d.n_cells().withColumnRenamed("n_cells", "n")))  # one row
    y = genes.join(F.broadcast(listed)).select("gene", "nnz", "all_s1", "n", "_own", F.inline("_groups"))
    own = F.element_at("_own", F.col(groupby))
    y = y.withColumns({"r": F.coalesce(own["r"], F.lit(0.0)), "k": F.coalesce(own["k"], F.lit(0)), "s1": F.coalesce(own["s1"], F.lit(0.0))})
    z = (F.col("n") - F.col("nnz")).cast("double")  # products of numbers of cells don't fit a bigint: n_in * n_out * n goes beyond it at some millions
    rank_sum = F.col("r") + F.col("k") * z + (F.col("n_in") - F.col("k")) * (z + 1) / 2
    n_out = F.col("n") - F.col("n_in")
    size_in = F.col("n_in").cast("double")
    u = rank_sum - size_in * (size_in + 1) / 2
    sd = F.sqrt(size_in * n_out * (F.col("n") + 1) / 12)
    mean_in, mean_out = ratio(F.col("s1"), F.col("n_in")), ratio(F.col("all_s1") - F.col("s1"), n_out)
    return y.select(
        groupby, "gene", "n_in", n_out.alias("n_out"), F.col("k").alias("nnz_in"), (F.col("nnz") - F.col("k")).alias("nnz_out"), u.alias("u"),
        ratio(u - size_in * n_out / 2, sd).alias("z"), mean_in.alias("mean_in"), mean_out.alias("mean_out"), F.log2((mean_in + 1e-9) / (mean_out + 1e-9)).alias("log2fc"),
    )


def rank_genes_groups(d: CellData, groupby: str, n_genes: int = 100) -> DataFrame:
    """Genes of each group by rank-sum z, with p and adjusted p."""
    x = rank_sums(d, groupby).withColumn("pval", normal_tail(F.col("z"))).where("z is not null").withColumn("zr", F.round("z", 6))
    x = adjust_bh(x, "pval", "padj", [groupby], ["gene"])
    w = Window.partitionBy(groupby).orderBy(F.desc("zr"), "gene")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_genes).select(groupby, "rank", "gene", "zr", "log2fc", "pval", "padj")


def _group_moments(d: CellData, key: str) -> DataFrame:
    """Moments of each gene with counts in each group, in groups without the gene too."""
    counted = d.counts.select("gene").distinct()
    return gene_moments(replace(d, var=counted), (key,), every=True)


def welch(d: CellData, groupby: str) -> DataFrame:
    """Welch t of each gene and group against the rest, from moments."""
    g = _group_moments(d, groupby).select(groupby, "gene", "n_cells", "s1", "s2", "mean", "var1")
    t = d.counts.groupBy("gene").agg(F.sum("value").alias("t1"), F.sum(F.col("value") * F.col("value")).alias("t2")).join(F.broadcast(d.n_cells().withColumnRenamed("n_cells", "n")))
    x = g.join(t, "gene")
    no = F.col("n") - F.col("n_cells")
    o1, o2 = F.col("t1") - F.col("s1"), F.col("t2") - F.col("s2")
    vo = variance(o1, o2, no, 1)
    se = F.col("var1") / F.col("n_cells") + vo / no
    return x.select(groupby, "gene", ratio(F.col("mean") - o1 / no, F.sqrt(se)).alias("t"), F.col("mean").alias("mean_in"), (o1 / no).alias("mean_out"))


def find_all_markers(d: CellData, groupby: str, min_fold_change: float = 1.5, min_pct: float = 0.1, max_pvalue: float = 0.05) -> DataFrame:
    """Candidates by detection and fold change, tested by rank sums, adjusted among a group's candidates, and scored:
    -log10(fdr) times log2 fold change times detection."""
    if min_fold_change < 1:
        raise ValueError("min_fold_change must be 1 at least")
    x = rank_sums(d, groupby).withColumn("pct_in", F.col("nnz_in") / F.col("n_in")).withColumn("pct_out", F.col("nnz_out") / F.col("n_out"))
    x = x.where((F.col("pct_in") >= min_pct) & (F.col("log2fc") >= F.log2(F.lit(float(min_fold_change))))).withColumn("pvalue", normal_tail(F.col("z")))
    x = adjust_bh(x, "pvalue", "fdr", [groupby], ["gene"]).where(F.col("fdr") <= max_pvalue)
    return x.select(groupby, "gene", "pct_in", "pct_out", "log2fc", "pvalue", "fdr", (-F.log10(F.col("fdr") + 1e-300) * F.col("log2fc") * F.col("pct_in")).alias("score"))


def marker_specificity(d: CellData, groupby: str) -> DataFrame:
    """AUROC of each gene and group, and its mean over the largest mean of other groups."""
    x = rank_sums(d, groupby)
    order = Window.partitionBy("gene").orderBy(F.desc("mean_in"), groupby)
    x = x.withColumn("_k", F.row_number().over(order))
    top = x.groupBy("gene").agg(F.max(F.when(F.col("_k") == 1, F.col("mean_in"))).alias("m1"), F.max(F.when(F.col("_k") == 2, F.col("mean_in"))).alias("m2"))
    x = x.join(top, "gene")
    other = F.when(F.col("_k") == 1, F.col("m2")).otherwise(F.col("m1"))
    return x.select(groupby, "gene", ratio(F.col("u"), F.col("n_in") * F.col("n_out")).alias("auroc"), ratio(F.col("mean_in"), other).alias("specificity"))


def dotplot(d: CellData, groupby: str, gene_key: str) -> DataFrame:
    """Mean and detected share of each gene set per group, zeros counted."""
    sizes = d.var.groupBy(gene_key).agg(F.count(F.lit(1)).alias("n_genes"))
    x = d.labelled(groupby).join(d.var.select("gene", gene_key), "gene")
    s = x.groupBy(groupby, gene_key).agg(F.sum("value").alias("s"), F.count_if(F.col("value") > 0).alias("k"))
    n = F.col("n_cells") * F.col("n_genes")
    return s.join(F.broadcast(d.group_sizes(groupby)), groupby).join(F.broadcast(sizes), gene_key).select(groupby, gene_key, (F.col("s") / n).alias("mean"), (F.col("k") / n).alias("fraction"))


def control_genes(d: CellData, gene_key: str, ctrl_size: int = 50, n_bins: int = 25, seed: int = 0) -> DataFrame:
    """Control genes of each set: for each of its genes up to `ctrl_size` others of the same bin of mean expression.

    Each set has its own hash order of the other genes of a bin, as a ring, from
    which a gene of the set takes a run that starts at a hashed place: a random
    sample for each gene, and work in proportion to sets times genes.
    """
    n = d.var.agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.round("mean", 9), "gene")
    g = gene_moments(d, every=True).select("gene", "mean").withColumn("_i", F.row_number().over(order) - 1).join(F.broadcast(n))
    bins = F.least(F.lit(n_bins), F.col("n"))
    width = F.greatest(F.lit(1), F.floor(F.col("n") / bins))
    g = g.select("gene", F.least(bins - 1, F.floor(F.col("_i") / width)).alias("bin")).join(d.var.select("gene", F.col(gene_key).alias("_own")), "gene")
    sets = d.var.select(gene_key).where(F.col(gene_key).isNotNull()).distinct()
    ring = Window.partitionBy(gene_key, "bin")
    others = g.join(F.broadcast(sets)).where(~F.col("_own").eqNullSafe(F.col(gene_key)))
    others = others.withColumn("_at", F.row_number().over(ring.orderBy(sample_order(seed, gene_key, "gene"), "gene")) - 1).select(gene_key, "bin", "gene", "_at", F.count(F.lit(1)).over(ring).alias("_m"))
    sizes = others.groupBy(gene_key, "bin").agg(F.max("_m").alias("_m"))
    own = g.where("_own is not null").withColumnRenamed("_own", gene_key).join(sizes, [gene_key, "bin"])
    run = F.explode(F.sequence(F.lit(0), F.least(F.lit(ctrl_size), F.col("_m")).cast("int") - 1))
    place = F.conv(F.substring(sample_order(seed, "gene"), 1, 8), 16, 10).cast("bigint")
    taken = own.select(gene_key, "bin", "_m", place.alias("_h"), run.alias("_j")).select(gene_key, "bin", F.pmod(F.pmod("_h", "_m") + F.col("_j"), "_m").cast("int").alias("_at")).distinct()
    return taken.join(others.drop("_m"), [gene_key, "bin", "_at"]).select(gene_key, "gene")


def gene_set_score(d: CellData, gene_key: str, ctrl_size: int = 50, n_bins: int = 25, seed: int = 0) -> DataFrame:
    """Mean of each set minus the mean of its control genes, for every cell of obs and every set."""
    own = d.var.where(F.col(gene_key).isNotNull()).select(gene_key, "gene")
    of = Window.partitionBy(gene_key)
    w = own.withColumn("w", 1 / F.count(F.lit(1)).over(of)).unionByName(control_genes(d, gene_key, ctrl_size, n_bins, seed).withColumn("w", -1 / F.count(F.lit(1)).over(of)))
    sets = own.agg(F.sort_array(F.collect_set(gene_key)).alias("_sets"))
    # one row for a gene: its weight in each set
    w = w.groupBy("gene").agg(F.map_from_entries(F.collect_list(F.struct(gene_key, "w"))).alias("_w")).join(F.broadcast(sets))
    w = w.select("gene", F.transform("_sets", lambda k: F.coalesce(F.element_at("_w", k), F.lit(0.0))).alias("_w"))
    x = d.obs.select("cell").join(d.counts, "cell", "left").join(F.broadcast(w), "gene", "left").join(F.broadcast(sets))
    x = x.select("cell", "value", "_w", F.posexplode("_sets").alias("_i", gene_key))
    return x.groupBy("cell", gene_key).agg(F.sum(F.coalesce(F.col("value") * F.get("_w", F.col("_i")), F.lit(0.0))).alias("score"))


def phase_calls(scores: DataFrame, s: str, g2m: str, gene_key: str) -> DataFrame:
    """Phase of each cell from its S and G2M scores; both at or below zero, or equal: G1. A set without genes in var scores 0."""
    x = scores.where(F.col(gene_key).isin(s, g2m)).groupBy("cell").agg(F.coalesce(F.max(F.when(F.col(gene_key) == s, F.col("score"))), F.lit(0.0)).alias("s_score"), F.coalesce(F.max(F.when(F.col(gene_key) == g2m, F.col("score"))), F.lit(0.0)).alias("g2m_score"))
    phase = F.when((F.col("s_score") > F.col("g2m_score")) & (F.col("s_score") > 0), "S").when((F.col("g2m_score") > F.col("s_score")) & (F.col("g2m_score") > 0), "G2M").otherwise("G1")
    return x.withColumn("phase", phase)


def variance_partition(d: CellData, key: str) -> DataFrame:
    """Share of each gene's variance between the groups of a key."""
    g = gene_moments(d, (key,)).groupBy("gene").agg(F.sum(F.col("s1") * F.col("s1") / F.col("n_cells")).alias("b"))
    t = gene_moments(d).join(g, "gene")
    mean2 = F.col("s1") * F.col("s1") / F.col("n_cells")
    return t.select("gene", ratio(F.col("b") - mean2, F.col("s2") - mean2).alias("eta2"))


def gene_correlation(d: CellData, genes: list | None = None, n_top: int = 50) -> DataFrame:
    """Pearson correlation over all cells of every pair of the listed genes, else of the n_top genes of largest variance."""
    m = gene_moments(d, every=True).select("gene", "mean", "var", "n_cells")
    m = m.where(F.col("gene").isin(genes)) if genes is not None else m.orderBy(F.desc(F.round("var", 9)), "gene").limit(n_top)
    x = d.counts.join(d.obs.select("cell"), "cell", "left_semi").join(F.broadcast(m.select("gene")), "gene", "left_semi")
    y = x.select("cell", F.col("gene").alias("g2"), F.col("value").alias("v2"))
    met = x.join(y, "cell").where("gene < g2").groupBy("gene", "g2").agg(F.sum(F.col("value") * F.col("v2")).alias("sxy"))
    # pairs that never meet in a cell have a product of 0, not no row
    p = m.join(F.broadcast(m.select(F.col("gene").alias("g2"), F.col("mean").alias("m2"), F.col("var").alias("s2")))).where("gene < g2")
    p = p.join(met, ["gene", "g2"], "left").fillna(0.0, ["sxy"])
    return p.select("gene", "g2", ratio(F.col("sxy") / F.col("n_cells") - F.col("mean") * F.col("m2"), F.sqrt(F.col("var") * F.col("s2"))).alias("r"))


def perturbation_signature(d: CellData, key: str, reference: str) -> DataFrame:
    """Mean shift and log2 fold change of each gene with counts and each condition against the reference."""
    m = _group_moments(d, key).select(key, "gene", "mean")
    r = m.where(F.col(key) == reference).select("gene", F.col("mean").alias("rm"))
    x = m.where(F.col(key) != reference).join(r, "gene", "left").fillna(0.0, ["rm"])
    return x.select(key, "gene", (F.col("mean") - F.col("rm")).alias("shift"), F.log2((F.col("mean") + 1e-9) / (F.col("rm") + 1e-9)).alias("log2fc"))


def set_enrichment(d: CellData, groupby: str, gene_key: str, n_top: int = 200) -> DataFrame:
    """Fisher's one-sided test of each group's top genes against each set, adjusted over all pairs.

    The odds ratio is that of the table, infinite where a cell off its diagonal is 0 and the overlap isn't.
    """
    top = rank_genes_groups(d, groupby, n_top).select(groupby, "gene").join(d.var.select("gene", gene_key), "gene")
    a = top.groupBy(groupby, gene_key).agg(F.count(F.lit(1)).alias("a"))
    k = d.var.where(F.col(gene_key).isNotNull()).groupBy(gene_key).agg(F.count(F.lit(1)).alias("k"))
    sets = k.agg(F.collect_list(F.struct(gene_key, "k")).alias("_sets"), F.lit(1).alias("_one"))
    n = d.var.agg(F.count(F.lit(1)).alias("n"))
    m = top.groupBy(groupby).agg(F.count(F.lit(1)).alias("m"))
    every = m.join(F.broadcast(n)).join(F.broadcast(sets)).select(groupby, "m", "n", F.inline("_sets"))  # groups and sets are few
    x = every.join(a, [groupby, gene_key], "left").fillna(0, ["a"])
    b, c = F.col("m") - F.col("a"), F.col("k") - F.col("a")
    dd = F.col("n") - F.col("m") - F.col("k") + F.col("a")
    odds = F.when(b * c > 0, F.col("a") * dd / (b * c)).otherwise(F.when(F.col("a") > 0, F.lit(float("inf"))).otherwise(0.0))
    x = x.select(groupby, gene_key, F.col("a").alias("overlap"), odds.alias("odds_ratio"), F.when(F.col("a") == 0, 1.0).otherwise(hypergeometric_tail(*map(F.col, "amkn"))).alias("pvalue"))
    return adjust_bh(x, "pvalue", "fdr", [], [groupby, gene_key])


def marker_overlap(markers: DataFrame, reference: DataFrame, groupby: str, set_key: str) -> DataFrame:
    """Shared genes and Jaccard index of marker lists and reference sets."""
    a = markers.groupBy(groupby).agg(F.countDistinct("gene").alias("na"))
    b = reference.groupBy(set_key).agg(F.countDistinct("gene").alias("nb"))
    x = markers.select(groupby, "gene").distinct().join(reference.select(set_key, "gene").distinct(), "gene").groupBy(groupby, set_key).agg(F.count(F.lit(1)).alias("shared"))
    return x.join(F.broadcast(a), groupby).join(F.broadcast(b), set_key).select(groupby, set_key, "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def proportions(obs: DataFrame, groupby: str, condition: str) -> DataFrame:
    x = obs.groupBy(condition, groupby).agg(F.count(F.lit(1)).alias("n"))
    return x.withColumn("proportion", F.col("n") / F.sum("n").over(Window.partitionBy(condition)))


def composition(obs: DataFrame, groupby: str, condition: str, reference: str, method: str = "dirichlet") -> DataFrame:
    """Proportion, fold, two-proportion z, p and adjusted p of each condition and group against the reference.

    p: "dirichlet" is the G test of the group against all others with Yates'
    correction, "prop_test" the two-proportion z test; 1 where a margin is 0.
    """
    if method not in ("dirichlet", "prop_test"):
        raise ValueError(f"method must be dirichlet or prop_test, not {method!r}")
    sizes = obs.groupBy(condition).agg(F.count(F.lit(1)).alias("n"))
    x = obs.groupBy(condition, groupby).agg(F.count(F.lit(1)).alias("k"))
    # every group in every condition: one that a condition lacks has 0 cells there
    x = sizes.join(F.broadcast(obs.select(groupby).distinct())).join(x, [condition, groupby], "left").fillna(0, ["k"])
    r = x.where(F.col(condition) == reference).select(groupby, F.col("k").alias("rk"), F.col("n").alias("rn"))
    y = x.where(F.col(condition) != reference).join(F.broadcast(r), groupby)
    k, n, rk, rn = (F.col(c) for c in ("k", "n", "rk", "rn"))
    pool = (k + rk) / (n + rn)
    z = ratio(k / n - rk / rn, F.sqrt(pool * (1 - pool) * (1 / n + 1 / rn)))
    if method == "dirichlet":
        off = k - n * pool  # the same in all four cells, but for its sign
        held = F.signum(off) * F.greatest(F.abs(off) - 0.5, F.lit(0.0))
        cells = [(n * pool, 1), (n * (1 - pool), -1), (rn * pool, -1), (rn * (1 - pool), 1)]
        term = lambda e, sign: F.when(e + sign * held > 0, (e + sign * held) * F.log((e + sign * held) / e)).otherwise(0.0)
        g = 2 * sum((term(e, s) for e, s in cells), F.lit(0.0))
        p = normal_tail(F.sqrt(F.greatest(g, F.lit(0.0))))
    else:
        p = normal_tail(z)
    p = F.when((pool > 0) & (pool < 1), p).otherwise(1.0)
    y = y.select(condition, groupby, (k / n).alias("proportion"), ratio(k / n, rk / rn).alias("fold"), z.alias("z"), p.alias("pvalue"))
    return adjust_bh(y, "pvalue", "fdr", [], [condition, groupby])


def communication(d: CellData, groupby: str, pairs: DataFrame) -> DataFrame:
    """Mean of the ligand in the sender times mean of the receptor in the receiver, for pairs (ligand, receptor)."""
    m = gene_moments(d, (groupby,)).select(groupby, "gene", "mean")
    s = m.select(F.col(groupby).alias("sender"), F.col("gene").alias("ligand"), F.col("mean").alias("lm"))
    r = m.select(F.col(groupby).alias("receiver"), F.col("gene").alias("receptor"), F.col("mean").alias("rm"))
    return pairs.join(s, "ligand").join(r, "receptor").select("ligand", "receptor", "sender", "receiver", (F.col("lm") * F.col("rm")).alias("score"))
