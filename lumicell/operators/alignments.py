"""Counts from aligned reads: depth curves, duplicates, alleles, splicing, bins, contigs; rank scores of gene sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio
from ..model import CellData


def read_stats(molecules: DataFrame) -> DataFrame:
    """Reads, molecules, duplicates, their rate and the library size that they let expect, of (cell, feature, molecules, reads)."""
    x = molecules.groupBy("cell").agg(F.sum("reads").alias("total_reads"), F.sum("molecules").alias("unique_umis"))
    n, dup = F.col("total_reads"), F.greatest(F.lit(0), F.col("total_reads") - F.col("unique_umis"))
    size = F.when((dup == 0) | (dup >= n), n).otherwise(F.floor(n * n / (2 * dup)))
    return x.select("cell", "total_reads", "unique_umis", dup.alias("dup_reads"), F.when(n > 0, dup / n).otherwise(0.0).alias("dup_rate"), size.cast("bigint").alias("est_complexity"))


def saturation_curve(molecules: DataFrame, fractions: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9, 1.0)) -> DataFrame:
    """Molecules and genes per cell that fractions of the reads would show, if reads fall on molecules at random."""
    per = Window.partitionBy("cell")
    x = molecules.where("reads > 0 and molecules > 0").withColumns({"n": F.sum("reads").over(per), "u": F.sum("molecules").over(per)})
    x = x.select("cell", "molecules", "n", "u", F.explode(F.array(*[F.lit(f) for f in fractions])).alias("fraction"))
    umis = F.first("u") * (1 - F.exp(-F.first("n") * F.col("fraction") / F.first("u")))
    c = x.groupBy("cell", "fraction").agg(umis.alias("umis"), F.sum(1 - F.exp(-F.col("molecules") * F.col("n") / F.col("u") * F.col("fraction"))).alias("genes"), F.first("n").alias("n"))
    return c.groupBy("fraction").agg(
        F.floor(F.sum("n") * F.col("fraction") + 0.5).cast("bigint").alias("sampled_reads"), F.median("umis").alias("median_umis"), F.median("genes").alias("median_genes"), F.avg("umis").alias("mean_umis"), F.avg("genes").alias("mean_genes")
    )


def allelic_expression(depths: DataFrame, min_depth: int = 10) -> DataFrame:
    """Heterozygous places of (cell, snp, ad, dp): both alleles seen at enough depth, with the alternative's share."""
    x = depths.where((F.col("dp") >= min_depth) & (F.col("ad") >= 1) & (F.col("dp") > F.col("ad")))
    return x.select("cell", "snp", (F.col("dp") - F.col("ad")).alias("ref_count"), F.col("ad").alias("alt_count"), (F.col("ad") / F.col("dp")).alias("allelic_ratio"))


def splice_events(junctions: DataFrame) -> DataFrame:
    """(junction, event, kind): junctions (junction, chrom, start, end) that share their donor or acceptor with another.

    A junction of two events belongs to the first in order of name.
    """
    name = lambda c, tag: F.concat("chrom", F.lit(":"), F.col(c).cast("string"), F.lit(tag))
    both = junctions.select("junction", F.explode(F.array(F.struct(name("start", "-D").alias("event"), F.lit("alt_donor").alias("kind")), F.struct(name("end", "-A").alias("event"), F.lit("alt_acceptor").alias("kind")))).alias("e")).select("junction", "e.*")
    shared = both.groupBy("event").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("event")
    return both.join(shared, "event", "left_semi").groupBy("junction").agg(F.min(F.struct("event", "kind")).alias("e")).select("junction", "e.event", "e.kind")


def percent_spliced_in(counts: DataFrame, events: DataFrame) -> DataFrame:
    """Share of each junction (cell, junction, n) in its event's reads in the cell."""
    x = counts.where("n > 0").join(events.select("junction", "event"), "junction")
    total = F.sum("n").over(Window.partitionBy("cell", "event"))
    return x.select("cell", "junction", "event", (F.col("n") / total).alias("psi"))


def fpkm(counts: DataFrame, lengths: DataFrame) -> DataFrame:
    """Fragments per kilobase and million of (gene, value) with (gene, length); lengths count as 1 at least."""
    total = counts.agg(F.sum("value").alias("t"))
    x = counts.join(lengths, "gene").join(F.broadcast(total))
    return x.select("gene", (F.col("value") * 1e9 / (F.greatest("length", F.lit(1)) * F.col("t"))).alias("fpkm"))


def is_mitochondrial(name: Column, chrom: Column) -> Column:
    return F.coalesce(chrom.isin("chrM", "MT", "chrMT"), F.lit(False)) | F.lower(name).startswith("mt-")


def is_ribosomal(name: Column) -> Column:
    return F.upper(name).rlike("^RP[LS]")


def cell_read_qc(exonic: DataFrame, intronic: DataFrame, genes: DataFrame) -> DataFrame:
    """Molecules, genes, and shares in percent that are mitochondrial, ribosomal and intronic, per cell.

    Counts are (cell, gene, value), genes (gene, name, chrom).
    """
    x = exonic.select("cell", "gene", "value", F.lit(0.0).alias("i")).unionByName(intronic.select("cell", "gene", "value", F.col("value").alias("i")))
    x = x.join(genes.select("gene", is_mitochondrial(F.col("name"), F.col("chrom")).alias("mt"), is_ribosomal(F.col("name")).alias("ribo")), "gene", "left")
    x = x.groupBy("cell", "gene").agg(F.sum("value").alias("v"), F.sum("i").alias("i"), F.first("mt").alias("mt"), F.first("ribo").alias("ribo"))
    t = F.sum("v")
    pct = lambda c: F.coalesce(ratio(100 * F.sum(c), t), F.lit(0.0))
    return x.groupBy("cell").agg(t.alias("total_umis"), F.count_if(F.col("v") > 0).alias("total_genes"), pct(F.when(F.col("mt"), F.col("v")).otherwise(0.0)).alias("mt_pct"), pct(F.when(F.col("ribo"), F.col("v")).otherwise(0.0)).alias("ribo_pct"), pct(F.col("i")).alias("intronic_pct"))


def bin_counts(fragments: DataFrame, sizes: DataFrame, width: int = 500) -> DataFrame:
    """Fragments (cell, chrom, start, end) over each bin of a width that they touch, clipped to the chromosome (chrom, size)."""
    if width <= 0:
        raise ValueError("width must be positive")
    x = fragments.join(F.broadcast(sizes), "chrom").select("cell", "chrom", F.greatest(F.lit(0), F.col("start")).alias("s"), F.least("end", "size").alias("e")).where("s < e")
    bins = F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width))
    return x.select("cell", "chrom", F.explode(bins).alias("bin")).groupBy("cell", "chrom", "bin").agg(F.count(F.lit(1)).alias("n"))


def coverage_noise(bins: DataFrame, n_bins: int) -> DataFrame:
    """Median absolute step of log2 counts between neighbouring bins (cell, bin, n; bins 0 to n_bins - 1), and mean count, zeros included."""
    cells = bins.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_n"), (F.sum("n") / n_bins).alias("coverage"))  # n_bins at most
    v = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(n_bins - 1).cast("bigint")), lambda b: F.log2(F.coalesce(F.element_at("_n", b), F.lit(0)) + 1.0))
    x = cells.select("cell", "coverage", v.alias("v"))
    steps = F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(n_bins - 1)), lambda i: F.abs(F.get("v", i) - F.get("v", i - 1))))
    m = n_bins - 1
    x = x.withColumn("d", steps)
    return x.select("cell", "coverage", ((F.get("d", F.lit((m - 1) // 2)) + F.get("d", F.lit(m // 2))) / 2).alias("mapd"))


def contig_stats(contigs: DataFrame, key: str) -> DataFrame:
    """Contigs, bases, N50, N90 and extremes of each assembly of (key, length); from counts of equal lengths."""
    x = contigs.groupBy(key, "length").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(key).orderBy(F.desc("length"))
    x = x.withColumn("upto", F.sum(F.col("c") * F.col("length")).over(w)).withColumn("all", F.sum(F.col("c") * F.col("length")).over(Window.partitionBy(key)))
    n = lambda share: F.max(F.when(F.col("upto") >= share * F.col("all"), F.col("length")))
    return x.groupBy(key).agg(F.sum("c").alias("contigs"), F.max("all").alias("bases"), n(0.5).alias("n50"), n(0.9).alias("n90"), F.max("length").alias("largest"), F.min("length").alias("smallest"))


def rank_signal(counts: DataFrame, max_rank: int = 1500) -> DataFrame:
    """(cell, gene, s): 1 for a cell's largest value down to 0 at max_rank, equal values sharing their mean rank."""
    cell, level = Window.partitionBy("cell"), Window.partitionBy("cell", "value")
    r = F.rank().over(cell.orderBy(F.desc("value"))) + (F.count(F.lit(1)).over(level) - 1) / 2
    return counts.select("cell", "gene", (1 - (r - 1) / max_rank).alias("s")).where("s > 0")


def rank_set_scores(d: CellData, gene_key: str, max_rank: int = 1500) -> DataFrame:
    """Mean rank signal of each gene set in each cell of obs, over the most that a set of its size can have, 1 at most."""
    sets = d.var.where(F.col(gene_key).isNotNull()).groupBy(gene_key).agg(F.count(F.lit(1)).alias("k"))
    s = rank_signal(d.counts, max_rank).join(d.var.select("gene", gene_key), "gene").groupBy("cell", gene_key).agg(F.sum("s").alias("s"))
    listed = sets.agg(F.collect_list(F.struct(gene_key, "k")).alias("_sets"))  # one row: sets are few
    x = d.obs.select("cell").join(F.broadcast(listed)).select("cell", F.inline("_sets")).join(s, ["cell", gene_key], "left")
    most = 1 - (F.col("k") - 1) / (2 * max_rank)
    return x.select("cell", gene_key, F.least(F.lit(1.0), F.coalesce("s", F.lit(0.0)) / F.col("k") / most).alias("auc"))


def null_zscores(scores: DataFrame, null_mean: str = "null_mean", null_sd: str = "null_sd", floor: float = 0.002) -> DataFrame:
    """Scores against a null's mean and deviation, which counts as a tenth of the mean and `floor` at least."""
    down = F.greatest(F.col(null_sd), F.lit(floor), 0.1 * F.col(null_mean))
    return scores.withColumn("z", (F.col("auc") - F.col(null_mean)) / down)


def abundance_bins(genes: DataFrame, n_bins: int = 50) -> DataFrame:
    """(gene, bin): genes (gene, mean) in order of mean, ties by gene, cut into bins of equal numbers."""
    n = genes.agg(F.count(F.lit(1)).alias("n"))
    order = F.row_number().over(Window.orderBy(F.round("mean", 9), "gene")) - 1
    return genes.withColumn("r", order).join(F.broadcast(n)).select("gene", F.least(F.lit(n_bins - 1), F.floor(F.col("r") * n_bins / F.col("n"))).cast("bigint").alias("bin"))
