"""Read-level counting: barcodes, molecules, intervals, expression units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.stats import ratio


def encode_bases(sequence: str, length: int) -> Column:
    """2-bit code of a sequence of A, C, G and T; null for other letters or lengths."""
    code = F.lit(0).cast("bigint")
    for i in range(length):
        base = F.instr(F.lit("ACGT"), F.substring(sequence, i + 1, 1)) - 1
        code = code * 4 + base
    clean = F.col(sequence).rlike(f"^[ACGT]{{{length}}}$")
    return F.when(clean, code)


def hamming_neighbours(code: Column, length: int) -> Column:
    """Array of all codes that differ in one base."""
    steps = [F.lit(x << (2 * i)).cast("bigint") for i in range(length) for x in (1, 2, 3)]
    return F.array(*[code.bitwiseXOR(s) for s in steps])


def correct_barcodes(observed: DataFrame, whitelist: DataFrame, length: int) -> DataFrame:
    """(code, reads) to whitelisted codes: exact ones stay; others move to the only or
    most read whitelisted neighbour, ties to the smaller code; the rest is dropped."""
    exact = observed.join(whitelist, "code", "left_semi").select("code", F.col("code").alias("corrected"), "reads")
    weight = exact.select(F.col("corrected"), F.col("reads").alias("support"))
    off = observed.join(whitelist, "code", "left_anti").withColumn("corrected", F.explode(hamming_neighbours(F.col("code"), length)))
    found = off.join(whitelist.select(F.col("code").alias("corrected")), "corrected", "left_semi").join(weight, "corrected", "left").fillna(0, ["support"])
    best = Window.partitionBy("code").orderBy(F.desc("support"), "corrected")
    moved = found.withColumn("k", F.row_number().over(best)).where("k = 1").select("code", "corrected", "reads")
    return exact.unionByName(moved)


def count_molecules(reads: DataFrame) -> DataFrame:
    """Distinct molecules and reads per cell and feature of (cell, feature, umi)."""
    x = reads.groupBy("cell", "feature", "umi").agg(F.count(F.lit(1)).alias("reads"))
    return x.groupBy("cell", "feature").agg(F.count(F.lit(1)).alias("molecules"), F.sum("reads").alias("reads"))


def saturation(reads: DataFrame) -> DataFrame:
    """1 - molecules / reads per cell."""
    x = count_molecules(reads).groupBy("cell").agg(F.sum("molecules").alias("molecules"), F.sum("reads").alias("reads"))
    return x.withColumn("saturation", 1 - F.col("molecules") / F.col("reads"))


def barcode_rank(totals: DataFrame) -> DataFrame:
    """Points of the knee plot: rank of each distinct total and the barcodes with it."""
    levels = totals.groupBy("total").agg(F.count(F.lit(1)).alias("barcodes"))
    w = Window.orderBy(F.desc("total")).rowsBetween(Window.unboundedPreceding, 0)
    return levels.withColumn("rank", F.sum("barcodes").over(w))


def overlap(features: DataFrame, regions: DataFrame, bin_width: int) -> DataFrame:
    """Overlapping pairs of half-open intervals (chrom, start, end): joined by bins, each
    pair kept in the first bin that both reach."""
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bin_width), F.floor((F.col(e) - 1) / bin_width)))
    a = features.where("start < end").withColumn("bin", bins("start", "end"))
    b = regions.where("start < end").select("chrom", F.col("start").alias("rstart"), F.col("end").alias("rend"), F.col("id").alias("region")).withColumn("bin", bins("rstart", "rend"))
    first = F.greatest(F.floor(F.col("start") / bin_width), F.floor(F.col("rstart") / bin_width))
    x = a.join(b, ["chrom", "bin"]).where((F.col("start") < F.col("rend")) & (F.col("rstart") < F.col("end")) & (F.col("bin") == first))
    return x.select("id", "region", (F.least("end", "rend") - F.greatest("start", "rstart")).alias("bases"))


def tpm(counts: DataFrame, lengths: DataFrame) -> DataFrame:
    """Transcripts per million of (cell, gene, value) with (gene, length)."""
    x = counts.join(lengths, "gene").withColumn("rate", ratio(F.col("value"), F.col("length")))
    total = x.groupBy("cell").agg(F.sum("rate").alias("t"))
    return x.join(total, "cell").select("cell", "gene", (F.col("rate") / F.col("t") * 1e6).alias("tpm"))


def demultiplex(tags: DataFrame, min_count: int, margin: float) -> DataFrame:
    """Call of each cell from (cell, tag, n): negative, single tag, or doublet where the
    second tag has more than a share `margin` of the first."""
    w = Window.partitionBy("cell").orderBy(F.desc("n"), "tag")
    x = tags.withColumn("k", F.row_number().over(w)).groupBy("cell").agg(
        F.max(F.when(F.col("k") == 1, F.col("tag"))).alias("tag"), F.max(F.when(F.col("k") == 1, F.col("n"))).alias("first"), F.coalesce(F.max(F.when(F.col("k") == 2, F.col("n"))), F.lit(0)).alias("second")
    )
    call = F.when(F.col("first") < min_count, "negative").when(F.col("second") > margin * F.col("first"), "doublet").otherwise(F.col("tag"))
    return x.select("cell", call.alias("call"), "first", "second")


def species_calls(counts: DataFrame, purity: float) -> DataFrame:
    """human, mouse or mixed by the share of a cell's counts on genes (cell, genome, n)."""
    x = counts.groupBy("cell").agg(F.sum(F.when(F.col("genome") == "human", F.col("n")).otherwise(0)).alias("human"), F.sum(F.when(F.col("genome") == "mouse", F.col("n")).otherwise(0)).alias("mouse"))
    total = F.col("human") + F.col("mouse")
    return x.select("cell", "human", "mouse", F.when(F.col("human") / total >= purity, "human").when(F.col("mouse") / total >= purity, "mouse").otherwise("mixed").alias("species"))


def descendants(edges: DataFrame, rounds: int = 32) -> DataFrame:
    """(term, ancestor) closure of (child, parent), each term among its own; path doubling,
    so rounds grow with the logarithm of the depth."""
    reach = edges.select(F.col("child").alias("term"), F.col("parent").alias("ancestor")).distinct()
    n = reach.count()
    for _ in range(rounds):
        step = reach.select(F.col("term").alias("ancestor"), F.col("ancestor").alias("top"))
        reach = reach.unionByName(reach.join(step, "ancestor").select("term", F.col("top").alias("ancestor"))).distinct()
        reach = cut(reach)
        m = reach.count()
        if m == n:
            break
        n = m
    terms = edges.select(F.col("child").alias("term")).unionByName(edges.select(F.col("parent").alias("term"))).distinct()
    return reach.unionByName(terms.select("term", F.col("term").alias("ancestor"))).distinct()
