"""Immune receptors: chains of each cell and clonotypes of T cells.

Contigs are rows (barcode, chain, cdr3, cdr3_nt, v_gene, j_gene, umis, kept, productive).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

T_CHAINS = ("TRA", "TRB", "TRG", "TRD")
B_CHAINS = ("IGH", "IGK", "IGL")


def top_chains(contigs: DataFrame, max_per_chain: int = 2) -> DataFrame:
    """Kept productive contigs, the max_per_chain of most molecules of each cell and chain, with their rank; ties by sequence."""
    w = Window.partitionBy("barcode", "chain").orderBy(F.desc("umis"), "cdr3_nt", "v_gene", "j_gene")
    return contigs.where("kept and productive").withColumn("rank", F.row_number().over(w) - 1)


def cell_chains(contigs: DataFrame, max_per_chain: int = 2) -> DataFrame:
    """One row a cell: its chains' junctions and molecules, receptor kind, whether it is paired, and contigs beyond the limit."""
    x = top_chains(contigs, max_per_chain)
    own = F.col("rank") < max_per_chain
    has = lambda *cs: F.count_if(own & F.col("chain").isin(*cs)) > 0
    first = lambda c, v: F.max(F.when((F.col("chain") == c) & (F.col("rank") == 0), F.col(v)))
    columns = [first(c, "cdr3").alias(f"{c}_cdr3") for c in (*T_CHAINS, *B_CHAINS)]
    receptor = F.when(has(*B_CHAINS), F.when(has("TRA", "TRB"), "mixed").otherwise("BCR")).otherwise("TCR")
    paired = (has("TRA") & has("TRB")) | (has("TRG") & has("TRD")) | (has("IGH") & has("IGK", "IGL"))
    return x.groupBy("barcode").agg(*columns, F.sum(F.when(own, F.col("umis"))).alias("umis"), receptor.alias("receptor"), paired.alias("paired"), F.count_if(~own).alias("excess_chains"))


def t_clonotypes(contigs: DataFrame, max_per_chain: int = 2) -> DataFrame:
    """T cells with the size of their clonotype: cells with the same chains, genes and junctions.

    clonotype ids go by size, ties by the clonotype's key.
    """
    x = top_chains(contigs, max_per_chain).where(F.col("rank") < max_per_chain)
    part = F.concat_ws(":", "chain", "v_gene", "j_gene", "cdr3_nt")
    cells = x.groupBy("barcode").agg(F.count_if(F.col("chain").isin(*B_CHAINS)).alias("_b"), F.concat_ws("|", F.sort_array(F.collect_list(F.when(F.col("chain").isin(*T_CHAINS), part)))).alias("key")).where("_b = 0")
    sizes = cells.groupBy("key").agg(F.count(F.lit(1)).alias("clonotype_size"))
    # a total order of clonotypes: sizes are few, so ranks come from counts of sizes and a window within a size
    per = sizes.groupBy("clonotype_size").agg(F.count(F.lit(1)).alias("c"))
    before = per.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy(F.desc("clonotype_size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    ranked = sizes.join(F.broadcast(before), "clonotype_size").withColumn("id", F.col("before") + F.row_number().over(Window.partitionBy("clonotype_size").orderBy("key")))
    return cells.join(ranked, "key").select("barcode", F.concat(F.lit("clonotype"), F.col("id").cast("string")).alias("clonotype_id"), "clonotype_size")
