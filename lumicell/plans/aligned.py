"""Queries over counts from aligned reads and rank scores of gene sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignments as al
from ..operators import reads
from ..operators.cells import gene_moments
from ..sources import tables
from .queries import _DATA, _EMOM, _READS, _reads, query

_MOLECULES = f"{_READS}, m AS (SELECT cell, feature, count(*) AS molecules, sum(r) AS reads FROM (SELECT cell, feature, umi, count(*) AS r FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2)"


def _molecules(spark, d):
    return reads.count_molecules(_reads(spark, d))


@query(
    f"""{_MOLECULES}, t AS (SELECT cell, sum(reads)::BIGINT AS total_reads, sum(molecules)::BIGINT AS unique_umis, greatest(0, sum(reads) - sum(molecules))::BIGINT AS dup_reads FROM m GROUP BY 1)--
    SELECT *, dup_reads / total_reads AS dup_rate, (CASE WHEN dup_reads = 0 OR dup_reads >= total_reads THEN total_reads ELSE floor(total_reads * total_reads / (2 * dup_reads)) END)::BIGINT AS est_complexity FROM t""",
    "cell total_reads unique_umis dup_reads est_complexity",
    "dup_rate",
)
def read_stats(spark, d):
    return al.read_stats(_molecules(spark, d))


@query(
    f"""{_MOLECULES}, x AS (SELECT *, sum(reads) OVER (PARTITION BY cell) AS n, sum(molecules) OVER (PARTITION BY cell) AS u FROM m), c AS (SELECT cell, fraction, any_value(u) * (1 - exp(-any_value(n) * fraction / any_value(u))) AS umis, sum(1 - exp(-molecules * n / u * fraction)) AS genes, any_value(n) AS n
    FROM x, (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9, 1.0]::DOUBLE[]) AS fraction) GROUP BY 1, 2)--
    SELECT fraction, floor(sum(n) * fraction + 0.5)::BIGINT AS sampled_reads, median(umis) AS median_umis, median(genes) AS median_genes, avg(umis) AS mean_umis, avg(genes) AS mean_genes FROM c GROUP BY 1""",
    "sampled_reads",
    "fraction median_umis median_genes mean_umis mean_genes",
)
def saturation_curve(spark, d):
    return al.saturation_curve(_molecules(spark, d))


@query(
    """WITH x AS (SELECT l_orderkey AS cell, l_partkey % 50 AS snp, sum(l_quantity) AS dp, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS ad FROM lineitem GROUP BY 1, 2)--
    SELECT cell, snp, dp - ad AS ref_count, ad AS alt_count, ad / dp AS allelic_ratio FROM x WHERE dp >= 10 AND ad >= 1 AND dp > ad""",
    "cell snp",
    "ref_count alt_count allelic_ratio",
)
def allelic_expression(spark, d):
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    x = line.groupBy(F.col("l_orderkey").alias("cell"), (F.col("l_partkey") % 50).alias("snp")).agg(F.sum("l_quantity").alias("dp"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("ad"))
    return al.allelic_expression(x)


_JUNCTIONS = """WITH j AS (SELECT i AS junction, 'chr' || i % 3 AS chrom, 100 * (i % 10) AS s, 1000 + 100 * (i % 7) AS e FROM (SELECT unnest(range(0, 30)) AS i)), b AS (SELECT junction, chrom || ':' || s || '-D' AS event, 'alt_donor' AS kind FROM j UNION ALL SELECT junction, chrom || ':' || e || '-A', 'alt_acceptor' FROM j),
    ev AS (SELECT junction, event, kind FROM b WHERE event IN (SELECT event FROM b GROUP BY 1 HAVING count(*) > 1) QUALIFY row_number() OVER (PARTITION BY junction ORDER BY event) = 1)"""


def _events(spark):
    i = F.col("id")
    return al.splice_events(spark.range(30).select(i.alias("junction"), F.concat(F.lit("chr"), (i % 3).cast("string")).alias("chrom"), (100 * (i % 10)).alias("start"), (1000 + 100 * (i % 7)).alias("end")))


@query(f"{_JUNCTIONS}--\nSELECT * FROM ev", "junction event kind")
def splice_events(spark, d):
    return _events(spark)


@query(
    f"""{_JUNCTIONS}, c AS (SELECT l_orderkey // 8 AS cell, l_partkey % 30 AS junction, sum(l_quantity) AS n FROM lineitem GROUP BY 1, 2)--\nSELECT cell, junction, event, n / sum(n) OVER (PARTITION BY cell, event) AS psi FROM c JOIN ev USING (junction) WHERE n > 0""",
    "cell junction event",
    "psi",
)
def percent_spliced_in(spark, d):
    c = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.expr("l_orderkey div 8").alias("cell"), (F.col("l_partkey") % 30).alias("junction")).agg(F.sum("l_quantity").alias("n"))
    return al.percent_spliced_in(c, _events(spark))


@query("WITH g AS (SELECT l_partkey AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY 1)--\nSELECT gene, value * 1e9 / (greatest(p_size, 1) * (SELECT sum(value) FROM g)) AS fpkm FROM g JOIN part ON p_partkey = gene", "gene", "fpkm")
def fpkm(spark, d):
    lengths = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("gene"), F.col("p_size").alias("length"))
    return al.fpkm(tables.from_tables(spark, d).counts.groupBy("gene").agg(F.sum("value").alias("value")), lengths)


@query(
    """WITH g AS (SELECT p_partkey AS gene, p_partkey % 10 IN (0, 3) AS mt, p_partkey % 10 IN (1, 2) AS ribo FROM part), x AS (SELECT l_orderkey AS cell, l_partkey AS gene, sum(l_quantity) AS v, coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0) AS i FROM lineitem WHERE l_linestatus IN ('F', 'O') GROUP BY 1, 2)--
    SELECT cell, sum(v) AS total_umis, count(*) FILTER (v > 0) AS total_genes, 100 * sum(CASE WHEN mt THEN v ELSE 0 END) / sum(v) AS mt_pct, 100 * sum(CASE WHEN ribo THEN v ELSE 0 END) / sum(v) AS ribo_pct, 100 * sum(i) / sum(v) AS intronic_pct FROM x LEFT JOIN g USING (gene) GROUP BY 1""",
    "cell total_genes",
    "total_umis mt_pct ribo_pct intronic_pct",
)
def cell_read_qc(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 10 == 0, "Mt-a").when(k % 10 == 1, "RPL3").when(k % 10 == 2, "rps9").when(k % 10 == 4, "RPX").otherwise("x")
    genes = spark.read.parquet(f"{d}/part.parquet").select(k.alias("gene"), name.alias("name"), F.when(k % 10 == 3, "chrM").alias("chrom"))
    return al.cell_read_qc(tables.layer(spark, d, "F"), tables.layer(spark, d, "O"), genes)


_FRAGMENTS = "WITH f AS (SELECT l_orderkey AS cell, l_suppkey % 3 AS chrom, l_partkey % 200 * 37 - 100 AS s, (l_partkey % 200 * 37 - 100 + l_quantity * 40)::BIGINT AS e FROM lineitem)"


@query(
    f"""{_FRAGMENTS}, c AS (SELECT cell, chrom, greatest(0, s) AS s, least(e, 5000 + 1000 * chrom) AS e FROM f), x AS (SELECT cell, chrom, unnest(range(s // 500, (e - 1) // 500 + 1)) AS bin FROM c WHERE s < e)--\nSELECT cell, chrom, bin, count(*) AS n FROM x GROUP BY 1, 2, 3""",
    "cell chrom bin n",
)
def fragment_bins(spark, d):
    start = F.col("l_partkey") % 200 * 37 - 100
    f = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("cell"), (F.col("l_suppkey") % 3).alias("chrom"), start.alias("start"), (start + F.col("l_quantity") * 40).cast("bigint").alias("end"))
    return al.bin_counts(f, spark.range(3).select(F.col("id").alias("chrom"), (5000 + 1000 * F.col("id")).alias("size")))


@query(
    """WITH b AS (SELECT l_orderkey % 97 AS cell, l_partkey % 40 AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2), g AS (SELECT c.cell, i AS bin, log2(coalesce(n, 0) + 1) AS v, coalesce(n, 0) AS n FROM (SELECT DISTINCT cell FROM b) c CROSS JOIN (SELECT unnest(range(0, 40)) AS i) LEFT JOIN b ON b.cell = c.cell AND b.bin = i),
    s AS (SELECT cell, n, abs(v - lag(v) OVER (PARTITION BY cell ORDER BY bin)) AS d FROM g)--\nSELECT cell, avg(n) AS coverage, median(d) AS mapd FROM s GROUP BY 1""",
    "cell",
    "coverage mapd",
)
def coverage_noise(spark, d):
    b = spark.read.parquet(f"{d}/lineitem.parquet").groupBy((F.col("l_orderkey") % 97).alias("cell"), (F.col("l_partkey") % 40).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return al.coverage_noise(b, 40)


@query(
    """WITH c AS (SELECT p_brand AS assembly, p_size * 100 + p_partkey % 7 AS length FROM part), o AS (SELECT *, sum(length) OVER (PARTITION BY assembly ORDER BY length DESC) AS u, sum(length) OVER (PARTITION BY assembly) AS t FROM c)--
    SELECT assembly, count(*) AS contigs, sum(length)::BIGINT AS bases, max(length) FILTER (u >= 0.5 * t) AS n50, max(length) FILTER (u >= 0.9 * t) AS n90, max(length) AS largest, min(length) AS smallest FROM o GROUP BY 1""",
    "assembly contigs bases n50 n90 largest smallest",
)
def contig_stats(spark, d):
    return al.contig_stats(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("assembly"), (F.col("p_size") * 100 + F.col("p_partkey") % 7).alias("length")), "assembly")


_SIGNAL = "rs AS (SELECT cell, gene, 1 - (rank() OVER (PARTITION BY cell ORDER BY value DESC) + (count(*) OVER (PARTITION BY cell, value) - 1) / 2.0 - 1) / 1500 AS s FROM counts)"


@query(f"{_DATA}, {_SIGNAL}--\nSELECT * FROM rs WHERE s > 0", "cell gene", "s")
def rank_signal(spark, d):
    return al.rank_signal(tables.from_tables(spark, d).counts)


@query(
    f"""{_DATA}, {_SIGNAL}, st AS (SELECT gset, count(*) AS k FROM var WHERE gset IS NOT NULL GROUP BY 1), x AS (SELECT cell, gset, sum(s) AS s FROM rs JOIN var USING (gene) WHERE s > 0 GROUP BY 1, 2)--
    SELECT obs.cell, st.gset, least(1.0, coalesce(s, 0) / k / (1 - (k - 1) / 3000.0)) AS auc FROM obs CROSS JOIN st LEFT JOIN x ON x.cell = obs.cell AND x.gset = st.gset""",
    "cell gset",
    "auc",
)
def rank_set_scores(spark, d):
    return al.rank_set_scores(tables.from_tables(spark, d), "gset")


@query(f"{_DATA}{_EMOM.format(t='counts')}--\nSELECT gene, least(49, (row_number() OVER (ORDER BY round(mean, 9), gene) - 1) * 50 // (SELECT count(*) FROM var)) AS bin FROM emom", "gene bin")
def abundance_bins(spark, d):
    return al.abundance_bins(gene_moments(tables.from_tables(spark, d), every=True).select("gene", "mean"))
