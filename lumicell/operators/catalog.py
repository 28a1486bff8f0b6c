"""Queries over a catalog of samples.

Columns: gse_id, gsm_id, organism, tissue, protocol, cell_type, status,
mapping_rate, n_cells, median_genes, failure_category.  A null never matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SUCCESS = "SUCCESS"


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def contains(c: str, text: str) -> Column:
    """Case-insensitive literal substring."""
    return _true(F.lower(F.col(c)).contains(text.lower()))


def search(df: DataFrame, text: str | None = None) -> DataFrame:
    """Rows with the text in any string column."""
    if not text:
        return df
    columns = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.where(reduce(Column.__or__, [contains(c, text) for c in columns]))


def info(df: DataFrame, accession: str) -> DataFrame:
    """The row of a sample, or a row of a series."""
    key = "gsm_id" if accession.upper().startswith("GSM") else "gse_id"
    return df.where(F.col(key) == accession).orderBy("gsm_id").limit(1)


def species(df: DataFrame) -> DataFrame:
    """Distinct organisms of successful rows; lists are split at ; and ,"""
    names = F.explode(F.split(F.translate("organism", ";", ","), ",")).alias("organism")
    return df.where(F.col("status") == SUCCESS).select(names).select(F.trim("organism").alias("organism")).where("organism <> '' and lower(organism) <> 'unknown'").distinct()


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows of each non-blank value, successful rows only."""
    return df.where((F.col("status") == SUCCESS) & (F.trim(column) != "")).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def failure_categories(df: DataFrame) -> DataFrame:
    """Reasons of failed rows, with their share in percent."""
    reason = F.when(F.col("failure_category").isNotNull() & (F.col("failure_category") != ""), F.col("failure_category")).when(F.col("mapping_rate") < 0.1, "low_mapping").when(F.col("n_cells") == 0, "no_cells").otherwise("unknown")
    out = df.where(~_true(F.col("status") == SUCCESS)).groupBy(reason.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    total = out.agg(F.sum("n").alias("total"))
    return out.join(F.broadcast(total)).select("category", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("pct"))


def tier() -> Column:
    """gold, silver or bronze by mapping rate, genes and cells."""
    m, g, c = F.col("mapping_rate"), F.col("median_genes"), F.col("n_cells")
    return F.when((m >= 0.7) & (g >= 500) & (c >= 500), "gold").when((m >= 0.5) & (g >= 200) & (c >= 100), "silver").otherwise("bronze")


def samples(df: DataFrame, *, organism=None, status=None, tissue=None, protocol=None, cell_type=None, min_cells=None, quality_tier=None, gse_id=None, text=None) -> DataFrame:
    """Rows that meet every condition given."""
    for column, value in (("organism", organism), ("tissue", tissue), ("protocol", protocol), ("cell_type", cell_type)):
        if value is not None:
            df = df.where(contains(column, value))
    for column, value in (("status", status), ("gse_id", gse_id)):
        if value is not None:
            df = df.where(F.col(column) == value)
    if min_cells is not None:
        df = df.where(F.col("n_cells") >= min_cells)
    if quality_tier is not None:
        df = df.where(tier() == quality_tier)
    return search(df, text)


def datasets(df: DataFrame, **conditions) -> DataFrame:
    """Series with a matching row, and how many."""
    return samples(df, **conditions).groupBy("gse_id").agg(F.count(F.lit(1)).alias("n_samples"), F.sum("n_cells").alias("total_cells"))


def summary(df: DataFrame) -> DataFrame:
    ok = F.col("status") == SUCCESS
    distinct = [F.countDistinct(F.when(ok, F.col(c))).alias(f"n_{c}") for c in ("gse_id", "organism", "protocol", "tissue", "cell_type")]
    return df.agg(F.count(F.lit(1)).alias("n_samples"), F.count_if(ok).alias("n_success"), *distinct, F.sum(F.when(ok, F.col("n_cells"))).alias("total_cells"))


def top_series(df: DataFrame, n: int = 10, min_samples: int = 3, organism: str | None = None) -> DataFrame:
    """Series with most cells among those with enough successful samples, of an organism if one is given."""
    if organism is not None:
        df = df.where(contains("organism", organism))
    out = df.where(F.col("status") == SUCCESS).groupBy("gse_id").agg(F.count(F.lit(1)).alias("n_samples"), F.sum("n_cells").alias("total_cells"), F.avg("mapping_rate").alias("mean_mapping_rate"))
    return out.where(F.col("n_samples") >= min_samples).orderBy(F.desc("total_cells"), "gse_id").limit(n)


def quality_tiers(df: DataFrame) -> DataFrame:
    """Samples, share and averages of each tier; empty tiers too."""
    ok = df.where(F.col("status") == SUCCESS)
    found = ok.groupBy(tier().alias("tier")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in ("mapping_rate", "median_genes", "n_cells")])
    tiers = df.sparkSession.createDataFrame([("gold",), ("silver",), ("bronze",)], "tier string")
    total = ok.agg(F.count(F.lit(1)).alias("total"))
    out = tiers.join(found, "tier", "left").join(F.broadcast(total))
    return out.select("tier", F.coalesce("n", F.lit(0)).alias("n"), F.round(100 * F.coalesce("n", F.lit(0)) / F.greatest("total", F.lit(1)), 1).alias("pct"), "mean_mapping_rate", "mean_median_genes", "mean_n_cells")


def normal_accession(value: Column, series_only: bool = False) -> Column:
    """Accession in capitals without blanks; null if it isn't one."""
    acc = F.upper(F.trim(value.cast("string")))
    return F.when(acc.rlike(r"^GSE[0-9]{1,9}$" if series_only else r"^GS[EM][0-9]{1,9}(_[A-Z0-9]{1,16})?$"), acc)


def restricted_member(path: Column) -> Column:
    """Whether a file of a sample may hold data of persons: private files, donors' and mitochondrial ones but for their
    public tables, allele counts, variants."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    name = F.element_at(F.split(p, "/"), -1)
    donor, mt = p.startswith("donor/"), p.startswith("mt/")
    other = (p == "ase_counts.tsv") | name.startswith("snp_") | F.lower(name).rlike(r"\.(vcf|bcf)(\.gz)?$")
    return F.when(p.startswith("private/"), True).when(donor, p != "donor/donor_assignments.tsv").when(mt, p != "mt/mt_summary.tsv").otherwise(other)


def restricted_path(path: Column) -> Column:
    """The same for a path in an archive, where samples have folders; other files beside them are public."""
    inner = F.regexp_extract(path, r"^samples/GSM\d+/(.*)$", 1)
    return F.when(path.rlike(r"^samples/GSM\d+/"), restricted_member(inner)).when(path.startswith("samples/"), False).otherwise(restricted_member(path))


def restricted_summary(files: DataFrame) -> DataFrame:
    """Files and restricted ones, and their bytes, of (path, size)."""
    r = restricted_path(F.col("path"))
    return files.groupBy(r.alias("restricted")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
