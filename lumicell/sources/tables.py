"""Reading and writing data sets.

A data set on disk is Parquet: counts (by sample, sorted by cell), obs and var.
`from_tables` reads the driver's star schema as a data set: orders are cells,
parts are genes, quantities are counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CellData


def read(spark: SparkSession, path: str) -> CellData:
    return CellData(*(spark.read.parquet(f"{path}/{t}") for t in ("counts", "obs", "var")))


def write(d: CellData, path: str, partition_by: str | None = None) -> None:
    """Counts are sorted by cell within files, so that readers of few cells skip row groups."""
    counts = d.counts.sortWithinPartitions("cell", "gene").write
    (counts.partitionBy(partition_by) if partition_by else counts).parquet(f"{path}/counts")
    d.obs.write.parquet(f"{path}/obs")
    d.var.write.parquet(f"{path}/var")


def slice_cells(d: CellData, where: str, max_cells: int | None = None) -> CellData:
    """Cells by a condition on obs; their counts are read by a semi join."""
    obs = d.obs.where(where)
    if max_cells is not None:
        obs = obs.orderBy("cell").limit(max_cells)
    return CellData(d.counts.join(obs.select("cell"), "cell", "left_semi"), obs, d.var, d.embeddings)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_tables(spark: SparkSession, sf_dir: str) -> CellData:
    line, orders, customer, part = (_t(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "part"))
    counts = line.groupBy(F.col("l_orderkey").alias("cell"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("value"))
    obs = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("cell"), F.col("o_orderpriority").alias("cluster"), F.col("o_orderstatus").alias("condition"), F.col("c_mktsegment").alias("batch"), F.col("o_totalprice").alias("depth")
    )
    return CellData(counts, obs, part.select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("gset"), F.col("p_type").alias("gtype")))


def layer(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    """Counts of the lines with a status, as a layer."""
    return _t(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == flag).groupBy(F.col("l_orderkey").alias("cell"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").alias("value"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), F.col("embedding").alias("vec"), "label")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as samples, nations as organisms."""
    c = _t(spark, sf_dir, "customer").join(F.broadcast(_t(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("GSE"), F.col("c_nationkey").cast("string")).alias("gse_id"), F.concat(F.lit("GSM"), k.cast("string")).alias("gsm_id"),
        F.when(k % 11 == 0, F.concat("n_name", F.lit("; unknown"))).otherwise(F.col("n_name")).alias("organism"), F.when(k % 13 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("tissue"),
        F.concat(F.lit("v"), (k % 3).cast("string")).alias("protocol"), F.concat(F.lit("type"), (k % 17).cast("string")).alias("cell_type"),
        F.when(k % 7 == 0, "FAILED").otherwise("SUCCESS").alias("status"), ((k % 100) / 100.0).alias("mapping_rate"), (k * 7 % 1500).cast("bigint").alias("n_cells"), (k * 3 % 1100).cast("bigint").alias("median_genes"),
        F.when(k % 21 == 0, "").when(k % 14 == 0, "aligner").otherwise(F.lit(None)).alias("failure_category"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events")
