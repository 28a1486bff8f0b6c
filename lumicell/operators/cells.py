"""Quality control, filters, transforms, reshaping and sampling of cells and genes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digests import Prefixes
from ..functions.stats import ratio, variance, zero_aware_median
from ..model import CellData


def _kept(keys: DataFrame, counts: DataFrame, key: str, least, most, least_counts, most_counts) -> DataFrame:
    """Keys whose stored values and their sum are within bounds; keys without values count as 0."""
    stats = keys.select(key).join(counts.groupBy(key).agg(F.count("value").alias("_n"), F.sum("value").alias("_s")), key, "left").fillna(0, ["_n", "_s"])
    for c, op, x in (("_n", ">=", least), ("_n", "<=", most), ("_s", ">=", least_counts), ("_s", "<=", most_counts)):
        if x is not None:
            stats = stats.where(f"{c} {op} {x}")
    return stats.select(key)


def filter_cells(d: CellData, *, min_genes=None, max_genes=None, min_counts=None, max_counts=None) -> CellData:
    """Keep cells, in obs and counts, by stored genes and total counts."""
    kept = _kept(d.obs, d.counts, "cell", min_genes, max_genes, min_counts, max_counts)
    return replace(d, counts=d.counts.join(kept, "cell", "left_semi"), obs=d.obs.join(kept, "cell", "left_semi"))


def filter_genes(d: CellData, *, min_cells=None, max_cells=None, min_counts=None, max_counts=None) -> CellData:
    """Keep genes, in var and counts, by cells that have them and total counts."""
    kept = _kept(d.var, d.counts, "gene", min_cells, max_cells, min_counts, max_counts)
    return replace(d, counts=d.counts.join(kept, "gene", "left_semi"), var=d.var.join(kept, "gene", "left_semi"))


def qc_cells(d: CellData, marked: Column | None = None, top: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Genes, total, log total, share of the top genes and of marked genes (a condition on var) per cell of obs."""
    order = Window.partitionBy("cell").orderBy(F.desc("value"), "gene")
    x = d.counts.withColumn("_k", F.row_number().over(order))
    if marked is not None:
        x = x.join(d.var.select("gene", marked.alias("_m")), "gene", "left")
    aggs = [F.count("value").alias("n_genes"), F.sum("value").alias("total")]
    aggs += [F.sum(F.when(F.col("_k") <= k, F.col("value")).otherwise(0.0)).alias(f"_top{k}") for k in top]
    if marked is not None:
        aggs.append(F.sum(F.when(F.col("_m"), F.col("value")).otherwise(0.0)).alias("_marked"))
    out = d.obs.select("cell").join(x.groupBy("cell").agg(*aggs), "cell", "left").fillna(0)
    keep = ["cell", F.col("n_genes").cast("bigint").alias("n_genes"), "total", F.log1p("total").alias("log1p_total")]
    keep += [(100 * F.col(f"_top{k}") / (F.col("total") + 1e-10)).alias(f"pct_top_{k}") for k in top]
    if marked is not None:
        keep.append((100 * F.col("_marked") / (F.col("total") + 1e-10)).alias("pct_marked"))
    return out.select(*keep)


def qc_genes(d: CellData) -> DataFrame:
    """Cells, mean, log mean, dropout and total per gene of var."""
    out = d.var.select("gene").join(d.counts.groupBy("gene").agg(F.count("value").alias("n_cells"), F.sum("value").alias("total")), "gene", "left").fillna(0)
    n = d.n_cells().withColumnRenamed("n_cells", "_n")
    out = out.join(F.broadcast(n))
    mean = F.col("total") / F.col("_n")
    return out.select("gene", F.col("n_cells").cast("bigint").alias("n_cells"), "total", mean.alias("mean"), F.log1p(mean).alias("log1p_mean"), (100 * (1 - F.col("n_cells") / F.col("_n"))).alias("pct_dropout"))


def qc_summary(d: CellData, groupby: str) -> DataFrame:
    """Median, mean, deviation, quartiles and range of genes and counts per group."""
    cells = d.counts.groupBy("cell").agg(F.count("value").cast("double").alias("n_genes"), F.sum("value").alias("n_counts"))
    long = cells.join(d.obs.select("cell", groupby), "cell").unpivot(["cell", groupby], ["n_genes", "n_counts"], "metric", "x")
    return long.groupBy(groupby, "metric").agg(
        F.median("x").alias("median"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.expr("percentile(x, 0.25)").alias("q25"), F.expr("percentile(x, 0.75)").alias("q75"), F.min("x").alias("min"), F.max("x").alias("max")
    )


def describe(d: CellData) -> DataFrame:
    """Shape, sparsity, and counts and genes per cell, in one row."""
    cells = d.obs.select("cell").join(d.counts.groupBy("cell").agg(F.count("value").alias("g"), F.sum("value").alias("s")), "cell", "left").fillna(0)
    genes = d.var.agg(F.count(F.lit(1)).alias("n_genes"))
    out = cells.agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("g").alias("nnz"), F.round(F.avg("s"), 1).alias("mean_counts"), F.round(F.median("s"), 1).alias("median_counts"),
        F.round(F.avg("g"), 1).alias("mean_genes"), F.round(F.median("g"), 1).alias("median_genes"), F.max("s").alias("max_counts"),
    )
    return out.join(F.broadcast(genes)).withColumn("sparsity", F.round(1 - F.col("nnz") / (F.col("n_cells") * F.col("n_genes")), 4))


def normalize(d: CellData, target_sum: float | None = 1e4, log: bool = True) -> CellData:
    """Scale each cell to the target (None: median library size) and take log1p."""
    lib = d.counts.groupBy("cell").agg(F.sum("value").alias("_lib")).where("_lib > 0")
    x = d.counts.join(lib, "cell")
    if target_sum is None:
        x = x.join(F.broadcast(lib.agg(F.median("_lib").alias("_target"))))
    else:
        x = x.withColumn("_target", F.lit(float(target_sum)))
    v = F.col("value") * F.col("_target") / F.col("_lib")
    return d.with_counts(x.select("cell", "gene", (F.log1p(v) if log else v).alias("value")))


def transform(d: CellData, kind: str, base: float | None = None) -> CellData:
    """log1p, expm1 or sqrt of the stored values; zeros stay zeros."""
    f = {"log1p": F.log1p, "expm1": F.expm1, "sqrt": F.sqrt}[kind]("value")
    if base is not None:
        f = f / F.log(F.lit(float(base)))
    return d.with_counts(d.counts.withColumn("value", f))


def gene_moments(d: CellData, by: tuple[str, ...] = (), every: bool = False) -> DataFrame:
    """n, sum, mean and variances per gene (and group), zeros counted.

    every: also of genes of var (in each group) without counts, whose sums are 0.
    """
    sums = [F.count("value").alias("nnz"), F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2")]
    if by:
        s = d.labelled(*by).groupBy(*by, "gene").agg(*sums)
        sizes = F.broadcast(d.group_sizes(*by))
        s = d.var.select("gene").join(sizes).join(s, [*by, "gene"], "left").fillna(0, ["nnz", "s1", "s2"]) if every else s.join(sizes, list(by))
    else:
        s = d.counts.groupBy("gene").agg(*sums)
        s = (d.var.select("gene").join(s, "gene", "left").fillna(0, ["nnz", "s1", "s2"]) if every else s).join(F.broadcast(d.n_cells()))
    n = F.col("n_cells")
    return s.withColumns({"mean": F.col("s1") / n, "var": variance(F.col("s1"), F.col("s2"), n), "var1": variance(F.col("s1"), F.col("s2"), n, 1)})


def scale(d: CellData, genes: DataFrame | None = None, max_value: float = 10.0) -> DataFrame:
    """z-scores (population deviation, clipped) of all genes of var, or of the chosen genes.

    Of all genes: each stored value's z, and for each gene one row without a cell,
    which is the z of all its cells that have no row. Of chosen genes: the grid of
    cells by genes, made by exploding the list of genes, so choose few.
    """
    clip = lambda z: F.greatest(F.lit(-max_value), F.least(F.lit(max_value), z)).alias("z")
    sd = F.when(F.col("var") > 0, F.sqrt("var")).otherwise(1.0)
    if genes is None:
        m = gene_moments(d, every=True).select("gene", "mean", sd.alias("_sd"))
        stored = d.counts.join(d.obs.select("cell"), "cell", "left_semi").join(m, "gene").select("cell", "gene", clip((F.col("value") - F.col("mean")) / F.col("_sd")))
        cell = F.lit(None).cast(d.counts.schema["cell"].dataType).alias("cell")
        return stored.unionByName(m.select(cell, "gene", clip(-F.col("mean") / F.col("_sd"))))
    few = d.with_counts(d.counts.join(F.broadcast(genes), "gene", "left_semi"))
    m = gene_moments(few).select("gene", "mean", "var")
    listed = genes.agg(F.sort_array(F.collect_set("gene")).alias("g"))
    grid = d.obs.select("cell").join(F.broadcast(listed)).select("cell", F.explode("g").alias("gene"))
    x = grid.join(few.counts, ["cell", "gene"], "left").join(F.broadcast(m), "gene", "left")
    return x.select("cell", "gene", clip((F.coalesce("value", F.lit(0.0)) - F.coalesce("mean", F.lit(0.0))) / F.coalesce(sd, F.lit(1.0))))


def regress_coefficients(d: CellData, covariates: list[str]) -> DataFrame:
    """Intercept, residual variance and a slope for each covariate (numbers in obs) of each gene with counts, zeros counted.

    Normal equations of standardised covariates: their k x k matrix is solved on
    the driver, where one row is collected. Constant covariates get slope 0.
    """
    if not covariates:
        raise ValueError("covariates must not be empty")
    c = d.obs.select("cell", *[F.col(k).cast("double").alias(f"_x{i}") for i, k in enumerate(covariates)])
    xs = [f"_x{i}" for i in range(len(covariates))]
    t = c.agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"m{x}") for x in xs], *[F.stddev_pop(x).alias(f"s{x}") for x in xs]).first()
    mean, sd = [t[f"m{x}"] or 0.0 for x in xs], [t[f"s{x}"] or 0.0 for x in xs]
    flat = [s <= 1e-12 * abs(m) for m, s in zip(mean, sd)]
    c = c.select("cell", *[(F.lit(0.0) if f else (F.col(x) - m) / s).alias(x) for x, m, s, f in zip(xs, mean, sd, flat)])
    gram = c.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for a in xs for b in xs]).first()
    inverse = np.linalg.pinv(np.array([v or 0.0 for v in gram]).reshape(len(xs), -1), hermitian=True)
    g = d.counts.join(c, "cell").groupBy("gene").agg(F.sum("value").alias("sy"), F.sum(F.col("value") * F.col("value")).alias("syy"), *[F.sum(F.col("value") * F.col(x)).alias(f"sy{x}") for x in xs])
    b = [sum((float(w) * F.col(f"sy{x}") for w, x in zip(row, xs)), F.lit(0.0)) for row in inverse]  # per deviation of the covariate
    slopes = [F.lit(0.0) if f else bi / s for bi, s, f in zip(b, sd, flat)]
    n = float(t["n"])
    explained = sum((bi * F.col(f"sy{x}") for bi, x in zip(b, xs)), F.lit(0.0))
    return g.select(
        "gene", (F.col("sy") / n - sum((s * m for s, m in zip(slopes, mean)), F.lit(0.0))).alias("intercept"), ((F.col("syy") - F.col("sy") * F.col("sy") / n - explained) / n).alias("residual_var"),
        *[s.alias(f"slope_{k}") for k, s in zip(covariates, slopes)],
    )


def regress_out(d: CellData, covariates: list[str]) -> DataFrame:
    """Corrected values (residual plus intercept) of the stored pairs, with the gene's slopes.

    A cell without the gene has the value -(sum of slope times covariate) there;
    genes without counts stay 0.
    """
    x = d.counts.join(d.obs.select("cell", *[F.col(k).cast("double").alias(f"_x{i}") for i, k in enumerate(covariates)]), "cell")
    x = x.join(regress_coefficients(d, covariates).drop("intercept", "residual_var"), "gene")
    fit = sum((F.col(f"slope_{k}") * F.col(f"_x{i}") for i, k in enumerate(covariates)), F.lit(0.0))
    return x.select("cell", "gene", (F.col("value") - fit).alias("value"), *[f"slope_{k}" for k in covariates])


def aggregate(d: CellData, groupby: str, method: str = "sum") -> DataFrame:
    """Sum, mean or median of each gene per group, zeros counted; with the group's cells."""
    if method == "median":
        x = d.labelled(groupby).join(F.broadcast(d.group_sizes(groupby)), groupby)
        return zero_aware_median(x, [groupby, "gene"], "n_cells").withColumnRenamed("median", "value")
    g = d.labelled(groupby).groupBy(groupby, "gene").agg(F.sum("value").alias("value")).join(F.broadcast(d.group_sizes(groupby)), groupby)
    return g.withColumn("value", F.col("value") / F.col("n_cells")) if method == "mean" else g


def pseudobulk(d: CellData, groupby: list[str], agg: str = "mean") -> DataFrame:
    """Aggregate over several keys, joined by | in column `group`."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in groupby]).alias("group")
    return aggregate(CellData(d.counts, d.obs.select("cell", key), d.var), "group", agg)


def rank_genes(d: CellData, method: str = "variance", n_top: int | None = None) -> DataFrame:
    """All genes of var by a measure (n_top: only the first); where the mean is 0, dispersion and cv are 0."""
    m = gene_moments(d, every=True)
    mean = F.when(F.col("mean") != 0, F.col("mean")).otherwise(1.0)
    by = {"variance": F.col("var"), "mean": F.col("mean"), "dispersion": F.col("var") / mean, "dropout": 1 - F.col("nnz") / F.col("n_cells"), "cv": F.sqrt("var") / mean}[method]
    ranked = m.select("gene", F.round(by, 9).alias("score")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "gene")))
    return ranked if n_top is None else ranked.where(F.col("rank") <= n_top)


def sample_order(seed: int, *columns: str) -> Column:
    """A reproducible random order, the same on any cluster and engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def subsample(d: CellData, n: int | None = None, seed: int = 0, fraction: float | None = None) -> DataFrame:
    """n cells of obs, or a fraction of them (one at least), without replacement."""
    if (n is None) == (fraction is None):
        raise ValueError("give either n or fraction")
    n = max(1, int(d.obs.count() * fraction)) if n is None else n
    return d.obs.orderBy(sample_order(seed, "cell"), "cell").limit(n)


def subsample_balanced(d: CellData, groupby: str, n_per_group: int | None = None, seed: int = 0, fraction: float | None = None) -> DataFrame:
    """At most n cells of each group, or a fraction of it (one at least): ranks are kept under a limit, so partitions stay small."""
    if (n_per_group is None) == (fraction is None):
        raise ValueError("give either n_per_group or fraction")
    w = Window.partitionBy(groupby).orderBy(sample_order(seed, "cell"), "cell")
    ranked = d.obs.withColumn("_k", F.row_number().over(w))
    if n_per_group is not None:
        return ranked.where(F.col("_k") <= n_per_group).drop("_k")
    most = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(Window.partitionBy(groupby)) * fraction))
    return ranked.withColumn("_m", most).where(F.col("_k") <= F.col("_m")).drop("_k", "_m")


def concatenate(parts: list[CellData], join: str = "inner") -> DataFrame:
    """Counts of several data sets with column `batch`; inner keeps the genes that all have."""
    out = None
    for k, p in enumerate(parts):
        x = p.counts.select(F.lit(str(k)).alias("batch"), F.concat(F.col("cell").cast("string"), F.lit(f"-{k}")).alias("cell"), "gene", "value")
        out = x if out is None else out.unionByName(x)
    if join == "inner":
        genes = out.groupBy("gene").agg(F.countDistinct("batch").alias("n")).where(F.col("n") == len(parts)).select("gene")
        out = out.join(genes, "gene", "left_semi")
    return out


def to_wide(d: CellData, genes: list) -> DataFrame:
    """Cells by the listed genes, zeros filled in."""
    x = d.counts.where(F.col("gene").isin(genes)).groupBy("cell").pivot("gene", genes).agg(F.first("value"))
    wide = d.obs.select("cell").join(x, "cell", "left").fillna(0.0)
    return wide.select("cell", *[F.col(f"`{g}`").alias(f"g{g}") for g in genes])


def obs_values(d: CellData, keys: list[str], gene) -> DataFrame:
    """Columns of obs and one gene's values."""
    missing = [k for k in keys if k not in d.obs.columns]
    if missing:
        raise KeyError(f"not in obs: {missing}")
    return d.obs.select("cell", *keys).join(d.counts.where(F.col("gene") == gene).select("cell", "value"), "cell", "left").fillna(0.0, ["value"])


#: Molecules that a task of downsample hashes at once.
MOLECULES = 1 << 14


def _first(cell: np.ndarray, row: np.ndarray, high: np.ndarray, low: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """The first n molecules of each cell in the order of their digests."""
    order = np.lexsort((high, cell))
    if np.any((np.diff(cell[order]) == 0) & (np.diff(high[order]) == 0)):
        order = np.lexsort((low, high, cell))
    c = cell[order]
    starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    order = order[np.arange(len(c)) - np.repeat(starts, np.diff(np.r_[starts, len(c)])) < n]
    return cell[order], row[order], high[order], low[order]


def _drawn(per_cell: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow on (cell, gene, prefix, value) with the rows of a cell one after another: (cell, gene, value) of its first molecules; `most` are hashed at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept = None, None  # rows of the last cell, and its molecules so far

        def result(rows: pa.Table, row: np.ndarray) -> Iterator[pa.RecordBatch]:
            at, n = np.unique(row, return_counts=True)
            if len(at):
                out = rows.take(pa.array(at)).append_column("value", pa.array(n.astype(float)))
                yield from out.group_by(["cell", "gene"]).aggregate([("value", "sum")]).rename_columns(["cell", "gene", "value"]).to_batches()

        for b in batches:
            rows = pa.Table.from_batches([b.select(["cell", "gene"])])
            first = held.num_rows if held else 0
            rows = pa.concat_tables([held, rows]) if held else rows
            code = rows["cell"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            prefixes, counts = Prefixes(b.column("prefix")), np.maximum(b.column("value").to_numpy(zero_copy_only=False).astype(np.int64), 0)
            ends = np.cumsum(counts)
            parts = [(code[kept[0]], *kept)] if held else []
            for lo in range(0, int(ends[-1]) if len(ends) else 0, most):
                place = np.arange(lo, min(lo + most, int(ends[-1])))
                row = np.searchsorted(ends, place, "right")
                parts.append(_first(code[first + row], first + row, *prefixes.md5(row, place - ends[row] + counts[row] + 1), per_cell))
            if not parts:
                continue
            cell, row, high, low = _first(*map(np.concatenate, zip(*parts)), per_cell)
            last = cell == code[-1]
            yield from result(rows, row[~last])
            at, row = np.unique(row[last], return_inverse=True)
            held, kept = rows.take(pa.array(at)), (row, high[last], low[last])
        if held:
            yield from result(held, kept[0])

    return run


def downsample(d: CellData, per_cell: int, seed: int = 0) -> CellData:
    """Draw `per_cell` counts of each cell without replacement; smaller cells stay whole.

    The order of a cell's molecules is a hash (that of seed:cell:gene:number).
    Stored rows are dealt by cell; their molecules are made and hashed some
    thousand at a time, and only the first of each cell are held, so neither
    memory nor disk grows with counts.  Linear in counts.
    """
    x = d.counts.select("cell", "gene", F.col("value").cast("int").alias("value")).where("value > 0").repartition("cell").sortWithinPartitions("cell")
    prefix = F.concat(F.concat_ws(":", F.lit(str(seed)), "cell", "gene"), F.lit(":"))
    kinds = dict(d.counts.dtypes)
    return d.with_counts(x.select("cell", "gene", prefix.alias("prefix"), "value").mapInArrow(_drawn(per_cell, MOLECULES), f"cell {kinds['cell']}, gene {kinds['gene']}, value double"))


def splicing_ratio(spliced: DataFrame, unspliced: DataFrame, min_counts: float = 10) -> DataFrame:
    """Spliced share per cell and gene with enough counts (else null), averaged by cell."""
    x = spliced.withColumnRenamed("value", "s").join(unspliced.withColumnRenamed("value", "u"), ["cell", "gene"], "full").fillna(0.0, ["s", "u"])
    total = F.col("s") + F.col("u")
    return x.groupBy("cell").agg(F.avg(F.when((total >= min_counts) & (total > 0), F.col("s") / total)).alias("ratio"), F.sum(total).alias("total"))
