"""One query per operator over the driver's tables, with the SQL that gives the same rows.

Doubles are rounded to six digits on both sides, since sums are added up in
another order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as cat
from ..operators import cells, markers, reads, vectors
from ..sources import tables
from ..streaming import events as ev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_COUNTS = "counts AS (SELECT l_orderkey AS cell, l_partkey AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
_OBS = "obs AS (SELECT o_orderkey AS cell, o_orderpriority AS cluster, o_orderstatus AS condition, c_mktsegment AS batch, o_totalprice AS depth FROM orders JOIN customer ON o_custkey = c_custkey)"
_VAR = "var AS (SELECT p_partkey AS gene, p_brand AS gset, p_type AS gtype FROM part)"
_DATA = f"WITH {_COUNTS}, {_OBS}, {_VAR}"
_NORM = _DATA + ", norm AS (SELECT cell, gene, ln(1 + value * 10000 / sum(value) OVER (PARTITION BY cell)) AS value FROM counts)"
_MOM = """, mom AS (SELECT gene, n, count(*) AS nnz, sum(value) AS s1, sum(value * value) AS s2, sum(value) / n AS mean,
  greatest(sum(value * value) - sum(value) * sum(value) / n, 0) / n AS v0, greatest(sum(value * value) - sum(value) * sum(value) / n, 0) / (n - 1) AS v1
  FROM {t}, (SELECT count(*) AS n FROM obs) GROUP BY gene, n)"""
_EMOM = """, emom AS (SELECT gene, n, nnz, s1, s2, s1 / n AS mean, greatest(s2 - s1 * s1 / n, 0) / n AS v0 FROM (SELECT v.gene, count(value) AS nnz, coalesce(sum(value), 0) AS s1,
  coalesce(sum(value * value), 0) AS s2 FROM var v LEFT JOIN {t} c ON c.gene = v.gene GROUP BY 1), (SELECT count(*) AS n FROM obs))"""
_EVERY = """, gr AS (SELECT {g}, count(*) AS n FROM obs GROUP BY 1), ge AS (SELECT gene, sum(value) AS t1, sum(value * value) AS t2 FROM counts GROUP BY 1),
  gs AS (SELECT {g}, gene, sum(value) AS s1, sum(value * value) AS s2 FROM counts JOIN obs USING (cell) GROUP BY 1, 2),
  em AS (SELECT gr.{g}, ge.gene, n, t1, t2, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2, coalesce(s1, 0) / n AS mean FROM gr CROSS JOIN ge LEFT JOIN gs ON gs.{g} = gr.{g} AND gs.gene = ge.gene)"""
_GMOM = """, gmom AS (SELECT {g}, gene, n_cells AS n, count(*) AS nnz, sum(value) AS s1, sum(value * value) AS s2, sum(value) / n_cells AS mean,
  greatest(sum(value * value) - sum(value) * sum(value) / n_cells, 0) / (n_cells - 1) AS v1
  FROM {t} JOIN obs USING (cell) JOIN (SELECT {g}, count(*) AS n_cells FROM obs GROUP BY 1) USING ({g}) GROUP BY {g}, gene, n_cells)"""
_RANKS = """, x AS (SELECT cluster, gene, value FROM counts JOIN obs USING (cell)),
  rk AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY gene) AS nnz, sum(value) OVER (PARTITION BY gene) AS t1 FROM x),
  gs AS (SELECT cluster, count(*) AS n_in FROM obs GROUP BY 1), tot AS (SELECT count(*) AS n FROM obs),
  gg AS (SELECT gene, any_value(nnz) AS nnz, any_value(t1) AS t1 FROM rk GROUP BY 1),
  st AS (SELECT cluster, gene, sum(r) AS r, count(*) AS k, sum(value) AS s1 FROM rk GROUP BY 1, 2),
  ru AS (SELECT g.cluster, gg.gene, n_in, n - n_in AS n_out, coalesce(k, 0) AS nnz_in, gg.nnz - coalesce(k, 0) AS nnz_out,
    coalesce(r, 0) + coalesce(k, 0) * (n - gg.nnz) + (n_in - coalesce(k, 0)) * (n - gg.nnz + 1) / 2.0 - n_in * (n_in + 1) / 2.0 AS u,
    coalesce(s1, 0) / n_in AS mean_in, (t1 - coalesce(s1, 0)) / (n - n_in) AS mean_out, n
    FROM gs g CROSS JOIN gg CROSS JOIN tot LEFT JOIN st ON st.cluster = g.cluster AND st.gene = gg.gene),
  rs AS (SELECT *, (u - n_in * n_out / 2.0) / sqrt(n_in * n_out * (n + 1) / 12.0) AS z, log2((mean_in + 1e-9) / (mean_out + 1e-9)) AS log2fc FROM ru)"""
_TAIL = """least(1.0, 2 * exp(-{z} * {z} / 2) / 2.5066282746310002 * ({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))))"""
_P = _TAIL.format(z="abs(z)", t="(1 / (1 + 0.2316419 * abs(z)))")
_CAT = """WITH cat AS (SELECT 'GSE' || c_nationkey AS gse_id, 'GSM' || c_custkey AS gsm_id, CASE WHEN c_custkey % 11 = 0 THEN n_name || '; unknown' ELSE n_name END AS organism,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS tissue, 'v' || c_custkey % 3 AS protocol, 'type' || c_custkey % 17 AS cell_type,
  CASE WHEN c_custkey % 7 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status, (c_custkey % 100) / 100.0 AS mapping_rate, c_custkey * 7 % 1500 AS n_cells, c_custkey * 3 % 1100 AS median_genes,
  CASE WHEN c_custkey % 21 = 0 THEN '' WHEN c_custkey % 14 = 0 THEN 'aligner' END AS failure_category FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_TIER = "CASE WHEN mapping_rate >= 0.7 AND median_genes >= 500 AND n_cells >= 500 THEN 'gold' WHEN mapping_rate >= 0.5 AND median_genes >= 200 AND n_cells >= 100 THEN 'silver' ELSE 'bronze' END"
_CATCOLS = "gse_id, gsm_id, organism, tissue, protocol, cell_type, status, n_cells, median_genes, failure_category"
_VEC = "WITH v AS (SELECT vec_id AS cell, embedding::DOUBLE[] AS vec, label FROM embeddings)"
_KNN = (
    _VEC
    + """, d AS (SELECT a.cell, b.cell AS neighbour, round(list_distance(a.vec, b.vec), 9) AS distance FROM v a JOIN v b ON a.cell <> b.cell),
  nn AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY distance, neighbour) AS rank FROM d QUALIFY rank <= 10)"""
)
_CENT = _VEC + """, u AS (SELECT cell, label, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM v),
  c AS (SELECT label, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(x) AS m FROM u GROUP BY 1, 2) GROUP BY 1)"""


def query(sql: str | None = None, plain: str = "", doubles: str = ""):
    """Register a query; the SQL's columns are the plain ones and the rounded ones."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])

        run.__doc__, run.__name__ = f.__doc__, f.__name__
        QUERIES[f.__name__] = run
        if sql:
            columns = [*plain.replace(",", " ").split(), *[f"round({c}::DOUBLE, 6) + 0.0 AS {c}" for c in doubles.split()]]
            head, _, body = sql.rpartition("--\n")
            SQL[f.__name__] = f"{head}\nSELECT {', '.join(columns)} FROM ({body})"
        return f

    return add


def _norm(spark, d):
    return cells.normalize(tables.from_tables(spark, d))


# catalog


@query(f"{_CAT}--\nSELECT * FROM cat WHERE lower(concat_ws(chr(1), gse_id, gsm_id, organism, tissue, protocol, cell_type, status, failure_category)) LIKE '%build%'", _CATCOLS, "mapping_rate")
def catalog_search(spark, d):
    return cat.search(tables.catalog(spark, d), "BUILD")


@query(f"{_CAT}--\nSELECT * FROM cat WHERE gse_id = 'GSE3'", _CATCOLS, "mapping_rate")
def sample_index(spark, d):
    return cat.samples(tables.catalog(spark, d), gse_id="GSE3")


@query(f"{_CAT}--\nSELECT * FROM cat WHERE gsm_id = 'GSM42'", _CATCOLS, "mapping_rate")
def info(spark, d):
    return cat.info(tables.catalog(spark, d), "GSM42")


@query(f"{_CAT}--\nSELECT DISTINCT o AS organism FROM (SELECT trim(unnest(string_split(replace(organism, ';', ','), ','))) AS o FROM cat WHERE status = 'SUCCESS') WHERE o <> '' AND lower(o) <> 'unknown'", "organism")
def species(spark, d):
    return cat.species(tables.catalog(spark, d))


for _name, _column in (("tissues", "tissue"), ("protocols", "protocol"), ("cell_types", "cell_type")):

    def _counts(spark, d, column=_column):
        return cat.value_counts(tables.catalog(spark, d), column)

    _counts.__name__ = _name
    query(f"{_CAT}--\nSELECT {_column}, count(*) AS n FROM cat WHERE status = 'SUCCESS' AND trim({_column}) <> '' GROUP BY 1", f"{_column} n")(_counts)


@query(
    f"""{_CAT}--\nSELECT category, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM (SELECT CASE WHEN failure_category IS NOT NULL AND failure_category <> '' THEN failure_category
    WHEN mapping_rate < 0.1 THEN 'low_mapping' WHEN n_cells = 0 THEN 'no_cells' ELSE 'unknown' END AS category FROM cat WHERE status <> 'SUCCESS') GROUP BY 1""",
    "category n",
    "pct",
)
def failure_categories(spark, d):
    return cat.failure_categories(tables.catalog(spark, d))


@query(f"{_CAT}--\nSELECT gse_id, count(*) AS n_samples, sum(n_cells)::BIGINT AS total_cells FROM cat WHERE lower(protocol) LIKE '%v1%' AND n_cells >= 700 GROUP BY 1", "gse_id n_samples total_cells")
def datasets(spark, d):
    return cat.datasets(tables.catalog(spark, d), protocol="V1", min_cells=700)


@query(
    f"""{_CAT}--\nSELECT count(*) AS n_samples, count(*) FILTER (status = 'SUCCESS') AS n_success, {', '.join(f"count(DISTINCT {c}) FILTER (status = 'SUCCESS') AS n_{c}" for c in ('gse_id', 'organism', 'protocol', 'tissue', 'cell_type'))},
    (sum(n_cells) FILTER (status = 'SUCCESS'))::BIGINT AS total_cells FROM cat""",
    "n_samples n_success n_gse_id n_organism n_protocol n_tissue n_cell_type total_cells",
)
def catalog_summary(spark, d):
    return cat.summary(tables.catalog(spark, d))


@query(f"{_CAT}--\nSELECT * FROM cat WHERE status = 'SUCCESS' AND lower(tissue) LIKE '%auto%' AND n_cells >= 300 AND {_TIER} = 'gold'", _CATCOLS, "mapping_rate")
def samples(spark, d):
    return cat.samples(tables.catalog(spark, d), status="SUCCESS", tissue="Auto", min_cells=300, quality_tier="gold")


@query(
    f"{_CAT}--\nSELECT gse_id, count(*) AS n_samples, sum(n_cells)::BIGINT AS total_cells, avg(mapping_rate) AS mean_mapping_rate FROM cat WHERE status = 'SUCCESS' GROUP BY 1 HAVING count(*) >= 3 ORDER BY 3 DESC, 1 LIMIT 10",
    "gse_id n_samples total_cells",
    "mean_mapping_rate",
)
def top_series(spark, d):
    return cat.top_series(tables.catalog(spark, d))


@query(
    f"""{_CAT}--\nSELECT tier, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / greatest((SELECT count(*) FROM cat WHERE status = 'SUCCESS'), 1), 1) AS pct, mean_mapping_rate, mean_median_genes, mean_n_cells
    FROM (SELECT unnest(['gold', 'silver', 'bronze']) AS tier) LEFT JOIN (SELECT {_TIER} AS tier, count(*) AS n, avg(mapping_rate) AS mean_mapping_rate, avg(median_genes) AS mean_median_genes, avg(n_cells) AS mean_n_cells
    FROM cat WHERE status = 'SUCCESS' GROUP BY 1) USING (tier)""",
    "tier n",
    "pct mean_mapping_rate mean_median_genes mean_n_cells",
)
def quality_tiers(spark, d):
    return cat.quality_tiers(tables.catalog(spark, d))


# quality control and filters


@query(f"{_DATA}--\nSELECT * FROM counts WHERE cell IN (SELECT cell FROM counts GROUP BY 1 HAVING count(*) >= 3 AND sum(value) BETWEEN 60 AND 200)", "cell gene", "value")
def filter_cells(spark, d):
    return cells.filter_cells(tables.from_tables(spark, d), min_genes=3, min_counts=60, max_counts=200).counts


@query(f"{_DATA}--\nSELECT * FROM counts WHERE gene IN (SELECT gene FROM counts GROUP BY 1 HAVING count(*) >= 30 AND sum(value) <= 900)", "cell gene", "value")
def filter_genes(spark, d):
    return cells.filter_genes(tables.from_tables(spark, d), min_cells=30, max_counts=900).counts


@query(
    f"""{_DATA}, x AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY value DESC, gene) AS k FROM counts JOIN var USING (gene)),
    a AS (SELECT cell, count(*) AS n_genes, sum(value) AS total, sum(CASE WHEN k <= 1 THEN value ELSE 0 END) AS t1, sum(CASE WHEN k <= 2 THEN value ELSE 0 END) AS t2, sum(CASE WHEN gtype = 'PROMO' THEN value ELSE 0 END) AS m FROM x GROUP BY 1)--
    SELECT cell, coalesce(n_genes, 0) AS n_genes, coalesce(total, 0) AS total, ln(1 + coalesce(total, 0)) AS log1p_total, 100 * coalesce(t1, 0) / (coalesce(total, 0) + 1e-10) AS pct_top_1,
    100 * coalesce(t2, 0) / (coalesce(total, 0) + 1e-10) AS pct_top_2, 100 * coalesce(m, 0) / (coalesce(total, 0) + 1e-10) AS pct_marked FROM obs LEFT JOIN a USING (cell)""",
    "cell n_genes",
    "total log1p_total pct_top_1 pct_top_2 pct_marked",
)
def qc_metrics_cells(spark, d):
    return cells.qc_cells(tables.from_tables(spark, d), F.col("gtype") == "PROMO")


@query(
    f"""{_DATA}, n AS (SELECT count(*) AS n FROM obs)--
    SELECT gene, coalesce(n_cells, 0) AS n_cells, coalesce(total, 0) AS total, coalesce(total, 0) / n AS mean, ln(1 + coalesce(total, 0) / n) AS log1p_mean, 100 * (1 - coalesce(n_cells, 0) / n) AS pct_dropout
    FROM var CROSS JOIN n LEFT JOIN (SELECT gene, count(*) AS n_cells, sum(value) AS total FROM counts GROUP BY 1) USING (gene)""",
    "gene n_cells",
    "total mean log1p_mean pct_dropout",
)
def qc_metrics_genes(spark, d):
    return cells.qc_genes(tables.from_tables(spark, d))


@query(
    f"""{_DATA}, c AS (SELECT cell, count(*)::DOUBLE AS n_genes, sum(value) AS n_counts FROM counts GROUP BY 1), l AS (SELECT batch, 'n_genes' AS metric, n_genes AS x FROM c JOIN obs USING (cell) UNION ALL SELECT batch, 'n_counts', n_counts FROM c JOIN obs USING (cell))--
    SELECT batch, metric, median(x) AS median, avg(x) AS mean, stddev_samp(x) AS std, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.75) AS q75, min(x) AS min, max(x) AS max FROM l GROUP BY 1, 2""",
    "batch metric",
    "median mean std q25 q75 min max",
)
def qc_summary(spark, d):
    return cells.qc_summary(tables.from_tables(spark, d), "batch")


@query(
    f"""{_DATA}, c AS (SELECT cell, coalesce(g, 0) AS g, coalesce(s, 0) AS s FROM obs LEFT JOIN (SELECT cell, count(*) AS g, sum(value) AS s FROM counts GROUP BY 1) USING (cell))--
    SELECT n_cells, nnz, mean_counts, median_counts, mean_genes, median_genes, max_counts, n_genes, round(1 - nnz / (n_cells * n_genes), 4) AS sparsity FROM (
    SELECT count(*) AS n_cells, sum(g)::BIGINT AS nnz, round(avg(s), 1) AS mean_counts, round(median(s), 1) AS median_counts, round(avg(g), 1) AS mean_genes, round(median(g), 1) AS median_genes, max(s) AS max_counts FROM c),
    (SELECT count(*) AS n_genes FROM var)""",
    "n_cells nnz n_genes",
    "mean_counts median_counts mean_genes median_genes max_counts sparsity",
)
def describe(spark, d):
    return cells.describe(tables.from_tables(spark, d))


# transforms


@query(f"{_NORM}--\nSELECT * FROM norm", "cell gene", "value")
def normalize(spark, d):
    return _norm(spark, d).counts


@query(f"{_DATA}, l AS (SELECT cell, sum(value) AS lib FROM counts GROUP BY 1)--\nSELECT cell, gene, value * (SELECT median(lib) FROM l) / lib AS value FROM counts JOIN l USING (cell)", "cell gene", "value")
def normalize_median(spark, d):
    return cells.normalize(tables.from_tables(spark, d), None, log=False).counts


for _kind, _sql in (("log1p", "ln(1 + value) / ln(2.0)"), ("expm1", "exp(value / 10) - 1"), ("sqrt", "sqrt(value)")):

    def _transform(spark, d, kind=_kind):
        x = tables.from_tables(spark, d)
        if kind == "expm1":
            x = x.with_counts(x.counts.withColumn("value", F.col("value") / 10))
        return cells.transform(x, kind, 2 if kind == "log1p" else None).counts

    _transform.__name__ = f"transform_{_kind}"
    query(f"{_DATA}--\nSELECT cell, gene, {_sql} AS value FROM counts", "cell gene", "value")(_transform)


@query(f"{_DATA}, s AS (SELECT cluster, count(*) AS n_cells FROM obs GROUP BY 1)--\nSELECT cluster, gene, sum(value) AS value, n_cells FROM counts JOIN obs USING (cell) JOIN s USING (cluster) GROUP BY 1, 2, 4", "cluster gene n_cells", "value")
def aggregate_sum(spark, d):
    return cells.aggregate(tables.from_tables(spark, d), "cluster")


@query(
    f"""{_DATA}, s AS (SELECT condition, count(*) AS n_cells FROM obs GROUP BY 1), a AS (SELECT condition, gene, n_cells, list_sort(list(value)) AS v FROM counts JOIN obs USING (cell) JOIN s USING (condition) WHERE value > 0 GROUP BY 1, 2, 3),
    b AS (SELECT condition, gene, v, n_cells - len(v) AS z, (n_cells + 1) // 2 AS lo, n_cells // 2 + 1 AS hi FROM a)--
    SELECT condition, gene, (CASE WHEN lo <= z THEN 0 ELSE v[lo - z] END + CASE WHEN hi <= z THEN 0 ELSE v[hi - z] END) / 2.0 AS value FROM b""",
    "condition gene",
    "value",
)
def aggregate_median(spark, d):
    return cells.aggregate(tables.from_tables(spark, d), "condition", "median")


@query(
    f"""{_DATA}, o AS (SELECT cell, condition || '|' || batch AS "group" FROM obs), s AS (SELECT "group", count(*) AS n_cells FROM o GROUP BY 1)--
    SELECT "group" AS g, gene, sum(value) / n_cells AS value, n_cells FROM counts JOIN o USING (cell) JOIN s USING ("group") GROUP BY 1, 2, 4""",
    "g gene n_cells",
    "value",
)
def pseudobulk(spark, d):
    return cells.pseudobulk(tables.from_tables(spark, d), ["condition", "batch"]).withColumnRenamed("group", "g")


for _method, _score in (("variance", "v0"), ("dispersion", "v0 / CASE WHEN mean <> 0 THEN mean ELSE 1 END"), ("cv", "sqrt(v0) / CASE WHEN mean <> 0 THEN mean ELSE 1 END"), ("dropout", "1 - nnz / n"), ("mean", "mean")):

    def _rank(spark, d, method=_method):
        return cells.rank_genes(tables.from_tables(spark, d), method).select("gene", "rank", "score")

    _rank.__name__ = f"rank_genes_{_method}"
    query(
        f"{_DATA}{_EMOM.format(t='counts')}--\nSELECT gene, score, row_number() OVER (ORDER BY score DESC, gene) AS rank FROM (SELECT gene, round({_score}, 9) AS score FROM emom)",
        "gene rank",
        "score",
    )(_rank)


@query(
    f"""{_DATA}{_EMOM.format(t='counts')}, m AS (SELECT gene, mean, CASE WHEN v0 > 0 THEN sqrt(v0) ELSE 1 END AS sd FROM emom)--
    SELECT cell, gene, greatest(-10, least(10, (value - mean) / sd)) AS z FROM counts SEMI JOIN obs USING (cell) JOIN m USING (gene) UNION ALL SELECT NULL, gene, greatest(-10, least(10, -mean / sd)) FROM m""",
    "cell gene",
    "z",
)
def scale(spark, d):
    return cells.scale(tables.from_tables(spark, d))


@query(
    f"""{_DATA}, t AS (SELECT count(*) AS n, sum(depth) AS sx, sum(depth * depth) AS sxx FROM obs), g AS (SELECT gene, sum(value) AS sy, sum(value * depth) AS sxy, sum(value * value) AS syy FROM counts JOIN obs USING (cell) GROUP BY 1),
    s AS (SELECT *, (sxy - sx * sy / n) / (sxx - sx * sx / n) AS slope FROM g, t)--\nSELECT gene, slope * 1e6 AS slope, (sy - slope * sx) / n AS intercept, (syy - sy * sy / n - slope * (sxy - sx * sy / n)) / n AS residual_var FROM s""",
    "gene",
    "slope intercept residual_var",
)
def regress_out(spark, d):
    x = cells.regress_coefficients(tables.from_tables(spark, d), ["depth"])
    return x.select("gene", (F.col("slope_depth") * 1e6).alias("slope"), "intercept", "residual_var")


@query()
def regress_out_values(spark, d):
    x = tables.from_tables(spark, d)
    total = x.counts.groupBy("cell").agg(F.sum("value").alias("total"))
    obs = x.obs.join(total, "cell", "left").fillna(0.0, ["total"])
    # slopes times 1e6, since values are rounded to six digits
    return cells.regress_out(replace(x, obs=obs), ["depth", "total"]).withColumns({k: F.col(k) * 1e6 for k in ("slope_depth", "slope_total")})


@query(f"{_DATA}--\nSELECT cell, cluster FROM obs ORDER BY md5('7:' || cell), cell LIMIT 100", "cell cluster")
def subsample(spark, d):
    return cells.subsample(tables.from_tables(spark, d), 100, 7).select("cell", "cluster")


@query(f"{_DATA}--\nSELECT cell, cluster, row_number() OVER (PARTITION BY cluster ORDER BY md5('0:' || cell), cell) AS k FROM obs QUALIFY k <= 20", "cell cluster")
def subsample_balanced(spark, d):
    return cells.subsample_balanced(tables.from_tables(spark, d), "cluster", 20).select("cell", "cluster")


@query(
    f"""{_DATA}, m AS (SELECT cell, gene, unnest(range(1, value::INT + 1)) AS m FROM counts), k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY md5('0:' || cell || ':' || gene || ':' || m)) AS k FROM m QUALIFY k <= 20)--
    SELECT cell, gene, count(*) AS value FROM k GROUP BY 1, 2""",
    "cell gene",
    "value",
)
def downsample_counts(spark, d):
    return cells.downsample(tables.from_tables(spark, d), 20).counts


@query(
    f"""WITH a AS (SELECT '0' AS batch, l_orderkey || '-0' AS cell, l_partkey AS gene, sum(l_quantity) AS value FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey, l_partkey),
    b AS (SELECT '1' AS batch, l_orderkey || '-1' AS cell, l_partkey AS gene, sum(l_quantity) AS value FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey, l_partkey)--
    SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE gene IN (SELECT gene FROM a) AND gene IN (SELECT gene FROM b)""",
    "batch cell gene",
    "value",
)
def concatenate(spark, d):
    x = tables.from_tables(spark, d)
    return cells.concatenate([x.with_counts(tables.layer(spark, d, "F")), x.with_counts(tables.layer(spark, d, "O"))])


@query(f"{_DATA}--\nSELECT cell, {', '.join(f'coalesce(max(value) FILTER (gene = {g}), 0) AS g{g}' for g in (1, 2, 3))} FROM obs LEFT JOIN counts USING (cell) GROUP BY 1", "cell", "g1 g2 g3")
def to_df(spark, d):
    return cells.to_wide(tables.from_tables(spark, d), [1, 2, 3])


@query(f"{_DATA}--\nSELECT cell, batch, coalesce(value, 0) AS value FROM obs LEFT JOIN (SELECT * FROM counts WHERE gene = 5) USING (cell)", "cell batch", "value")
def obs_df(spark, d):
    return cells.obs_values(tables.from_tables(spark, d), ["batch"], 5)


@query(f"{_DATA}--\nSELECT gene, gset, coalesce(value, 0) AS value FROM var LEFT JOIN (SELECT * FROM counts WHERE cell = 32) USING (gene)", "gene gset", "value")
def var_df(spark, d):
    x = tables.from_tables(spark, d)
    return x.var.select("gene", "gset").join(x.counts.where("cell = 32").select("gene", "value"), "gene", "left").fillna(0.0, ["value"])


@query(
    f"""WITH s AS (SELECT l_orderkey AS cell, l_partkey AS gene, sum(l_quantity) FILTER (l_linestatus = 'F') AS s, sum(l_quantity) FILTER (l_linestatus = 'O') AS u FROM lineitem GROUP BY 1, 2)--
    SELECT cell, avg(CASE WHEN coalesce(s, 0) + coalesce(u, 0) >= 10 THEN coalesce(s, 0) / (coalesce(s, 0) + coalesce(u, 0)) END) AS ratio, sum(coalesce(s, 0) + coalesce(u, 0)) AS total FROM s GROUP BY 1""",
    "cell",
    "ratio total",
)
def splicing_ratio(spark, d):
    return cells.splicing_ratio(tables.layer(spark, d, "F"), tables.layer(spark, d, "O"))


@query(f"{_DATA}--\nSELECT c.* FROM counts c JOIN obs USING (cell) WHERE cluster = '1-URGENT' AND condition = 'O'", "cell gene", "value")
def slice_cells(spark, d):
    return tables.slice_cells(tables.from_tables(spark, d), "cluster = '1-URGENT' and condition = 'O'").counts


@query(f"{_DATA}--\nSELECT cluster, condition, count(*) AS n FROM obs WHERE batch IN ('BUILDING', 'MACHINERY') AND depth >= 1000 GROUP BY 1, 2", "cluster condition n")
def cell_index_count(spark, d):
    return tables.from_tables(spark, d).obs.where("batch in ('BUILDING', 'MACHINERY') and depth >= 1000").groupBy("cluster", "condition").agg(F.count(F.lit(1)).alias("n"))


# variable genes and markers


@query(
    f"""{_NORM}{_MOM.format(t='norm')}, m AS (SELECT gene, ln(CASE WHEN v0 > 0 THEN v0 / mean END) AS disp, ln(1 + mean) AS lm FROM mom WHERE mean > 0), l AS (SELECT min(lm) AS lo, max(lm) AS hi FROM m),
    b AS (SELECT gene, disp, CASE WHEN hi > lo THEN least(19, floor((lm - lo) / ((hi - lo) / 20))) ELSE 0 END::INT AS bin FROM m, l), s AS (SELECT bin, avg(disp) AS bm, stddev_pop(disp) AS bs FROM b GROUP BY 1)--
    SELECT gene, bin, round(CASE WHEN bs > 1e-12 THEN (disp - bm) / bs ELSE 0 END, 6) AS norm_disp FROM b JOIN s USING (bin) ORDER BY 3 DESC NULLS LAST, 1 LIMIT 2000""",
    "gene bin",
    "norm_disp",
)
def hvg_seurat(spark, d):
    return markers.hvg_seurat(_norm(spark, d))


@query(
    f"""{_DATA}{_MOM.format(t='counts')}, b AS (SELECT gene, log10(v1 / mean) AS disp, (ntile(20) OVER (ORDER BY mean, gene) - 1)::INT AS bin FROM mom WHERE mean > 0 AND v1 > 0), m AS (SELECT bin, median(disp) AS med, count(*) AS n FROM b GROUP BY 1),
    e AS (SELECT *, abs(disp - med) AS dev FROM b JOIN m USING (bin)), a AS (SELECT bin, median(dev) AS mad FROM e GROUP BY 1)--
    SELECT gene, bin, round(CASE WHEN n >= 2 AND mad > 1e-12 THEN (disp - med) / mad ELSE 0 END, 6) AS norm_disp FROM e JOIN a USING (bin) ORDER BY 3 DESC, 1 LIMIT 2000""",
    "gene bin",
    "norm_disp",
)
def hvg_cell_ranger(spark, d):
    return markers.hvg_cell_ranger(tables.from_tables(spark, d))


@query(f"{_DATA}{_RANKS}--\nSELECT * FROM rs", "cluster gene n_in n_out nnz_in nnz_out", "u z mean_in mean_out log2fc")
def rank_sum_statistics(spark, d):
    return markers.rank_sums(tables.from_tables(spark, d), "cluster")


@query(
    f"""{_DATA}{_RANKS}, p AS (SELECT cluster, gene, round(z, 6) AS zr, log2fc, {_P} AS pval FROM rs), q AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY pval, gene) AS r, count(*) OVER (PARTITION BY cluster) AS n FROM p)--
    SELECT cluster, gene, zr, log2fc, pval, least(1.0, min(pval * n / r) OVER (PARTITION BY cluster ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS padj, row_number() OVER (PARTITION BY cluster ORDER BY zr DESC, gene) AS rank FROM q QUALIFY rank <= 100""",
    "cluster rank gene",
    "zr log2fc pval padj",
)
def rank_genes_groups(spark, d):
    return markers.rank_genes_groups(tables.from_tables(spark, d), "cluster")


@query(
    f"""{_DATA}{_EVERY.format(g='cluster')}, j AS (SELECT *, (SELECT count(*) FROM obs) - n AS no, greatest(s2 - s1 * s1 / n, 0) / (n - 1) AS v1, t1 - s1 AS o1, t2 - s2 AS o2 FROM em),
    k AS (SELECT *, v1 / n + greatest(o2 - o1 * o1 / no, 0) / (no - 1) / no AS se FROM j)--
    SELECT cluster, gene, CASE WHEN sqrt(se) <> 0 THEN (mean - o1 / no) / sqrt(se) END AS t, mean AS mean_in, o1 / no AS mean_out FROM k""",
    "cluster gene",
    "t mean_in mean_out",
)
def welch_test(spark, d):
    return markers.welch(tables.from_tables(spark, d), "cluster")


@query(
    f"""{_DATA}{_RANKS}, p AS (SELECT *, nnz_in / n_in AS pct_in, nnz_out / n_out AS pct_out, {_P} AS pvalue FROM rs WHERE nnz_in / n_in >= 0.001 AND log2fc >= log2(1.05)), q AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY pvalue, gene) AS r, count(*) OVER (PARTITION BY cluster) AS m FROM p),
    a AS (SELECT *, least(1.0, min(pvalue * m / r) OVER (PARTITION BY cluster ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS fdr FROM q)--\nSELECT *, -log10(fdr + 1e-300) * log2fc * pct_in AS score FROM a WHERE fdr <= 0.9995""",
    "cluster gene",
    "pct_in pct_out log2fc pvalue fdr score",
)
def find_all_markers(spark, d):
    """Bounds that the sparse counts of these tables reach; the defaults are stricter."""
    return markers.find_all_markers(tables.from_tables(spark, d), "cluster", min_fold_change=1.05, min_pct=0.001, max_pvalue=0.9995)


@query(
    f"""{_DATA}{_RANKS}, o AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY mean_in DESC, cluster) AS k FROM rs), t AS (SELECT gene, max(mean_in) FILTER (k = 1) AS m1, max(mean_in) FILTER (k = 2) AS m2 FROM o GROUP BY 1)--
    SELECT cluster, gene, u / (n_in * n_out) AS auroc, CASE WHEN CASE WHEN k = 1 THEN m2 ELSE m1 END <> 0 THEN mean_in / CASE WHEN k = 1 THEN m2 ELSE m1 END END AS specificity FROM o JOIN t USING (gene)""",
    "cluster gene",
    "auroc specificity",
)
def marker_specificity(spark, d):
    return markers.marker_specificity(tables.from_tables(spark, d), "cluster")


_DOT = """, s AS (SELECT gset, count(*) AS n_genes FROM var GROUP BY 1), o AS (SELECT cluster, count(*) AS n_cells FROM obs GROUP BY 1)--
    SELECT cluster, gset, sum(value) / (n_cells * n_genes) AS mean, count(*) FILTER (value > 0) / (n_cells * n_genes) AS fraction FROM norm JOIN obs USING (cell) JOIN var USING (gene) JOIN s USING (gset) JOIN o USING (cluster) GROUP BY 1, 2, n_cells, n_genes"""


@query(_NORM + _DOT, "cluster gset", "mean fraction")
def dotplot(spark, d):
    return markers.dotplot(_norm(spark, d), "cluster", "gset")


_SCORE = f"""{_NORM}{_EMOM.format(t='norm')}, nv AS (SELECT count(*) AS n FROM var), bn AS (SELECT least(25, n) AS bins, greatest(1, n // least(25, n)) AS width FROM nv),
    g AS (SELECT gene, least(bins - 1, (row_number() OVER (ORDER BY round(mean, 9), gene) - 1) // width) AS bin FROM emom, bn), own AS (SELECT g.gene, bin, gset FROM g JOIN var USING (gene)),
    sets AS (SELECT DISTINCT gset FROM var WHERE gset IS NOT NULL),
    others AS (SELECT sets.gset, own.bin, own.gene, row_number() OVER (PARTITION BY sets.gset, own.bin ORDER BY md5('0:' || sets.gset || ':' || own.gene), own.gene) - 1 AS place, count(*) OVER (PARTITION BY sets.gset, own.bin) AS m
      FROM own JOIN sets ON own.gset IS DISTINCT FROM sets.gset),
    sz AS (SELECT gset, bin, max(m) AS m FROM others GROUP BY 1, 2),
    taken AS (SELECT DISTINCT gset, bin, (h % m + j) % m AS place FROM (SELECT own.gset, own.bin, sz.m, ('0x' || substr(md5('0:' || own.gene), 1, 8))::BIGINT AS h, unnest(range(0, least(50, sz.m))) AS j FROM own JOIN sz ON sz.gset = own.gset AND sz.bin = own.bin)),
    ctrl AS (SELECT others.gset, others.gene FROM taken JOIN others ON others.gset = taken.gset AND others.bin = taken.bin AND others.place = taken.place),
    w AS (SELECT gset, gene, 1.0 / count(*) OVER (PARTITION BY gset) AS w FROM own WHERE gset IS NOT NULL UNION ALL SELECT gset, gene, -1.0 / count(*) OVER (PARTITION BY gset) FROM ctrl),
    st AS (SELECT cell, w.gset, sum(value * w) AS s FROM norm JOIN w USING (gene) GROUP BY 1, 2),
    sc AS (SELECT obs.cell, sets.gset, coalesce(s, 0) AS score FROM obs CROSS JOIN sets LEFT JOIN st ON st.cell = obs.cell AND st.gset = sets.gset)"""


@query(f"{_SCORE}--\nSELECT * FROM sc", "cell gset", "score")
def score_genes(spark, d):
    return markers.gene_set_score(_norm(spark, d), "gset")


@query(
    f"""{_SCORE}, p AS (SELECT cell, coalesce(max(score) FILTER (gset = 'Brand#1'), 0) AS s_score, coalesce(max(score) FILTER (gset = 'Brand#2'), 0) AS g2m_score FROM sc WHERE gset IN ('Brand#1', 'Brand#2') GROUP BY 1)--
    SELECT *, CASE WHEN s_score > g2m_score AND s_score > 0 THEN 'S' WHEN g2m_score > s_score AND g2m_score > 0 THEN 'G2M' ELSE 'G1' END AS phase FROM p""",
    "cell phase",
    "s_score g2m_score",
)
def score_cell_cycle(spark, d):
    return markers.phase_calls(markers.gene_set_score(_norm(spark, d), "gset"), "Brand#1", "Brand#2", "gset")


@query(
    f"""{_DATA}{_MOM.format(t='counts')}{_GMOM.format(t='counts', g='batch')}--
    SELECT gene, CASE WHEN m.s2 - m.s1 * m.s1 / m.n <> 0 THEN (b - m.s1 * m.s1 / m.n) / (m.s2 - m.s1 * m.s1 / m.n) END AS eta2 FROM mom m JOIN (SELECT gene, sum(s1 * s1 / n) AS b FROM gmom GROUP BY 1) USING (gene)""",
    "gene",
    "eta2",
)
def variance_partition(spark, d):
    return markers.variance_partition(tables.from_tables(spark, d), "batch")


_TOPVAR = """, tv AS (SELECT * FROM emom ORDER BY round(v0, 9) DESC, gene LIMIT {n}), met AS (SELECT a.gene, b.gene AS g2, sum(a.value * b.value) AS sxy FROM (SELECT c.* FROM counts c SEMI JOIN obs USING (cell) SEMI JOIN tv USING (gene)) a
    JOIN (SELECT c.* FROM counts c SEMI JOIN tv USING (gene)) b ON a.cell = b.cell AND a.gene < b.gene GROUP BY 1, 2),
    cr AS (SELECT a.gene, b.gene AS g2, CASE WHEN a.v0 * b.v0 > 0 THEN (coalesce(sxy, 0) / a.n - a.mean * b.mean) / sqrt(a.v0 * b.v0) END AS r FROM tv a JOIN tv b ON a.gene < b.gene LEFT JOIN met ON met.gene = a.gene AND met.g2 = b.gene)"""


@query(f"{_DATA}{_EMOM.format(t='counts')}{_TOPVAR.format(n=50)}--\nSELECT * FROM cr", "gene g2", "r")
def correlation_matrix(spark, d):
    return markers.gene_correlation(tables.from_tables(spark, d))


@query(
    f"""{_DATA}{_EVERY.format(g='condition')}--\nSELECT a.condition, a.gene, a.mean - b.mean AS shift, log2((a.mean + 1e-9) / (b.mean + 1e-9)) AS log2fc FROM em a JOIN em b ON b.gene = a.gene AND b.condition = 'F' WHERE a.condition <> 'F'""",
    "condition gene",
    "shift log2fc",
)
def perturbation_signature(spark, d):
    return markers.perturbation_signature(tables.from_tables(spark, d), "condition", "F")


_TOP = f"""{_DATA}{_RANKS}, p AS (SELECT cluster, gene, row_number() OVER (PARTITION BY cluster ORDER BY round(z, 6) DESC, gene) AS rank FROM rs QUALIFY rank <= 50)"""


_LC = "lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0)"


@query(
    f"""{_TOP.replace("rank <= 50", "rank <= 200")}, t AS (SELECT cluster, gset FROM p JOIN var USING (gene)), a AS (SELECT cluster, gset, count(*) AS a FROM t GROUP BY 1, 2), k AS (SELECT gset, count(*) AS k FROM var WHERE gset IS NOT NULL GROUP BY 1), m AS (SELECT cluster, count(*) AS m FROM t GROUP BY 1),
    e AS (SELECT m.cluster, k.gset, coalesce(a, 0) AS a, m, k, n, m - coalesce(a, 0) AS b, k - coalesce(a, 0) AS c, n - m - k + coalesce(a, 0) AS dd FROM m CROSS JOIN k CROSS JOIN (SELECT count(*) AS n FROM var) LEFT JOIN a ON a.cluster = m.cluster AND a.gset = k.gset),
    f AS (SELECT cluster, gset, a AS overlap, CASE WHEN b * c > 0 THEN a * dd / (b * c) WHEN a > 0 THEN 'Infinity'::DOUBLE ELSE 0 END AS odds_ratio,
      CASE WHEN a = 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(a, least(m, k) + 1), lambda i: exp({_LC.format(n='k', k='i')} + {_LC.format(n='(n - k)', k='(m - i)')} - ({_LC.format(n='n', k='m')}))))) END AS pvalue FROM e),
    r AS (SELECT *, row_number() OVER (ORDER BY pvalue, cluster, gset) AS r, count(*) OVER () AS nt FROM f)--
    SELECT *, least(1.0, min(pvalue * nt / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS fdr FROM r""",
    "cluster gset overlap",
    "odds_ratio pvalue fdr",
)
def gene_set_enrichment(spark, d):
    return markers.set_enrichment(tables.from_tables(spark, d), "cluster", "gset")


@query(
    f"""{_TOP}, b AS (SELECT gtype, count(*) AS nb FROM var GROUP BY 1)--\nSELECT cluster, gtype, count(*) AS shared, count(*) / (50 + nb - count(*)) AS jaccard FROM p JOIN var USING (gene) JOIN b USING (gtype) GROUP BY 1, 2, nb""",
    "cluster gtype shared",
    "jaccard",
)
def marker_gene_overlap(spark, d):
    x = tables.from_tables(spark, d)
    return markers.marker_overlap(markers.rank_genes_groups(x, "cluster", 50), x.var, "cluster", "gtype")


@query(f"{_DATA}--\nSELECT condition, cluster, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY condition) AS proportion FROM obs GROUP BY 1, 2", "condition cluster n", "proportion")
def cell_type_proportions(spark, d):
    return markers.proportions(tables.from_tables(spark, d).obs, "cluster", "condition")


_COMP = f"""{_DATA}, sz AS (SELECT condition, count(*) AS n FROM obs GROUP BY 1), x AS (SELECT sz.condition, cl.cluster, n, coalesce(k, 0) AS k FROM sz CROSS JOIN (SELECT DISTINCT cluster FROM obs) cl LEFT JOIN (SELECT condition, cluster, count(*) AS k FROM obs GROUP BY 1, 2) c ON c.condition = sz.condition AND c.cluster = cl.cluster),
    y AS (SELECT a.condition, a.cluster, a.k, a.n, b.k AS rk, b.n AS rn, (a.k + b.k) / (a.n + b.n) AS pool FROM x a JOIN x b ON b.cluster = a.cluster AND b.condition = 'F' WHERE a.condition <> 'F'),
    zz AS (SELECT *, CASE WHEN sqrt(pool * (1 - pool) * (1 / n + 1 / rn)) <> 0 THEN (k / n - rk / rn) / sqrt(pool * (1 - pool) * (1 / n + 1 / rn)) END AS z, sign(k - n * pool) * greatest(abs(k - n * pool) - 0.5, 0) AS h FROM y),
    tt AS (SELECT *, [n * pool + h, n * (1 - pool) - h, rn * pool - h, rn * (1 - pool) + h] AS o, [n * pool, n * (1 - pool), rn * pool, rn * (1 - pool)] AS e FROM zz),
    gg AS (SELECT *, sqrt(greatest(0, 2 * list_sum(list_transform(list_zip(o, e), lambda q: CASE WHEN q[1] > 0 THEN q[1] * ln(q[1] / q[2]) ELSE 0 END)))) AS g FROM tt),
    pp AS (SELECT condition, cluster, k / n AS proportion, CASE WHEN rk <> 0 THEN (k / n) / (rk / rn) END AS fold, z, CASE WHEN pool > 0 AND pool < 1 THEN {{p}} ELSE 1 END AS pvalue FROM gg),
    qq AS (SELECT *, row_number() OVER (ORDER BY pvalue, condition, cluster) AS r, count(*) OVER () AS m FROM pp)--\nSELECT *, least(1.0, min(pvalue * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS fdr FROM qq"""


@query(_COMP.format(p=_P), "condition cluster", "proportion fold z pvalue fdr")
def composition_prop_test(spark, d):
    return markers.composition(tables.from_tables(spark, d).obs, "cluster", "condition", "F", "prop_test")


@query(_COMP.format(p=_TAIL.format(z="g", t="(1 / (1 + 0.2316419 * g))")), "condition cluster", "proportion fold z pvalue fdr")
def composition_analysis(spark, d):
    return markers.composition(tables.from_tables(spark, d).obs, "cluster", "condition", "F")


@query(
    f"""{_DATA}{_GMOM.format(t='counts', g='cluster')}--\nSELECT p.l AS ligand, p.r AS receptor, a.cluster AS sender, b.cluster AS receiver, a.mean * b.mean AS score FROM (VALUES (1, 2), (3, 4), (10, 20)) p(l, r) JOIN gmom a ON a.gene = l JOIN gmom b ON b.gene = r""",
    "ligand receptor sender receiver",
    "score",
)
def cell_communication(spark, d):
    pairs = spark.createDataFrame([(1, 2), (3, 4), (10, 20)], "ligand bigint, receptor bigint")
    return markers.communication(tables.from_tables(spark, d), "cluster", pairs)


# vectors


def _nn(spark, d):
    v = tables.vectors(spark, d)
    return v, vectors.knn(v, v, 10)


@query(f"{_KNN}--\nSELECT * FROM nn", "cell neighbour rank", "distance")
def neighbors(spark, d):
    return _nn(spark, d)[1]


@query(f"{_CENT}--\nSELECT x.label AS a, y.label AS b, list_distance(x.centre, y.centre) AS distance FROM c x JOIN c y ON x.label < y.label", "a b", "distance")
def cell_distances(spark, d):
    return vectors.centroid_distances(tables.vectors(spark, d), "label")


@query(
    f"""{_CENT}, e AS (SELECT v.cell, v.label, c.label AS g, list_distance(v.vec, c.centre) AS d FROM v, c)--
    SELECT cell, label, max(d) FILTER (g = label) AS own, min(d) FILTER (g <> label) AS other, max(d) FILTER (g = label) / min(d) FILTER (g <> label) AS ratio FROM e GROUP BY 1, 2""",
    "cell label",
    "own other ratio",
)
def cluster_confidence(spark, d):
    return vectors.own_and_other_centroid(tables.vectors(spark, d), "label")


@query(
    f"""{_CENT}, g AS (SELECT label, i, sum(x) AS s1, sum(x * x) AS s2, count(*) AS n FROM u GROUP BY 1, 2), t AS (SELECT i, sum(s1) AS t1, sum(s2) AS t2, sum(s1 * s1 / n) AS b, sum(n) AS n, count(*) AS k FROM g GROUP BY 1)--
    SELECT (sum(b - t1 * t1 / n) / (max(k) - 1)) / (sum(t2 - b) / (max(n) - max(k))) AS score FROM t""",
    "",
    "score",
)
def calinski_harabasz_score(spark, d):
    return vectors.calinski_harabasz(tables.vectors(spark, d), "label")


@query(
    f"""{_VEC}, p AS (SELECT a.cell, a.label, b.label AS o, sum(sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) ** 2)))) AS s, count(*) AS n FROM v a, v b GROUP BY 1, 2, 3),
    q AS (SELECT cell, label, max(CASE WHEN n > 1 THEN s / (n - 1) END) FILTER (o = label) AS a, min(s / n) FILTER (o <> label) AS b FROM p GROUP BY 1, 2)--\nSELECT cell, label, coalesce((b - a) / greatest(a, b), 0) AS silhouette FROM q""",
    "cell label",
    "silhouette",
)
def silhouette_score(spark, d):
    return vectors.silhouette(tables.vectors(spark, d), "label")


@query(
    f"""{_KNN}, w AS (SELECT nn.cell, l.label, sum(1 / (distance + 1e-10)) AS w FROM nn JOIN v l ON l.cell = neighbour GROUP BY 1, 2), s AS (SELECT cell, label, round(w / sum(w) OVER (PARTITION BY cell), 9) AS confidence FROM w)--
    SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY cell ORDER BY confidence DESC, label) = 1""",
    "cell label",
    "confidence",
)
def transfer_labels(spark, d):
    v, nn = _nn(spark, d)
    return vectors.transfer_labels(nn, v)


@query(
    f"{_KNN}, w AS (SELECT nn.cell, l.label, count(*) / 10 AS p FROM nn JOIN v l ON l.cell = neighbour GROUP BY 1, 2)--\nSELECT cell, sum(-p * log2(p)) AS entropy, 1 / sum(p * p) AS lisi FROM w GROUP BY 1",
    "cell",
    "entropy lisi",
)
def entropy_and_lisi(spark, d):
    v, nn = _nn(spark, d)
    return vectors.neighbour_mix(nn, v)


@query(
    f"""{_KNN}, e AS (SELECT least(a.label, b.label) AS a, greatest(a.label, b.label) AS b, count(*) AS edges FROM nn JOIN v a ON a.cell = nn.cell JOIN v b ON b.cell = neighbour WHERE a.label <> b.label GROUP BY 1, 2), s AS (SELECT label, count(*) AS n FROM v GROUP BY 1)--
    SELECT a, b, edges, edges / (2 * x.n * y.n) AS connectivity FROM e JOIN s x ON x.label = a JOIN s y ON y.label = b""",
    "a b edges",
    "connectivity",
)
def paga_connectivities(spark, d):
    v, nn = _nn(spark, d)
    return vectors.group_edges(nn, v)


@query(
    f"""{_KNN}--\nSELECT e.cell, e.neighbour, count(*) AS shared, count(*) / (20 - count(*)) AS weight FROM nn e JOIN nn x ON x.cell = e.cell JOIN nn y ON y.cell = e.neighbour AND y.neighbour = x.neighbour GROUP BY 1, 2""",
    "cell neighbour shared",
    "weight",
)
def phenograph_edges(spark, d):
    return vectors.shared_neighbours(_nn(spark, d)[1], 10)


@query(f"{_KNN}, val AS (SELECT cell, vec[1] AS value FROM v)--\nSELECT nn.cell, sum(value / (distance + 1e-10)) / sum(1 / (distance + 1e-10)) AS imputed FROM nn JOIN val ON val.cell = neighbour GROUP BY 1", "cell", "imputed")
def knn_impute(spark, d):
    v, nn = _nn(spark, d)
    return vectors.impute(nn, v.select("cell", F.col("vec")[0].cast("double").alias("value")))


@query(
    f"""{_KNN}, val AS (SELECT cell, vec[1] - avg(vec[1]) OVER () AS z FROM v)--\nSELECT avg(a.z * b.z) / (SELECT avg(z * z) FROM val) AS moran FROM nn JOIN val a ON a.cell = nn.cell JOIN val b ON b.cell = neighbour""",
    "",
    "moran",
)
def morans_i(spark, d):
    v, nn = _nn(spark, d)
    return vectors.morans_i(nn, v.select("cell", F.col("vec")[0].cast("double").alias("value")))


@query(
    f"""{_VEC}, d AS (SELECT a.cell AS x, b.cell AS y, round(list_distance(a.vec, b.vec), 9) AS distance FROM v a, v b WHERE a.cell % 2 = 0 AND b.cell % 2 = 1),
    p AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY distance, y) AS k, row_number() OVER (PARTITION BY y ORDER BY distance, x) AS m FROM d)--\nSELECT x AS cell, y AS neighbour, distance FROM p WHERE k <= 10 AND m <= 10""",
    "cell neighbour",
    "distance",
)
def mutual_nearest_neighbours(spark, d):
    v = tables.vectors(spark, d)
    a, b = v.where("cell % 2 = 0"), v.where("cell % 2 = 1")
    return vectors.mutual_neighbours(vectors.knn(a, b, 10), vectors.knn(b, a, 10))


@query()
def pca(spark, d):
    """First two principal axes; tested against numpy."""
    scores, _ = vectors.pca(tables.vectors(spark, d), 2)
    return scores.select("cell", F.col("vec")[0].alias("pc1"), F.col("vec")[1].alias("pc2"))


# reads


_READS = "WITH r AS (SELECT user_id AS cell, event_type AS feature, event_id // 3 AS umi FROM events)"


def _reads(spark, d):
    return tables.events(spark, d).select(F.col("user_id").alias("cell"), F.col("event_type").alias("feature"), F.expr("event_id div 3").alias("umi"))


@query(f"{_READS}, m AS (SELECT cell, feature, umi, count(*) AS reads FROM r GROUP BY 1, 2, 3)--\nSELECT cell, feature, count(*) AS molecules, sum(reads)::BIGINT AS reads FROM m GROUP BY 1, 2", "cell feature molecules reads")
def umi_counts(spark, d):
    return reads.count_molecules(_reads(spark, d))


@query(f"{_READS}--\nSELECT cell, count(DISTINCT (feature, umi)) AS molecules, count(*) AS reads, 1 - count(DISTINCT (feature, umi)) / count(*) AS saturation FROM r GROUP BY 1", "cell molecules reads", "saturation")
def sequencing_saturation(spark, d):
    return reads.saturation(_reads(spark, d))


@query("WITH t AS (SELECT user_id, count(*) AS total FROM events GROUP BY 1)--\nSELECT total, count(*) AS barcodes, (sum(count(*)) OVER (ORDER BY total DESC ROWS UNBOUNDED PRECEDING))::BIGINT AS rank FROM t GROUP BY 1", "total barcodes rank")
def barcode_rank(spark, d):
    return reads.barcode_rank(tables.events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("total")))


@query(
    """WITH o AS (SELECT o_orderkey % 4096 AS code, count(*) AS reads FROM orders GROUP BY 1), w AS (SELECT unnest(range(0, 4096, 37)) AS code), ex AS (SELECT code, code AS corrected, reads FROM o SEMI JOIN w USING (code)),
    nb AS (SELECT o.code, w.code AS corrected, o.reads, coalesce(ex.reads, 0) AS support FROM o ANTI JOIN w USING (code) JOIN w ON bit_count(((xor(o.code, w.code)) | (xor(o.code, w.code) >> 1)) & 1365) = 1 LEFT JOIN ex ON ex.corrected = w.code)--
    SELECT code, corrected, reads FROM ex UNION ALL SELECT code, corrected, reads FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY support DESC, corrected) AS k FROM nb) WHERE k = 1""",
    "code corrected reads",
)
def correct_barcodes(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").groupBy((F.col("o_orderkey") % 4096).alias("code")).agg(F.count(F.lit(1)).alias("reads"))
    return reads.correct_barcodes(o, spark.range(0, 4096, 37).withColumnRenamed("id", "code"), 6)


@query(
    """WITH f AS (SELECT p_partkey AS id, p_brand AS chrom, p_partkey * 10 AS s, p_partkey * 10 + p_size * 30 AS e FROM part), r AS (SELECT s_suppkey AS id, 'Brand#' || s_suppkey % 25 AS chrom, s_suppkey * 150 AS s, s_suppkey * 150 + 900 AS e FROM supplier)--
    SELECT f.id, r.id AS region, least(f.e, r.e) - greatest(f.s, r.s) AS bases FROM f JOIN r USING (chrom) WHERE f.s < r.e AND r.s < f.e AND f.s < f.e""",
    "id region bases",
)
def interval_overlap(spark, d):
    f = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("chrom"), (F.col("p_partkey") * 10).alias("start"), (F.col("p_partkey") * 10 + F.col("p_size") * 30).alias("end"))
    k = F.col("s_suppkey")
    r = spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("id"), F.concat(F.lit("Brand#"), (k % 25).cast("string")).alias("chrom"), (k * 150).alias("start"), (k * 150 + 900).alias("end"))
    return reads.overlap(f, r, 500)


@query(f"{_DATA}, x AS (SELECT cell, gene, value / p_size AS rate FROM counts JOIN part ON p_partkey = gene)--\nSELECT cell, gene, rate / sum(rate) OVER (PARTITION BY cell) * 1e6 AS tpm FROM x", "cell gene", "tpm")
def tpm(spark, d):
    lengths = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("gene"), F.col("p_size").alias("length"))
    return reads.tpm(tables.from_tables(spark, d).counts, lengths)


@query(
    """WITH t AS (SELECT user_id AS cell, event_type AS tag, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events GROUP BY 1, 2),
    c AS (SELECT cell, max(tag) FILTER (k = 1) AS tag, max(n) FILTER (k = 1) AS first, coalesce(max(n) FILTER (k = 2), 0) AS second FROM t GROUP BY 1)--
    SELECT cell, CASE WHEN first < 15 THEN 'negative' WHEN second > 0.8 * first THEN 'doublet' ELSE tag END AS call, first, second FROM c""",
    "cell call first second",
)
def hashtag_demultiplex(spark, d):
    tags = tables.events(spark, d).groupBy(F.col("user_id").alias("cell"), F.col("event_type").alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    return reads.demultiplex(tags, 15, 0.8)


@query(
    """WITH c AS (SELECT l_orderkey AS cell, sum(CASE WHEN l_partkey % 3 > 0 THEN l_quantity ELSE 0 END) AS human, sum(CASE WHEN l_partkey % 3 = 0 THEN l_quantity ELSE 0 END) AS mouse FROM lineitem GROUP BY 1)--
    SELECT cell, human, mouse, CASE WHEN human / (human + mouse) >= 0.9 THEN 'human' WHEN mouse / (human + mouse) >= 0.9 THEN 'mouse' ELSE 'mixed' END AS species FROM c""",
    "cell species",
    "human mouse",
)
def barnyard_species(spark, d):
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    return reads.species_calls(line.select(F.col("l_orderkey").alias("cell"), F.when(F.col("l_partkey") % 3 > 0, "human").otherwise("mouse").alias("genome"), F.col("l_quantity").alias("n")), 0.9)


_EDGES = "e AS (SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey > 0)"


@query(f"WITH RECURSIVE {_EDGES}, r(term, ancestor) AS (SELECT child, child FROM e UNION SELECT 0, 0 UNION SELECT r.term, e.parent FROM r JOIN e ON e.child = r.ancestor)--\nSELECT * FROM r", "term ancestor")
def ontology_closure(spark, d):
    return reads.descendants(spark.read.parquet(f"{d}/part.parquet").where("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 3").alias("parent")))


# events


@query("--\nSELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2", "start event_type n", "total")
def tumbling_windows(spark, d):
    return ev.tumbling(tables.events(spark, d), "1 hour", "event_type")


@query("--\nSELECT start - to_hours(k) AS start, count(*) AS n, sum(value) AS total FROM (SELECT date_trunc('hour', ts) AS start, value, unnest(range(3)) AS k FROM events) GROUP BY 1", "start n", "total")
def sliding_windows(spark, d):
    return ev.sliding(tables.events(spark, d), "3 hours", "1 hour")


@query(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)--
    SELECT min(ts) AS start, user_id, count(*) AS n, sum(value) AS total FROM s GROUP BY user_id, k""",
    "start user_id n",
    "total",
)
def session_windows(spark, d):
    return ev.sessions(tables.events(spark, d), "1 hour", "user_id")
