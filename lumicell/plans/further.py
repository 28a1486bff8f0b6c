"""More queries, registered beside those of `queries`: scores, graphs, tags and guides, receptors, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import nearest
from ..operators import graphs, markers, receptors, scores, tags, vectors
from ..operators import catalog as cat
from ..sources import tables
from .queries import _CENT, _DATA, _EMOM, _KNN, _NORM, _P, _RANKS, _TOPVAR, _VEC, _nn, _norm, query

# scores of cells and groups


@query(
    f"""{_DATA}{_EMOM.format(t='counts')}, pr AS (SELECT gene, mean AS p FROM emom, (SELECT max(v0) AS most FROM emom) ORDER BY round(1 - nnz / n - CASE WHEN most > 0 THEN v0 / most ELSE v0 END, 9) DESC, gene LIMIT 100),
    dt AS (SELECT cell, sum(value * coalesce(p, 0)) AS dot, sqrt(sum(value * value)) AS own FROM counts LEFT JOIN pr USING (gene) GROUP BY 1), sz AS (SELECT sqrt(sum(p * p)) AS size FROM pr)--
    SELECT obs.cell, greatest(0.0, least(1.0, coalesce(CASE WHEN own * size <> 0 THEN dot / (own * size) END, 0))) AS score FROM obs CROSS JOIN sz LEFT JOIN dt USING (cell)""",
    "cell",
    "score",
)
def ambient_rna_score(spark, d):
    return scores.ambient_score(tables.from_tables(spark, d))


_LINEAGE = f"""{_DATA}, ls AS (SELECT gset, count(*) AS n FROM var WHERE gset IS NOT NULL GROUP BY 1), lm AS (SELECT cell, gset, sum(value) / n AS m FROM counts JOIN var USING (gene) JOIN ls USING (gset) GROUP BY cell, gset, n),
    lp AS (SELECT cell, gset, m, m / sum(m) OVER (PARTITION BY cell) AS p FROM lm WHERE m > 0), la AS (SELECT cell, sum(-p * ln(p)) AS e, list_sort(list(p), 'DESC') AS ps FROM lp GROUP BY 1),
    lt AS (SELECT cell, gset FROM lp QUALIFY row_number() OVER (PARTITION BY cell ORDER BY round(m, 9) DESC, gset) = 1), lx AS (SELECT obs.cell, coalesce({{score}}, 0) AS score, coalesce(lt.gset, (SELECT min(gset) FROM ls)) AS top_lineage
    FROM obs LEFT JOIN la USING (cell) LEFT JOIN lt USING (cell))--\nSELECT *, score >= 0.3 AS is_bipotent FROM lx"""


@query(_LINEAGE.format(score="e / ln((SELECT count(*) FROM ls))"), "cell top_lineage is_bipotent", "score")
def bipotent_entropy(spark, d):
    return scores.bipotent(tables.from_tables(spark, d), "gset")


@query(_LINEAGE.format(score="coalesce(ps[2], 0) / ps[1]").replace("SELECT *, score >=", "SELECT * REPLACE (score + 1e-9 AS score), score >="), "cell top_lineage is_bipotent", "score")
def bipotent_score_ratio(spark, d):
    """The score is moved off the ties of rounding, where shares are ratios of small integers."""
    return scores.bipotent(tables.from_tables(spark, d), "gset", method="score_ratio").withColumn("score", F.col("score") + 1e-9)


for _method, _weight, _off in (
    ("mean", "1.0 / k", "0"), ("weighted", "CASE WHEN tv > 0 THEN v0 / tv ELSE 1.0 / k END", "0"), ("z-score", "1.0 / (k * CASE WHEN v0 > 0 THEN sqrt(v0) ELSE 1 END)", "mean / (k * CASE WHEN v0 > 0 THEN sqrt(v0) ELSE 1 END)")
):

    def _activity(spark, d, method=_method):
        return scores.activity(_norm(spark, d), "gset", method)

    _activity.__name__ = f"gene_activity_{_method.replace('-', '_')}"
    query(
        f"""{_NORM}{_EMOM.format(t='norm')}, w AS (SELECT gene, gset, {_weight} AS w, {_off} AS off FROM (SELECT e.*, gset, count(*) OVER (PARTITION BY gset) AS k, sum(v0) OVER (PARTITION BY gset) AS tv FROM emom e JOIN var USING (gene) WHERE gset IS NOT NULL)),
        ss AS (SELECT gset, sum(off) AS off FROM w GROUP BY 1), sc AS (SELECT cell, gset, sum(value * w) AS s FROM norm JOIN w USING (gene) GROUP BY 1, 2), x AS (SELECT obs.cell, ss.gset, coalesce(s, 0) - off AS score FROM obs CROSS JOIN ss LEFT JOIN sc ON sc.cell = obs.cell AND sc.gset = ss.gset)--
        SELECT cell, gset, CASE WHEN stddev_pop(score) OVER g > 1e-12 THEN (score - avg(score) OVER g) / stddev_pop(score) OVER g ELSE score END AS score FROM x WINDOW g AS (PARTITION BY gset)""",
        "cell gset",
        "score",
    )(_activity)


_GPCT = """, gr AS (SELECT cluster, count(*) AS n FROM obs GROUP BY 1), gv AS (SELECT cluster, gene, sum(value) AS s, count(value) AS nnz FROM counts JOIN obs USING (cell) GROUP BY 1, 2),
    ge AS (SELECT gr.cluster, var.gene, coalesce(s, 0) / n AS mean, coalesce(nnz, 0) / n AS pct FROM gr CROSS JOIN var LEFT JOIN gv ON gv.cluster = gr.cluster AND gv.gene = var.gene)"""


@query(
    f"""{_DATA}{_EMOM.format(t='counts')}{_GPCT}, an AS (SELECT cluster, gset, round(avg(pct) * ln(1 + avg(ge.mean / CASE WHEN e.mean <> 0 THEN e.mean ELSE 1e-10 END)), 9) AS score FROM ge JOIN emom e USING (gene) JOIN var USING (gene) WHERE gset IS NOT NULL GROUP BY 1, 2),
    b AS (SELECT * FROM an QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY score DESC, gset) = 1)--\nSELECT cluster, CASE WHEN score >= 0.001 AND score > 0 THEN gset ELSE 'Unknown' END AS cell_type, CASE WHEN score >= 0.001 AND score > 0 THEN score ELSE 0 END AS score FROM b""",
    "cluster cell_type",
    "score",
)
def annotate_cell_types(spark, d):
    return scores.annotate(tables.from_tables(spark, d), "cluster", "gset", 0.001)


@query(
    f"""{_DATA}{_RANKS}, p AS (SELECT cluster, gene, round(z, 6) AS zr, log2fc, {_P} AS pval FROM rs), q AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY pval, gene) AS r, count(*) OVER (PARTITION BY cluster) AS n FROM p),
    s AS (SELECT cluster, gene, zr, log2fc, least(1.0, min(pval * n / r) OVER (PARTITION BY cluster ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS padj, row_number() OVER (PARTITION BY cluster ORDER BY zr DESC, gene) AS rank FROM q QUALIFY rank <= 100)--
    SELECT cluster, rank, CASE WHEN padj <= 0.9 AND abs(log2fc) >= 0.5 THEN gene END AS gene, CASE WHEN padj <= 0.9 AND abs(log2fc) >= 0.5 THEN zr ELSE 0 END AS zr FROM s""",
    "cluster rank gene",
    "zr",
)
def filter_rank_genes_groups(spark, d):
    ranked = markers.rank_genes_groups(tables.from_tables(spark, d), "cluster")
    return scores.filter_ranked(ranked, 0.5, 0.9).select("cluster", "rank", "gene", "zr")


@query(
    f"""WITH {{0}}, a AS (SELECT l_orderkey AS cell, l_partkey AS gene, sum(l_quantity) AS value FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2), b AS (SELECT l_orderkey AS cell, l_partkey AS gene, sum(l_quantity) AS value FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2),
    gc AS (SELECT cluster, count(*) AS n FROM obs GROUP BY 1), gb AS (SELECT condition, count(*) AS n FROM obs GROUP BY 1), nv AS (SELECT count(*) AS n FROM part),
    x AS (SELECT cluster AS a, gene, sum(value) / max(gc.n) AS x FROM a JOIN obs USING (cell) JOIN gc USING (cluster) GROUP BY 1, 2), y AS (SELECT condition AS b, gene, sum(value) / max(gb.n) AS y FROM b JOIN obs USING (cell) JOIN gb USING (condition) GROUP BY 1, 2),
    sx AS (SELECT a, sum(x) AS sx, sum(x * x) AS qx FROM x GROUP BY 1), sy AS (SELECT b, sum(y) AS sy, sum(y * y) AS qy FROM y GROUP BY 1), xy AS (SELECT a, b, sum(x * y) AS xy FROM x JOIN y USING (gene) GROUP BY 1, 2)--
    SELECT a, b, (coalesce(xy, 0) - sx * sy / n) / (sqrt(qx - sx * sx / n) * sqrt(qy - sy * sy / n)) AS r FROM sx CROSS JOIN sy CROSS JOIN nv LEFT JOIN xy USING (a, b)""".replace("{0}", _DATA[_DATA.index("obs AS") : _DATA.index(", var AS")]),
    "a b",
    "r",
)
def cross_species_correlation(spark, d):
    x = tables.from_tables(spark, d)
    return scores.profile_correlation(x.with_counts(tables.layer(spark, d, "F")), x.with_counts(tables.layer(spark, d, "O")), "cluster", "condition")


@query(
    f"""{_DATA}{_EMOM.format(t='counts')}, tv AS (SELECT * FROM emom ORDER BY round(v0, 9) DESC, gene LIMIT 500), k1 AS (SELECT gene, sum(s * s / n) AS b FROM (SELECT gene, batch, sum(value) AS s FROM counts JOIN obs USING (cell) GROUP BY 1, 2) JOIN (SELECT batch, count(*) AS n FROM obs GROUP BY 1) USING (batch) GROUP BY 1),
    k2 AS (SELECT gene, sum(s * s / n) AS b FROM (SELECT gene, cluster, sum(value) AS s FROM counts JOIN obs USING (cell) GROUP BY 1, 2) JOIN (SELECT cluster, count(*) AS n FROM obs GROUP BY 1) USING (cluster) GROUP BY 1),
    e AS (SELECT tv.gene, CASE WHEN s2 - s1 * s1 / n <> 0 THEN (coalesce(k1.b, 0) - s1 * s1 / n) / (s2 - s1 * s1 / n) ELSE 0 END AS eta2_batch, CASE WHEN s2 - s1 * s1 / n <> 0 THEN (coalesce(k2.b, 0) - s1 * s1 / n) / (s2 - s1 * s1 / n) ELSE 0 END AS eta2_cluster
    FROM tv LEFT JOIN k1 ON k1.gene = tv.gene LEFT JOIN k2 ON k2.gene = tv.gene)--\nSELECT *, 1 - least(1.0, eta2_batch + eta2_cluster) AS residual FROM e""",
    "gene",
    "eta2_batch eta2_cluster residual",
)
def variance_partition_keys(spark, d):
    return scores.variance_partition_keys(tables.from_tables(spark, d), ["batch", "cluster"])


@query(f"{_DATA}{_GPCT}--\nSELECT cluster, gene, score, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, gene) AS rank FROM (SELECT cluster, gene, round(mean, 9) AS score FROM ge)", "cluster gene rank", "score")
def rank_genes_by_group(spark, d):
    return scores.rank_genes_by_group(tables.from_tables(spark, d), "cluster")


@query(f"{_DATA}{_EMOM.format(t='counts')}{_TOPVAR.format(n=200)}--\nSELECT * FROM cr WHERE abs(r) >= 0.02", "gene g2", "r")
def gene_correlation_network(spark, d):
    return scores.network(markers.gene_correlation(tables.from_tables(spark, d), n_top=200), 0.02)


@query(
    f"""{_DATA}, l AS (SELECT cell, sum(value) AS lib FROM counts GROUP BY 1), nm AS (SELECT cell, gene, value * (SELECT median(lib) FROM l) / lib AS value FROM counts JOIN l USING (cell)),
    mo AS (SELECT gene, sum(value) / n AS mean, greatest(sum(value * value) - sum(value) * sum(value) / n, 0) / (n - 1) AS v1 FROM nm, (SELECT count(*) AS n FROM obs) GROUP BY gene, n), b AS (SELECT gene, log10(v1 / mean) AS disp, ntile(20) OVER (ORDER BY mean, gene) AS bin FROM mo WHERE mean > 0 AND v1 > 0),
    m AS (SELECT bin, median(disp) AS med, count(*) AS n FROM b GROUP BY 1), e AS (SELECT *, abs(disp - med) AS dev FROM b JOIN m USING (bin)), a AS (SELECT bin, median(dev) AS mad FROM e GROUP BY 1),
    tp AS (SELECT gene FROM e JOIN a USING (bin) ORDER BY round(CASE WHEN n >= 2 AND mad > 1e-12 THEN (disp - med) / mad ELSE 0 END, 6) DESC, gene LIMIT 100)--\nSELECT cell, gene, ln(1 + value) AS value FROM nm SEMI JOIN tp USING (gene)""",
    "cell gene",
    "value",
)
def recipe_zheng17(spark, d):
    return scores.recipe_zheng17(tables.from_tables(spark, d), markers.hvg_cell_ranger, 100).counts


@query()
def recipe_seurat(spark, d):
    """Composed of operators that have SQL each."""
    return scores.recipe_seurat(tables.from_tables(spark, d), markers.hvg_seurat, min_genes=2, min_cells=3, n_top=100)


_LC = "lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0)"
_AT = f"exp({_LC.format(n='m', k='{i}')} + {_LC.format(n='(n - m)', k='(g - {i})')} - ({_LC.format(n='n', k='g')}))"


@query(
    f"""{_DATA}, o AS (SELECT * FROM obs WHERE condition IN ('F', 'O')), t AS (SELECT count(*) FILTER (condition = 'F') AS m, count(*) AS n FROM o), x AS (SELECT cluster, count(*) AS g, count(*) FILTER (condition = 'F') AS k FROM o GROUP BY 1),
    p AS (SELECT cluster, g AS n_cells, log2(((k + 1e-10) / (g + 2e-10)) / (m / n + 1e-10)) AS log2fc, least(1.0, list_sum(list_transform(range(greatest(0, g + m - n), least(g, m) + 1), lambda i: CASE WHEN {_AT.format(i='i')} <= {_AT.format(i='k')} * (1 + 1e-7) THEN {_AT.format(i='i')} ELSE 0 END))) AS pvalue FROM x, t),
    q AS (SELECT *, row_number() OVER (ORDER BY pvalue, cluster) AS r, count(*) OVER () AS c FROM p)--\nSELECT *, least(1.0, min(pvalue * c / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS fdr FROM q""",
    "cluster n_cells",
    "log2fc pvalue fdr",
)
def differential_abundance(spark, d):
    return scores.differential_abundance(tables.from_tables(spark, d).obs.where("condition in ('F', 'O')"), "cluster", "condition")


# graphs


_CONN = f"""{_KNN}, sg AS (SELECT CASE WHEN max(distance) > 0 THEN median(distance) ELSE 1 END AS s FROM nn WHERE rank = 10), cw AS (SELECT cell, neighbour, exp(-distance * distance / (2 * s * s)) AS w, distance AS d FROM nn, sg),
  cn AS (SELECT cell, neighbour, sum(w) / 2 AS weight, sum(d) / 2 AS distance FROM (SELECT * FROM cw UNION ALL SELECT neighbour, cell, w, d FROM cw) GROUP BY 1, 2)"""
_GROUPS = ", ec AS (SELECT a.label AS a, b.label AS b, sum(weight) AS w FROM cn JOIN v a ON a.cell = cn.cell JOIN v b ON b.cell = cn.neighbour GROUP BY 1, 2)"


def _graph(spark, d):
    v, nn = _nn(spark, d)
    return v, graphs.connectivities(nn)


@query(f"{_CONN}--\nSELECT * FROM cn", "cell neighbour", "weight distance")
def connectivities(spark, d):
    return _graph(spark, d)[1]


for _method, _down in (("jaccard", "x.t + y.t - coalesce(w, 0)"), ("overlap", "least(x.t, y.t)"), ("cosine", "sqrt(x.t * y.t)")):

    def _shared(spark, d, method=_method):
        v, g = _graph(spark, d)
        return graphs.connectivity_score(g, v.select("cell", "label"), method)

    _shared.__name__ = f"connectivity_score_{_method}"
    query(
        f"{_CONN}{_GROUPS}, tt AS (SELECT a, sum(w) AS t FROM ec GROUP BY 1)--\nSELECT x.a, y.a AS b, CASE WHEN x.a = y.a THEN 1 WHEN {_down} > 0 THEN coalesce(w, 0) / ({_down}) ELSE 0 END AS score FROM tt x CROSS JOIN tt y LEFT JOIN ec ON ec.a = x.a AND ec.b = y.a",
        "a b",
        "score",
    )(_shared)


@query(
    f"""{_CONN}{_GROUPS}, sz AS (SELECT label, count(*) AS n FROM v GROUP BY 1), pg AS (SELECT least(a, b) AS a, greatest(a, b) AS b, sum(w) AS w FROM ec GROUP BY 1, 2)--
    SELECT a, b, w / CASE WHEN a = b THEN x.n * (x.n - 1) ELSE 2 * x.n * y.n END AS connectivity FROM pg JOIN sz x ON x.label = a JOIN sz y ON y.label = b WHERE w / CASE WHEN a = b THEN x.n * (x.n - 1) ELSE 2 * x.n * y.n END >= 0.005""",
    "a b",
    "connectivity",
)
def paga(spark, d):
    v, g = _graph(spark, d)
    return graphs.paga(g, v.select("cell", "label"), 0.005)


@query(
    f"""{_CENT}, e AS (SELECT cell, list_distance(vec, (SELECT centre FROM c WHERE label = 0)) AS s, list_distance(vec, (SELECT centre FROM c WHERE label = 1)) AS t FROM v)--
    SELECT cell, CASE WHEN s + t > 0 THEN 1 - t / (s + t) ELSE 0.5 END AS score FROM e""",
    "cell",
    "score",
)
def reprogramming_score(spark, d):
    return graphs.reprogramming(tables.vectors(spark, d), "label", 0, 1)


_PLACES = _VEC + ", pl AS (SELECT cell, vec[1] AS x, vec[2] AS y FROM v), pd AS (SELECT a.cell, b.cell AS neighbour, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 9) AS distance FROM pl a JOIN pl b ON a.cell <> b.cell)"


@query(
    f"""{_PLACES}, k6 AS (SELECT * FROM pd QUALIFY row_number() OVER (PARTITION BY cell ORDER BY distance, neighbour) <= 6)--\nSELECT cell, neighbour, sum(distance) / 2 AS distance, 1.0 AS weight FROM (SELECT * FROM k6 UNION ALL SELECT neighbour, cell, distance FROM k6) GROUP BY 1, 2""",
    "cell neighbour",
    "distance weight",
)
def spatial_neighbors(spark, d):
    v = tables.vectors(spark, d).select("cell", F.transform(F.slice("vec", 1, 2), lambda x: x.cast("double")).alias("vec"))
    return graphs.spatial_graph(vectors.knn(v, v, 6))


@query(f"{_PLACES}--\nSELECT * FROM pd WHERE distance <= 0.02", "cell neighbour", "distance")
def spatial_radius(spark, d):
    v = tables.vectors(spark, d).select("cell", F.col("vec")[0].cast("double").alias("x"), F.col("vec")[1].cast("double").alias("y"))
    return graphs.within_radius(v, 0.02).withColumn("distance", nearest(F.col("distance"), 6))  # what rounding is left then changes nothing


_VALUES = ", vl AS (SELECT cell, unnest(vec) AS value, generate_subscripts(vec, 1) AS gene FROM v)"


def _values(v):
    return v.select("cell", F.posexplode("vec").alias("gene", "value")).select("cell", (F.col("gene") + 1).alias("gene"), F.col("value").cast("double").alias("value"))


_HOT = f"""{_KNN}{_VALUES}, mv AS (SELECT gene, avg(value) AS m, stddev_pop(value) AS sd, count(*) AS n FROM vl GROUP BY 1), lg AS (SELECT nn.cell, gene, avg(value) AS lag FROM nn JOIN vl ON vl.cell = nn.neighbour GROUP BY 1, 2),
    xx AS (SELECT vl.cell, vl.gene, value, lag, m, sd, n FROM vl JOIN mv USING (gene) JOIN lg ON lg.cell = vl.cell AND lg.gene = vl.gene), {{stat}},
    pv AS (SELECT gene, statistic, n_hotspot_cells, least(1.0, n * CASE WHEN z >= 0 THEN {_P} / 2 ELSE 1 - {_P} / 2 END) AS pvalue FROM st), pr AS (SELECT *, row_number() OVER (ORDER BY pvalue, gene) AS r, count(*) OVER () AS c FROM pv)--
    SELECT *, least(1.0, min(pvalue * c / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS fdr FROM pr"""


@query(_HOT.format(stat="st AS (SELECT gene, n, max((lag - m) / sd) AS statistic, count(*) FILTER ((lag - m) / sd > 1.96) AS n_hotspot_cells, max((lag - m) / sd) AS z FROM xx GROUP BY 1, 2)"), "gene n_hotspot_cells", "statistic pvalue fdr")
def hotspot_gi_star(spark, d):
    v, nn = _nn(spark, d)
    return graphs.hotspots(nn, _values(v))


@query(
    _HOT.format(stat="lm AS (SELECT gene, n, (value - m) * (lag - m) / (sd * sd) AS g FROM xx), ls AS (SELECT *, (g + 1 / (n - 1)) / (stddev_pop(g) OVER (PARTITION BY gene) + 1e-10) AS zz FROM lm), st AS (SELECT gene, n, coalesce(avg(g) FILTER (g > 0), 0) AS statistic, count(*) FILTER (zz > 1.96) AS n_hotspot_cells, max(zz) AS z FROM ls GROUP BY 1, 2)"),
    "gene n_hotspot_cells",
    "statistic pvalue fdr",
)
def hotspot_local_morans(spark, d):
    v, nn = _nn(spark, d)
    return graphs.hotspots(nn, _values(v), "local_morans")


_SELF = _VEC + ", d AS (SELECT a.cell, b.cell AS neighbour, round(list_distance(a.vec, b.vec), 9) AS distance FROM v a, v b), ns AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY distance, neighbour) AS rank FROM d QUALIFY rank <= 20)"


@query(
    f"""{_SELF}, f AS (SELECT label, count(*) / (SELECT count(*) FROM v) AS f FROM v GROUP BY 1), o AS (SELECT ns.cell, f.label, f, count(*) FILTER (b.label = f.label) AS o FROM ns JOIN v b ON b.cell = ns.neighbour CROSS JOIN f GROUP BY 1, 2, 3),
    s AS (SELECT cell, sum((o - 20 * f) * (o - 20 * f) / (20 * f)) AS x, 1 / sum((o / 20) * (o / 20)) AS lisi, (count(*) - 1) / 2.0 AS a FROM o GROUP BY 1),
    q AS (SELECT lisi, 1 - coalesce(list_sum(list_transform(range(0, 300), lambda i: exp((a + i) * ln(x / 2) - x / 2 - lgamma(a + i + 1)))), 0) AS p FROM s)--\nSELECT avg(CASE WHEN p > 0.05 THEN 1.0 ELSE 0.0 END) AS kbet_acceptance_rate, avg(lisi) AS lisi FROM q""",
    "",
    "kbet_acceptance_rate lisi",
)
def batch_evaluation(spark, d):
    v = tables.vectors(spark, d)
    return graphs.mixing(vectors.knn(v, v, 20, skip_self=False), v.select("cell", "label"))


@query(
    f"""{_SELF}{_VALUES}, la AS (SELECT cell, CASE WHEN max(distance) = 0 THEN 1e-10 ELSE max(distance) END AS s FROM ns GROUP BY 1), af AS (SELECT ns.cell, neighbour, exp(-distance * distance / (a.s * b.s)) AS w FROM ns JOIN la a ON a.cell = ns.cell JOIN la b ON b.cell = ns.neighbour),
    sy AS (SELECT cell, neighbour, sum(w) / 2 AS w FROM (SELECT * FROM af UNION ALL SELECT neighbour, cell, w FROM af) GROUP BY 1, 2), tr AS (SELECT cell, neighbour, w / sum(w) OVER (PARTITION BY cell) AS w FROM sy),
    m1 AS (SELECT tr.cell, gene, sum(w * value) AS value FROM tr JOIN vl ON vl.cell = neighbour GROUP BY 1, 2), m2 AS (SELECT tr.cell, gene, sum(w * value) AS value FROM tr JOIN m1 ON m1.cell = neighbour GROUP BY 1, 2)--
    SELECT tr.cell, gene, sum(w * value) AS value FROM tr JOIN m2 ON m2.cell = neighbour GROUP BY 1, 2""",
    "cell gene",
    "value",
)
def magic(spark, d):
    v = tables.vectors(spark, d)
    return graphs.magic(vectors.knn(v, v, 20, skip_self=False), _values(v))


@query(
    f"""{_KNN}{_VALUES}, ne AS (SELECT cell, neighbour FROM nn UNION ALL SELECT DISTINCT cell, cell FROM nn), g AS (SELECT ne.cell, gene, avg(value * value) FILTER (b.label % 2 = 0) AS a, avg(value * value) FILTER (b.label % 2 = 1) AS b FROM ne JOIN v b ON b.cell = ne.neighbour JOIN vl ON vl.cell = ne.neighbour GROUP BY 1, 2)--
    SELECT cell, gene, log2((b + 0.01) / (a + 0.01)) AS log2fc FROM g WHERE a IS NOT NULL AND b IS NOT NULL""",
    "cell gene",
    "log2fc",
)
def cell_level_de(spark, d):
    v, nn = _nn(spark, d)
    return graphs.local_fold_changes(nn, _values(v).withColumn("value", F.col("value") * F.col("value")), v.select("cell", (F.col("label") % 2).alias("condition")))


@query()
def louvain(spark, d):
    """Tested on planted communities and by modularity."""
    return graphs.louvain(_graph(spark, d)[1])


# tags and guides


_TAGS = "WITH t AS (SELECT user_id AS cell, event_type AS feature, count(*) AS n FROM events GROUP BY 1, 2)"


def _tags(spark, d, name="feature"):
    return tables.events(spark, d).groupBy(F.col("user_id").alias("cell"), F.col("event_type").alias(name)).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_TAGS}--\nSELECT cell, feature, ln(1 + n / exp(sum(ln(1 + n)) OVER (PARTITION BY cell) / 5)) AS clr FROM t", "cell feature", "clr")
def clr(spark, d):
    return tags.clr(_tags(spark, d), 5)


_TOTALS = "WITH t AS (SELECT user_id AS cell, count(*) AS total, user_id % 4 = 0 AS called FROM events GROUP BY 1)"


def _totals(spark, d):
    return tables.events(spark, d).groupBy(F.col("user_id").alias("cell")).agg(F.count(F.lit(1)).alias("total")).withColumn("called", F.col("cell") % 4 == 0)


@query(
    f"""{_TOTALS}, c AS (SELECT * FROM t WHERE NOT called AND total >= 1)--\nSELECT cell, total FROM c WHERE (SELECT count(*) FROM c) < 50 OR total <= least((SELECT quantile_cont(total, 0.99) FROM c), (SELECT quantile_cont(total, 0.05) FROM t WHERE called))""",
    "cell total",
)
def empty_droplets(spark, d):
    return tags.empty_droplets(_totals(spark, d))


@query(
    f"""{_TAGS}, e AS (SELECT DISTINCT user_id AS cell FROM events WHERE user_id % 4 <> 0), f AS (SELECT DISTINCT feature FROM t), g AS (SELECT e.cell, f.feature, ln(coalesce(n, 0) + 10) AS v FROM e CROSS JOIN f LEFT JOIN t ON t.cell = e.cell AND t.feature = f.feature),
    b AS (SELECT feature, avg(v) AS mu, CASE WHEN stddev_samp(v) > 1e-9 THEN stddev_samp(v) ELSE 1 END AS sd FROM g GROUP BY 1), c AS (SELECT DISTINCT user_id AS cell FROM events WHERE user_id % 4 = 0)--
    SELECT c.cell, b.feature, (ln(coalesce(n, 0) + 10) - mu) / sd AS z FROM c CROSS JOIN b LEFT JOIN t ON t.cell = c.cell AND t.feature = b.feature""",
    "cell feature",
    "z",
)
def dsb(spark, d):
    t = _totals(spark, d)
    return tags.background_z(t.where("called"), t.where("not called"), _tags(spark, d))


@query(
    f"""{_TAGS}, a AS (SELECT feature AS tag, sum(n) + 1e-9 AS a FROM t GROUP BY 1), s AS (SELECT sum(a) AS s, count(*) AS k FROM a), c AS (SELECT DISTINCT cell FROM t),
    x AS (SELECT c.cell, a.tag, round(coalesce(n, 0) / (a.a / s.s * s.k), 9) AS v FROM c CROSS JOIN a CROSS JOIN s LEFT JOIN t ON t.cell = c.cell AND t.feature = a.tag),
    o AS (SELECT cell, list(v ORDER BY v DESC, tag) AS v, list(tag ORDER BY v DESC, tag) AS g FROM x GROUP BY 1), l AS (SELECT cell, g[1] AS tag, log2((v[1] + 5) / (v[2] + 5)) AS lfc_top, log2((v[2] + 5) / (coalesce(list_median(v[3:]), 0) + 5)) AS lfc_second FROM o),
    m2 AS (SELECT md, 1.4826 * median(abs(lfc_second - md)) AS mad FROM l, (SELECT median(lfc_second) AS md FROM l) GROUP BY md), dd AS (SELECT l.*, lfc_second > md + 3 * mad AND lfc_second >= 2 AS doublet FROM l, m2),
    m1 AS (SELECT mt, 1.4826 * median(abs(lfc_top - mt)) AS mat FROM dd, (SELECT median(lfc_top) AS mt FROM dd WHERE NOT doublet) WHERE NOT doublet GROUP BY mt)--
    SELECT cell, CASE WHEN doublet THEN 'doublet' WHEN lfc_top >= 0.5 AND lfc_top >= mt - 3 * mat THEN tag ELSE 'negative' END AS call, lfc_top, lfc_second FROM dd, m1""",
    "cell call",
    "lfc_top lfc_second",
)
def hashed_drops(spark, d):
    t = _tags(spark, d, "tag")
    return tags.hashed_drops(t.select("cell").distinct(), t, t.groupBy("tag").agg(F.sum("n").alias("n")), confident_min=0.5)


_UMI = "WITH u AS (SELECT user_id AS grp, (event_id * 37) % 256 AS umi, count(*) AS reads FROM events GROUP BY 1, 2)"


@query(
    f"""{_UMI}, n AS (SELECT a.grp, a.umi, max({{'r': b.reads, 't': b.umi}}) AS b FROM u a JOIN u b ON a.grp = b.grp AND a.umi <> b.umi AND bit_count((xor(a.umi, b.umi) | (xor(a.umi, b.umi) >> 1)) & 85) = 1 GROUP BY 1, 2)--
    SELECT grp, umi, reads, CASE WHEN n.b.r > reads OR (n.b.r = reads AND n.b.t > umi) THEN n.b.t ELSE umi END AS target FROM u LEFT JOIN n USING (grp, umi)""",
    "grp umi reads target",
)
def correct_umis(spark, d):
    u = tables.events(spark, d).groupBy(F.col("user_id").alias("grp"), ((F.col("event_id") * 37) % 256).alias("umi")).agg(F.count(F.lit(1)).alias("reads"))
    return tags.correct_molecules(u, 4)


_CODES = "WITH c AS (SELECT DISTINCT o_orderkey % 4096 AS code FROM orders)"
_DECODE = " || ".join(f"substr('ACGT', ((code >> {2 * (5 - i)}) & 3) + 1, 1)" for i in range(6))


def _codes(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_orderkey") % 4096).alias("code")).distinct()


@query(f"{_CODES}, s AS (SELECT code, {_DECODE} AS bases FROM c)--\nSELECT code, bases, reverse(translate(bases, 'ACGTN', 'TGCAN')) AS reverse_complement FROM s", "code bases reverse_complement")
def decode_barcodes(spark, d):
    bases = tags.decode_bases(F.col("code"), 6)
    return _codes(spark, d).select("code", bases.alias("bases"), tags.reverse_complement(bases).alias("reverse_complement"))


@query(
    f"""{_CODES}, s AS (SELECT code, CASE WHEN code % 3 = 0 THEN substr({_DECODE}, 1, 2) || 'N' || substr({_DECODE}, 4) WHEN code % 3 = 1 THEN 'N' || substr({_DECODE}, 2, 4) || 'N' ELSE {_DECODE} END AS bases FROM c), f AS (SELECT code, bases, unnest(['A', 'C', 'G', 'T']) AS b FROM s WHERE length(replace(bases, 'N', '')) = 5)--
    SELECT code, replace(bases, 'N', b) AS filled FROM f""",
    "code filled",
)
def fill_unknown_bases(spark, d):
    b = tags.decode_bases(F.col("code"), 6)
    cut = F.when(F.col("code") % 3 == 0, F.concat(F.substring(b, 1, 2), F.lit("N"), F.substring(b, 4, 9))).when(F.col("code") % 3 == 1, F.concat(F.lit("N"), F.substring(b, 2, 4), F.lit("N"))).otherwise(b)
    return _codes(spark, d).select("code", F.explode(tags.fill_unknown(cut)).alias("filled"))


@query(f"{_CODES}--\nSELECT code, CASE WHEN code % 5 = 0 THEN code + 1 ELSE code END AS other, code % 5 = 0 AS translated FROM c", "code other translated")
def translate_barcodes(spark, d):
    return tags.translate(_codes(spark, d), spark.range(0, 4096, 5).select(F.col("id").alias("code"), (F.col("id") + 1).alias("other")))


_NAMES = """WITH n AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'HTO_' || p_name WHEN 1 THEN 'Mouse IgG1 ctrl' WHEN 2 THEN p_name || ' Hashtag' WHEN 3 THEN 'x_hto_' || p_size WHEN 4 THEN 'negative control' ELSE p_name END AS name,
    CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'NTC' WHEN 2 THEN 'safe_target' ELSE p_brand END AS target FROM part)"""


@query(
    f"""{_NAMES}--\nSELECT id, CASE WHEN lower(name) LIKE '%hashtag%' OR lower(name) LIKE 'hto%' OR list_contains(string_split(lower(name), '_'), 'hto') THEN 'hashtag' WHEN lower(name) LIKE '%isotype%' OR (lower(name) LIKE '%igg%' AND lower(name) LIKE '%ctrl%') OR lower(name) LIKE '%negative control%' THEN 'isotype' ELSE 'antibody' END AS kind,
    CASE WHEN lower(target) LIKE '%safe%' THEN 'safe-targeting' WHEN lower(name || ' ' || target) LIKE '%ntc%' OR target = '' THEN 'non-targeting' ELSE 'targeting' END AS guide FROM n""",
    "id kind guide",
)
def feature_kinds(spark, d):
    k, name = F.col("p_partkey"), F.col("p_name")
    named = F.when(k % 6 == 0, F.concat(F.lit("HTO_"), name)).when(k % 6 == 1, "Mouse IgG1 ctrl").when(k % 6 == 2, F.concat(name, F.lit(" Hashtag"))).when(k % 6 == 3, F.concat(F.lit("x_hto_"), F.col("p_size").cast("string"))).when(k % 6 == 4, "negative control").otherwise(name)
    target = F.when(k % 5 == 0, "").when(k % 5 == 1, "NTC").when(k % 5 == 2, "safe_target").otherwise(F.col("p_brand"))
    return spark.read.parquet(f"{d}/part.parquet").select(k.alias("id"), tags.feature_kind(named).alias("kind"), tags.guide_kind(named, target).alias("guide"))


@query(
    f"""{_CODES}, r AS (SELECT {_DECODE} || {_DECODE} AS sequence FROM c), p AS (SELECT {_DECODE.replace('code', 'w')} AS w FROM (SELECT unnest(range(0, 4096, 7)) AS w)), o AS (SELECT unnest(range(0, 9)) AS off), x AS (SELECT off, CASE WHEN length(sequence) >= off + 6 THEN substr(sequence, off + 1, 6) END AS w FROM r, o)--
    SELECT off::INT AS place, count(*) FILTER (w IN (SELECT w FROM p)) / count(*) AS share FROM x GROUP BY 1""",
    "place",
    "share",
)
def detect_offset(spark, d):
    b = tags.decode_bases(F.col("code"), 6)
    panel = spark.range(0, 4096, 7).select(tags.decode_bases(F.col("id"), 6).alias("sequence"))
    return tags.offset_shares(_codes(spark, d).select(F.concat(b, b).alias("sequence")), panel, range(9)).withColumnRenamed("offset", "place")


@query(
    f"""{_CODES}, s AS (SELECT code, {_DECODE} AS q FROM c)--\nSELECT code, CASE WHEN greatest(6 - length(replace(q, 'A', '')), 6 - length(replace(q, 'C', '')), 6 - length(replace(q, 'G', '')), 6 - length(replace(q, 'T', ''))) >= 4.8 THEN 'low_complexity'
    WHEN substr(q, 2, 5) IN ('ACGTA', 'GGCAT') OR substr(q, 1, 5) IN ('CGTAC', 'GCATT') THEN 'shifted' ELSE 'other' END AS class, CASE WHEN instr(q, 'GT') > 2 THEN substr(q, instr(q, 'GT') - 2, 2) WHEN instr(q, 'CA') > 2 THEN substr(q, instr(q, 'CA') - 2, 2) END AS before FROM s""",
    "code class before",
)
def unmatched_classes(spark, d):
    b = tags.decode_bases(F.col("code"), 6)
    return _codes(spark, d).select("code", tags.unmatched_class(b, ["ACGTAC", "GGCATT"]).alias("class"), tags.window_before(b, "GT|CA", 2).alias("before"))


_GUIDES = """WITH m AS (SELECT l_orderkey AS cell, l_partkey % 20 AS guide, ceil(sum(l_quantity) / 3) AS n FROM lineitem GROUP BY 1, 2), am AS (SELECT guide, sum(n) AS n FROM m WHERE cell % 5 = 0 GROUP BY 1), pr AS (SELECT guide, (n + 0.5) / (SELECT sum(n) + count(*) * 0.5 FROM am) AS p FROM am)"""
_CALLS = (
    _GUIDES
    + """, rk AS (SELECT cell, guide, n, p, row_number() OVER (PARTITION BY cell ORDER BY n DESC, guide) > 2 AS rest FROM m JOIN pr USING (guide)),
    lo AS (SELECT *, sum(n) OVER w AS tot, sum(CASE WHEN rest THEN n ELSE 0 END) OVER w - CASE WHEN rest THEN n ELSE 0 END AS umis, sum(CASE WHEN rest THEN p ELSE 0 END) OVER w - CASE WHEN rest THEN p ELSE 0 END AS share FROM rk WINDOW w AS (PARTITION BY cell)),
    la AS (SELECT *, greatest(1e-12, greatest(1.0, CASE WHEN share > 0.05 THEN umis / share ELSE 0 END) * p) AS lam FROM lo WHERE n >= 3 AND n >= 0.05 * tot),
    ca AS (SELECT cell, guide, n FROM la WHERE 1 - list_sum(list_transform(range(0, n::BIGINT), lambda i: exp(i * ln(lam) - lam - lgamma(i + 1)))) < 0.001 / (SELECT count(*) FROM pr))"""
)
_LABELS = """, lb AS (SELECT cell, count(*) AS n_guides, string_agg(guide::VARCHAR, '|' ORDER BY guide) AS guide_ids, string_agg(DISTINCT 'Brand#' || guide % 4, '|' ORDER BY 'Brand#' || guide % 4) AS target FROM ca GROUP BY 1),
    la2 AS (SELECT cell, coalesce(n_guides, 0) AS n_guides, coalesce(guide_ids, '') AS guide_ids, coalesce(target, '') AS target, CASE WHEN n_guides IS NULL THEN 'unassigned' WHEN n_guides = 1 THEN 'single' ELSE 'multiple' END AS class FROM (SELECT DISTINCT cell FROM m) LEFT JOIN lb USING (cell))"""


def _guides(spark, d):
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    return line.groupBy(F.col("l_orderkey").alias("cell"), (F.col("l_partkey") % 20).alias("guide")).agg(F.ceil(F.sum("l_quantity") / 3).cast("double").alias("n"))


def _profile(m):
    return tags.ambient_profile(m.where("cell % 5 = 0").groupBy("guide").agg(F.sum("n").alias("n")))


def _labels(spark, d, alpha=0.001):
    m = _guides(spark, d)
    targets = spark.range(20).select(F.col("id").alias("guide"), F.concat(F.lit("Brand#"), (F.col("id") % 4).cast("string")).alias("target"))
    return tags.guide_labels(m.select("cell").distinct(), tags.call_guides(m, _profile(m), 1.0, alpha=alpha), targets)


@query(f"{_GUIDES}--\nSELECT * FROM pr", "guide", "p")
def ambient_profile(spark, d):
    return _profile(_guides(spark, d))


@query("WITH t AS (SELECT l_orderkey, sum(l_quantity) AS total FROM lineitem WHERE l_orderkey % 5 = 0 GROUP BY 1)--\nSELECT coalesce(quantile_cont(total, 0.95), 0) AS load FROM t", "", "load")
def ambient_load(spark, d):
    return tags.ambient_load(spark.read.parquet(f"{d}/lineitem.parquet").where("l_orderkey % 5 = 0").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total")))


@query(f"{_CALLS}--\nSELECT * FROM ca", "cell guide", "n")
def call_ambient_guides(spark, d):
    m = _guides(spark, d)
    return tags.call_guides(m, _profile(m), 1.0)


@query(f"{_CALLS}{_LABELS}--\nSELECT * FROM la2", "cell n_guides guide_ids target class")
def guide_labels(spark, d):
    return _labels(spark, d)


@query(
    f"""{_CALLS}{_LABELS}, rf AS (SELECT cell, min(guide)::VARCHAR AS g FROM m GROUP BY 1), j AS (SELECT class = 'single' AS s, class = 'single' AND guide_ids = g AS same FROM la2 JOIN rf USING (cell)),
    k AS (SELECT count(*) AS cells, count(*) AS ref_single, count(*) FILTER (s) AS ours_single, count(*) FILTER (same) AS same FROM j), r AS (SELECT *, same / greatest(1, ref_single) AS recall_single, same / greatest(1, ours_single) AS precision_single FROM k)--
    SELECT *, CASE WHEN recall_single + precision_single <> 0 THEN 2 * recall_single * precision_single / (recall_single + precision_single) ELSE 0 END AS f1_single FROM r""",
    "cells ref_single ours_single",
    "recall_single precision_single f1_single",
)
def guide_agreement(spark, d):
    reference = _guides(spark, d).groupBy("cell").agg(F.min("guide").cast("string").alias("guide_ids")).withColumn("class", F.lit("single"))
    return tags.agreement(_labels(spark, d), reference)


@query(
    f"""{_CALLS}{_LABELS}, cnt AS (SELECT l_orderkey AS cell, l_partkey AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2), co AS (SELECT DISTINCT cell FROM m WHERE cell % 5 = 0), tg AS (SELECT unnest(range(0, 20)) AS gene),
    ba AS (SELECT gene, sum(value) / (SELECT count(*) FROM co) AS control FROM cnt SEMI JOIN co USING (cell) JOIN tg USING (gene) GROUP BY 1), si AS (SELECT cell, guide_ids, guide_ids::BIGINT AS gene FROM la2 WHERE class = 'single'),
    x AS (SELECT guide_ids, si.gene, count(*) AS cells, avg(coalesce(value, 0)) AS m FROM si LEFT JOIN cnt ON cnt.cell = si.cell AND cnt.gene = si.gene GROUP BY 1, 2 HAVING count(*) >= 5)--\nSELECT guide_ids, x.gene, cells, 1 - m / control AS knockdown FROM x JOIN ba ON ba.gene = x.gene AND control > 0""",
    "guide_ids gene cells",
    "knockdown",
)
def guide_knockdown(spark, d):
    targets = spark.range(20).select(F.col("id").cast("string").alias("guide_ids"), F.col("id").alias("gene"))
    return tags.knockdown(_labels(spark, d), targets, tables.from_tables(spark, d).counts, _guides(spark, d).where("cell % 5 = 0").select("cell").distinct())


@query(
    "WITH m AS (SELECT l_orderkey AS cell, l_partkey % 7 AS class, sum(l_quantity) AS n FROM lineitem GROUP BY 1, 2), c AS (SELECT unnest(range(0, 7)) AS class), g AS (SELECT class, range(class, class + 1 + class % 3) AS genes FROM c WHERE class <> 6), x AS (SELECT cell, unnest(genes) AS gene, n / len(genes) AS v FROM m JOIN g USING (class))--\nSELECT cell, gene, sum(v) AS value FROM x GROUP BY 1, 2",
    "cell gene",
    "value",
)
def distribute_uniform(spark, d):
    m = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("cell"), (F.col("l_partkey") % 7).alias("class")).agg(F.sum("l_quantity").alias("n"))
    genes = F.when(F.col("id") < 6, F.sequence(F.col("id"), F.col("id") + F.col("id") % 3)).otherwise(F.array().cast("array<bigint>"))
    return tags.distribute_uniform(m, spark.range(7).select(F.col("id").alias("class"), genes.alias("genes")))


# receptors


_CONTIGS = """WITH ct AS (SELECT l_orderkey // 4 AS barcode, CASE WHEN l_orderkey // 4 % 3 = 0 THEN ['IGH', 'IGK', 'IGL'][l_partkey % 3 + 1] ELSE ['TRA', 'TRB', 'TRG', 'TRD'][l_partkey % 4 + 1] END AS chain, 'C' || l_suppkey % 2 AS cdr3, 'N' || l_suppkey % 2 AS cdr3_nt, 'V' || l_partkey % 2 AS v_gene, 'J' AS j_gene,
    l_quantity::BIGINT AS umis FROM lineitem WHERE l_linenumber % 5 <> 0), rk AS (SELECT *, row_number() OVER (PARTITION BY barcode, chain ORDER BY umis DESC, cdr3_nt, v_gene, j_gene) - 1 AS rank FROM ct)"""


def _contigs(spark, d):
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    b, p, s = F.expr("l_orderkey div 4"), F.col("l_partkey"), (F.col("l_suppkey") % 2).cast("string")
    pick = lambda names, k: F.get(F.array(*map(F.lit, names)), (p % k).cast("int"))
    chain = F.when(b % 3 == 0, pick(("IGH", "IGK", "IGL"), 3)).otherwise(pick(("TRA", "TRB", "TRG", "TRD"), 4))
    return line.select(
        b.alias("barcode"), chain.alias("chain"), F.concat(F.lit("C"), s).alias("cdr3"), F.concat(F.lit("N"), s).alias("cdr3_nt"), F.concat(F.lit("V"), (p % 2).cast("string")).alias("v_gene"), F.lit("J").alias("j_gene"),
        F.col("l_quantity").cast("bigint").alias("umis"), F.lit(True).alias("kept"), (F.col("l_linenumber") % 5 != 0).alias("productive"),
    )


@query(
    f"""{_CONTIGS}--\nSELECT barcode, {', '.join(f"max(cdr3) FILTER (chain = '{c}' AND rank = 0) AS {c}_cdr3" for c in (*receptors.T_CHAINS, *receptors.B_CHAINS))}, (sum(umis) FILTER (rank < 2))::BIGINT AS umis,
    CASE WHEN count(*) FILTER (rank < 2 AND chain LIKE 'IG%') > 0 THEN CASE WHEN count(*) FILTER (rank < 2 AND chain IN ('TRA', 'TRB')) > 0 THEN 'mixed' ELSE 'BCR' END ELSE 'TCR' END AS receptor,
    (count(*) FILTER (chain = 'TRA') > 0 AND count(*) FILTER (chain = 'TRB') > 0) OR (count(*) FILTER (chain = 'TRG') > 0 AND count(*) FILTER (chain = 'TRD') > 0) OR (count(*) FILTER (chain = 'IGH') > 0 AND count(*) FILTER (chain IN ('IGK', 'IGL')) > 0) AS paired, count(*) FILTER (rank >= 2) AS excess_chains FROM rk GROUP BY 1""",
    "barcode " + " ".join(f"{c}_cdr3" for c in (*receptors.T_CHAINS, *receptors.B_CHAINS)) + " umis receptor paired excess_chains",
)
def receptor_cells(spark, d):
    return receptors.cell_chains(_contigs(spark, d))


@query(
    f"""{_CONTIGS}, k AS (SELECT barcode, string_agg(chain || ':' || v_gene || ':' || j_gene || ':' || cdr3_nt, '|' ORDER BY chain || ':' || v_gene || ':' || j_gene || ':' || cdr3_nt) AS key FROM rk WHERE rank < 2 GROUP BY 1 HAVING count(*) FILTER (chain LIKE 'IG%') = 0), s AS (SELECT key, count(*) AS n FROM k GROUP BY 1),
    r AS (SELECT key, n, row_number() OVER (ORDER BY n DESC, key) AS id FROM s)--\nSELECT barcode, 'clonotype' || id AS clonotype_id, n AS clonotype_size FROM k JOIN r USING (key)""",
    "barcode clonotype_id clonotype_size",
)
def clonotypes(spark, d):
    return receptors.t_clonotypes(_contigs(spark, d))


# files


_PATHS = """WITH f AS (SELECT p_partkey AS id, p_size::BIGINT AS size, CASE p_partkey % 9 WHEN 0 THEN 'private/a.txt' WHEN 1 THEN 'samples/GSM12/donor/donor_assignments.tsv' WHEN 2 THEN 'samples/GSM12/donor/x.tsv' WHEN 3 THEN 'samples/readme.txt' WHEN 4 THEN 'mt/mt_summary.tsv'
    WHEN 5 THEN 'counts/snp_1.tsv' WHEN 6 THEN 'x/y.VCF.gz' WHEN 7 THEN 'samples/GSM3/ase_counts.tsv' ELSE 'samples/GSM3/counts.mtx' END AS path, CASE p_partkey % 4 WHEN 0 THEN ' gse' || p_partkey WHEN 1 THEN 'GSM' || p_partkey || '_a1 ' WHEN 2 THEN 'GSX1' ELSE 'gse' END AS acc FROM part)"""


def _paths(spark, d):
    k = F.col("p_partkey")
    names = ["private/a.txt", "samples/GSM12/donor/donor_assignments.tsv", "samples/GSM12/donor/x.tsv", "samples/readme.txt", "mt/mt_summary.tsv", "counts/snp_1.tsv", "x/y.VCF.gz", "samples/GSM3/ase_counts.tsv", "samples/GSM3/counts.mtx"]
    acc = F.when(k % 4 == 0, F.concat(F.lit(" gse"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("GSM"), k.cast("string"), F.lit("_a1 "))).when(k % 4 == 2, "GSX1").otherwise("gse")
    return spark.read.parquet(f"{d}/part.parquet").select(k.alias("id"), F.col("p_size").cast("bigint").alias("size"), F.get(F.array(*map(F.lit, names)), (k % 9).cast("int")).alias("path"), acc.alias("acc"))


@query(f"{_PATHS}--\nSELECT id, CASE WHEN id % 4 < 2 THEN upper(trim(acc)) END AS accession, CASE WHEN id % 4 = 0 THEN upper(trim(acc)) END AS series FROM f", "id accession series")
def normalize_accession(spark, d):
    return _paths(spark, d).select("id", cat.normal_accession(F.col("acc")).alias("accession"), cat.normal_accession(F.col("acc"), True).alias("series"))


@query(f"{_PATHS}--\nSELECT id % 9 IN (0, 2, 5, 6, 7) AS restricted, count(*) AS files, sum(size)::BIGINT AS bytes FROM f GROUP BY 1", "restricted files bytes")
def restricted_summary(spark, d):
    return cat.restricted_summary(_paths(spark, d))
