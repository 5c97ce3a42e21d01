"""Queries by name over the driver's tables, and SQL that gives the same rows.

Stand-ins: cells are ``embeddings`` (first two dimensions as coordinates, label as cluster), counts are ``lineitem``
by supplier and part, transcripts and pixels come from ``lineitem``, survival from ``customer`` and ``orders``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import streaming
from .functions import stats
from .model import cut
from .operators import deconvolution, expression, graph, interaction, moran, permutation, raster, signaling, spatial, survival
from .plans import plotdata

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _cells(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), F.col("label").cast("string").alias("cluster"))


CELLS = "cells AS (SELECT vec_id AS cell_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label::VARCHAR AS cluster FROM embeddings)"


def _expr(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("cell_id"), F.col("l_partkey").alias("gene_id")).agg(F.sum("l_quantity").alias("value"))


EXPR = "expr AS (SELECT l_suppkey AS cell_id, l_partkey AS gene_id, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"


def _spots(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers on a grid of 32 columns."""
    k = F.col("s_suppkey")
    return _t(spark, d, "supplier").select(k.alias("cell_id"), F.pmod(k, F.lit(32)).cast("double").alias("x"), F.floor(k / 32).cast("double").alias("y"), F.col("s_nationkey").cast("string").alias("cluster"))


SPOTS = "spots AS (SELECT s_suppkey AS cell_id, (s_suppkey % 32)::DOUBLE AS x, floor(s_suppkey / 32)::DOUBLE AS y, s_nationkey::VARCHAR AS cluster FROM supplier)"
GRID = "grid AS (SELECT a.cell_id AS src, b.cell_id AS dst, 1.0 AS weight, sqrt((a.x-b.x)**2 + (a.y-b.y)**2) AS distance FROM spots a JOIN spots b ON a.cell_id <> b.cell_id AND (a.x-b.x)**2 + (a.y-b.y)**2 <= 2.25)"
#: All lines, by the part's number modulo 40 as genes: every spot has nearly all of them.
FEW = "few AS (SELECT l_suppkey AS cell_id, l_partkey % 40 AS gene_id, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return spatial.radius_graph(_spots(spark, d), 1.5)


def _few(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("cell_id"), (F.col("l_partkey") % 40).alias("gene_id")).agg(F.sum("l_quantity").alias("value"))


R = 0.03
NEAR = "near AS (SELECT src, dst, distance FROM (SELECT a.cell_id AS src, b.cell_id AS dst, sqrt((a.x-b.x)**2 + (a.y-b.y)**2) AS distance, row_number() OVER (PARTITION BY a.cell_id ORDER BY sqrt((a.x-b.x)**2 + (a.y-b.y)**2), b.cell_id) AS rn FROM cells a JOIN cells b ON a.cell_id <> b.cell_id) WHERE rn <= 6)"
KNN = f"{CELLS}, {NEAR}, edges AS (SELECT src, dst, 1.0::DOUBLE AS weight, sum(distance) / 2 AS distance FROM (SELECT src, dst, distance FROM near UNION ALL SELECT dst, src, distance FROM near) GROUP BY src, dst)"
RADIUS = f"{CELLS}, edges AS (SELECT a.cell_id AS src, b.cell_id AS dst, 1.0::DOUBLE AS weight, sqrt((a.x-b.x)**2 + (a.y-b.y)**2) AS distance FROM cells a JOIN cells b ON a.cell_id <> b.cell_id AND sqrt((a.x-b.x)**2 + (a.y-b.y)**2) <= {R})"
LABELS = "labels_ AS (SELECT DISTINCT cluster FROM cells)"


def _knn(spark: SparkSession, d: str) -> DataFrame:
    return spatial.knn_graph(_cells(spark, d), 6)


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Float results rounded so that the order of sums doesn't show; -0 becomes 0."""
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in columns})


def _permuted_sql(v: str, draw: str, seed: int = 0) -> str:
    """``model.permuted`` for one pass; ``half`` and ``mask`` are columns."""
    left, right = f"({v} >> half)", f"({v} & mask)"
    for r in range(4):
        x = f"(({right} + {seed * 7_919 + r * 15_485_863 + 12_345} + {draw} * 104729) % 2147483647)"
        left, right = right, f"xor({left}, (({x} * {x}) % 2147483647 * 48271) % 2147483647 & mask)"
    return f"(({left} << half) | {right})"


def _moves_sql(cells: str, seed: int = 0) -> str:
    """CTEs: ``idx`` (cell_id, i) and ``moved`` (perm, cell_id, place), the place of every cell in every draw."""
    first, again = _permuted_sql("i", "perm", seed), _permuted_sql("place", "perm", seed)
    return f"""size_ AS (SELECT count(*) AS n, greatest(1, ceil(log2(count(*)) / 2))::BIGINT AS half, (1::BIGINT << greatest(1, ceil(log2(count(*)) / 2))::INT) - 1 AS mask FROM {cells}),
  idx AS (SELECT cell_id, row_number() OVER (ORDER BY cell_id) - 1 AS i FROM {cells}),
  walk_ AS (SELECT perm, cell_id, {first} AS place FROM idx, size_, range({PERMS}) t(perm) UNION ALL SELECT perm, cell_id, {again} FROM walk_, size_ WHERE place >= n),
  moved AS (SELECT perm, cell_id, place FROM walk_, size_ WHERE place < n)"""


def _t_tail_sql(t: str, df: str, steps: int = 2000) -> str:
    """Two-sided p of Student's t by Simpson's rule on the angle whose tangent is t / sqrt(df)."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    share = f"CASE WHEN k IN (0, {steps}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return f"(2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) * (pi() / 2 - {angle}) / {3 * steps} * list_sum(list_transform(range(0, {steps + 1}), lambda k: ({share}) * power(greatest(cos({angle} + k * (pi() / 2 - {angle}) / {steps}), 0), {df} - 1))))"


def _normal_tail_sql(z: str, steps: int = 400) -> str:
    """Two-sided p of a standard normal by Simpson's rule."""
    share = f"CASE WHEN k IN (0, {steps}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return f"(2 / sqrt(2 * pi()) * 8 / {3 * steps} * list_sum(list_transform(range(0, {steps + 1}), lambda k: ({share}) * exp(-0.5 * pow(abs({z}) + k * 8 / {steps}, 2)))))"


def _bh_sql(rows: str, p: str, by: str = "") -> str:
    """Rows with p_adj."""
    part = f"PARTITION BY {by}" if by else ""
    return f"(SELECT *, least(min({p} * n_ / k_) OVER ({part} ORDER BY k_ DESC ROWS UNBOUNDED PRECEDING), 1) AS p_adj FROM (SELECT *, row_number() OVER ({part} ORDER BY {p}) AS k_, count(*) OVER ({part}) AS n_ FROM {rows}))"


PERMS = 1000


# graphs


@query(f"WITH {KNN} SELECT src, dst, weight, round(distance, 6) + 0.0 AS distance FROM edges")
def knn_graph(spark, d):
    return _rounded(_knn(spark, d), "distance")


@query(f"WITH {RADIUS} SELECT src, dst, weight, round(distance, 6) + 0.0 AS distance FROM edges")
def radius_graph(spark, d):
    return _rounded(spatial.radius_graph(_cells(spark, d), R), "distance")


@query(f"WITH {RADIUS} SELECT src, dst, round(exp(-(distance**2) / (2 * 0.02**2)), 6) + 0.0 AS weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY exp(-(distance*distance) / (2 * 0.02 * 0.02)) DESC, dst) AS rn FROM edges WHERE distance > 0) WHERE rn <= 8")
def rbf_weights(spark, d):
    return _rounded(spatial.rbf_weights(_cells(spark, d), R, 0.02, 8), "weight").select("src", "dst", "weight")


@query(f"WITH {KNN} SELECT src, dst, round(distance, 6) + 0.0 AS distance FROM edges WHERE distance BETWEEN 0.005 AND 0.02")
def edge_filter(spark, d):
    return _rounded(graph.filter_edges_by_distance(_knn(spark, d), 0.005, 0.02), "distance").select("src", "dst", "distance")


@query(f"WITH {KNN}, p AS (SELECT quantile_cont(distance, 0.5) AS r FROM edges) SELECT a.cell_id AS src, b.cell_id AS dst FROM cells a, cells b, p WHERE a.cell_id <> b.cell_id AND sqrt((a.x-b.x)**2 + (a.y-b.y)**2) <= r")
def percentile_graph(spark, d):
    return spatial.spatial_neighbors(_cells(spark, d), 6, percentile=50).select("src", "dst")


S = "s AS (SELECT src AS node, sum(weight) AS s FROM edges GROUP BY src)"


@query(f"WITH {KNN}, {S} SELECT src, dst, round(weight / sqrt(a.s * b.s), 6) + 0.0 AS weight FROM edges JOIN s a ON a.node = src JOIN s b ON b.node = dst")
def spectral_transform(spark, d):
    return _rounded(graph.spectral_transform(_knn(spark, d)), "weight").select("src", "dst", "weight")


@query(f"WITH {KNN} SELECT src, dst, round((coalesce((a.x*b.x + a.y*b.y) / nullif(sqrt(a.x**2 + a.y**2) * sqrt(b.x**2 + b.y**2), 0), 0) + 1) / 2, 6) + 0.0 AS weight FROM edges JOIN cells a ON a.cell_id = src JOIN cells b ON b.cell_id = dst")
def cosine_transform(spark, d):
    return _rounded(graph.cosine_transform(_knn(spark, d), _cells(spark, d)), "weight").select("src", "dst", "weight")


@query(f"WITH {KNN}, {S} SELECT src, dst, round(-weight / sqrt(a.s * b.s), 6) + 0.0 AS value FROM edges JOIN s a ON a.node = src JOIN s b ON b.node = dst UNION ALL SELECT cell_id, cell_id, CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END FROM cells LEFT JOIN s ON node = cell_id")
def laplacian(spark, d):
    return _rounded(graph.laplacian(_knn(spark, d), _cells(spark, d)), "value")


@query(f"WITH {KNN}, {S} SELECT src, dst, -weight AS value FROM edges UNION ALL SELECT cell_id, cell_id, coalesce(s, 0.0) FROM cells LEFT JOIN s ON node = cell_id")
def laplacian_unnormalized(spark, d):
    return graph.laplacian(_knn(spark, d), _cells(spark, d), normalized=False)


@query("SELECT l_suppkey AS src, l_partkey AS dst, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL")
def adjacency_sum(spark, d):
    return graph.adjacency(_t(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("weight")))


@query(f"WITH {KNN}, n AS (SELECT count(*) AS n FROM cells), g AS (SELECT src, count(*) AS k FROM edges GROUP BY src) SELECT cluster, round(avg(coalesce(k, 0) / (n - 1)), 6) AS degree FROM cells CROSS JOIN n LEFT JOIN g ON src = cell_id GROUP BY cluster")
def degree_centrality(spark, d):
    return _rounded(graph.centrality_scores(_cells(spark, d), _knn(spark, d), "cluster", ("degree",)), "degree")


@query(f"WITH RECURSIVE {RADIUS}, reach AS (SELECT cell_id AS a, cell_id AS b FROM cells UNION SELECT a, dst FROM reach JOIN edges ON src = b) SELECT a AS cell_id, min(b) AS component FROM reach GROUP BY a")
def connected_components(spark, d):
    c = _cells(spark, d)
    return graph.connected_components(c, spatial.radius_forest(c, R))


COMMON = f"{SPOTS}, {GRID}, edges AS (SELECT * FROM grid)"
HOPS = "walk AS (SELECT cell_id AS a, cell_id AS b, 0 AS h FROM spots UNION SELECT a, dst, h + 1 FROM walk JOIN edges ON src = b WHERE h < 5), hop AS (SELECT a, b, min(h) AS h FROM walk GROUP BY a, b)"


@query(f"WITH RECURSIVE {COMMON}, {HOPS} SELECT a AS src, b AS dst, h AS hops FROM hop")
def hop_distances(spark, d):
    return graph.hops(_spots(spark, d), _grid(spark, d), 5)


@query(f"""WITH {SPOTS}, {GRID} SELECT a.cell_id, round(coalesce(d.r * d.r / nullif(d.t * (n - 1), 0), 0), 6) AS closeness FROM spots a, (SELECT count(*) AS n FROM spots),
  LATERAL (SELECT count(*) - 1 AS r, sum(greatest(abs(a.x - b.x), abs(a.y - b.y))) AS t FROM spots b) d""")
def closeness(spark, d):
    """Hops on a full grid with diagonals are the larger coordinate difference."""
    return _rounded(graph.closeness(_spots(spark, d), _grid(spark, d)), "closeness")


@query()
def betweenness(spark, d):
    return _rounded(graph.betweenness(_spots(spark, d), _grid(spark, d)), "betweenness")


@query(f"""WITH {CELLS}, p AS (SELECT x, y, min(cell_id) AS id FROM cells GROUP BY x, y),
  e AS (SELECT a.id AS src, b.id AS dst, (a.x + b.x) / 2 AS mx, (a.y + b.y) / 2 AS my, a.y - b.y AS nx, b.x - a.x AS ny, (a.x-b.x)**2 + (a.y-b.y)**2 AS d2 FROM p a JOIN p b ON a.id < b.id),
  t AS (SELECT src, dst, d2, ((c.x - mx)**2 + (c.y - my)**2 - d2 / 4) / (2 * nullif((c.x - mx) * nx + (c.y - my) * ny, 0)) AS bound, (c.x - mx) * nx + (c.y - my) * ny AS side, (c.x - mx)**2 + (c.y - my)**2 < d2 / 4 AS inside FROM e, p c WHERE c.id NOT IN (src, dst)),
  k AS (SELECT src, dst, any_value(d2) AS d2 FROM t GROUP BY src, dst HAVING coalesce(max(bound) FILTER (side < 0), -1e300) <= coalesce(min(bound) FILTER (side > 0), 1e300) AND count(*) FILTER (side = 0 AND inside) = 0)
  SELECT src, dst, 1.0::DOUBLE AS weight, round(sqrt(d2), 6) + 0.0 AS distance FROM k UNION ALL SELECT dst, src, 1.0, round(sqrt(d2), 6) + 0.0 FROM k""")
def delaunay(spark, d):
    """An edge is one of the triangulation if some circle through its ends holds no other point: a bound on the centre from each."""
    return _rounded(spatial.delaunay_graph(_cells(spark, d)), "distance")


@query(f"WITH {KNN}, pick AS (SELECT cell_id FROM cells ORDER BY md5('7_' || cell_id), cell_id LIMIT 100) SELECT src, dst FROM edges WHERE src IN (SELECT cell_id FROM pick) AND dst IN (SELECT cell_id FROM pick)")
def subsample_graph(spark, d):
    return graph.subsample(_cells(spark, d), _knn(spark, d), 100, 7)[1].select("src", "dst")


# labels


COUNTS = f"{LABELS}, pairs AS (SELECT a.cluster AS label_src, b.cluster AS label_dst FROM labels_ a, labels_ b), seen AS (SELECT a.cluster AS label_src, b.cluster AS label_dst, count(*) AS n FROM edges JOIN cells a ON a.cell_id = src JOIN cells b ON b.cell_id = dst GROUP BY ALL)"


@query(f"WITH {KNN}, {COUNTS}, z AS (SELECT cluster, count(*) AS k FROM cells GROUP BY cluster) SELECT label_src, label_dst, coalesce(n, 0) AS n, round(coalesce(n, 0) / greatest(a.k * b.k / (SELECT count(*) FROM cells), 1.0), 6) AS value FROM pairs LEFT JOIN seen USING (label_src, label_dst) JOIN z a ON a.cluster = label_src JOIN z b ON b.cluster = label_dst")
def interaction_matrix(spark, d):
    return _rounded(permutation.interaction_matrix(_cells(spark, d), _knn(spark, d), "cluster"), "value")


@query(f"""WITH RECURSIVE {KNN}, {COUNTS}, {_moves_sql("cells")},
  z AS (SELECT cluster, sum(count(*)) OVER (ORDER BY cluster) AS hi, count(*) AS k FROM cells GROUP BY cluster),
  lab AS MATERIALIZED (SELECT perm, cell_id, cluster FROM moved JOIN z ON place >= hi - k AND place < hi),
  one AS MATERIALIZED (SELECT perm, dst, cluster AS label_src FROM edges JOIN lab ON cell_id = src),
  cnt AS (SELECT perm, label_src, cluster AS label_dst, count(*) AS n FROM one JOIN lab USING (perm) WHERE cell_id = dst GROUP BY ALL),
  nul AS (SELECT label_src, label_dst, avg(coalesce(n, 0)) AS mean, stddev_pop(coalesce(n, 0)) AS sd FROM pairs CROSS JOIN range({PERMS}) t(perm) LEFT JOIN cnt USING (perm, label_src, label_dst) GROUP BY ALL)
  SELECT label_src, label_dst, coalesce(n, 0) AS n, round(mean, 6) AS mean, round(sd, 6) AS sd, round((coalesce(n, 0) - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) + 0.0 AS z FROM pairs LEFT JOIN seen USING (label_src, label_dst) JOIN nul USING (label_src, label_dst)""")
def nhood_enrichment(spark, d):
    return _rounded(permutation.nhood_enrichment(_cells(spark, d), cut(_knn(spark, d)), "cluster", PERMS), "mean", "sd", "z")


@query(f"""WITH {CELLS}, {LABELS}, p AS (SELECT a.cluster AS label_src, b.cluster AS label_dst, sqrt((a.x-b.x)**2 + (a.y-b.y)**2) AS distance FROM cells a, cells b),
  c AS (SELECT least(floor(distance / 0.03), 9)::INT AS bin, label_src, label_dst, count(*) AS n FROM p WHERE distance < 0.3 GROUP BY ALL),
  f AS (SELECT bin::INT AS bin, a.cluster AS label_src, b.cluster AS label_dst FROM range(10) t(bin), labels_ a, labels_ b)
  SELECT bin, label_src, label_dst, coalesce(n, 0) AS n, round(coalesce(n, 0) / greatest(sum(coalesce(n, 0)) OVER (PARTITION BY bin), 1), 6) AS value FROM f LEFT JOIN c USING (bin, label_src, label_dst)""")
def co_occurrence(spark, d):
    return _rounded(permutation.co_occurrence(_cells(spark, d), "cluster", 0.0, 0.3, 10), "value")


RADII = [0.02, 0.04, 0.06, 0.08, 0.1]
RIPLEY = f"""WITH {CELLS}, r AS (SELECT unnest({RADII})::DOUBLE AS radius), area AS (SELECT (max(x) - min(x)) * (max(y) - min(y)) AS area FROM cells), z AS (SELECT cluster, count(*) AS n FROM cells GROUP BY cluster),
  p AS (SELECT a.cluster, sqrt((a.x-b.x)**2 + (a.y-b.y)**2) AS distance FROM cells a JOIN cells b ON a.cluster = b.cluster),
  c AS (SELECT z.cluster, radius, (SELECT count(*) FROM p WHERE p.cluster = z.cluster AND distance > 0 AND distance <= radius) AS pairs, n FROM z, r),
  k AS (SELECT cluster AS label, radius, pairs, area * pairs / (n * (n - 1)) AS k FROM c, area)"""


@query(RIPLEY + " SELECT label, radius, pairs, round(k, 6) AS value FROM k")
def ripley_k(spark, d):
    return _rounded(permutation.ripley(_cells(spark, d), "cluster", RADII, "K"), "value")


@query(RIPLEY + " SELECT label, radius, pairs, round(sqrt(k / pi()) - radius, 6) + 0.0 AS value FROM k")
def ripley_l(spark, d):
    return _rounded(permutation.ripley(_cells(spark, d), "cluster", RADII, "L"), "value")


SIMS = 100
ENVELOPE = f"""{RIPLEY}, box AS (SELECT cluster AS label, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n FROM cells GROUP BY cluster),
  u AS (SELECT label, sim, id, n, x0 + (('0x' || substr(md5('0x_' || label || '_' || sim || '_' || id), 1, 8))::BIGINT / 4294967296.0) * (x1 - x0) AS x, y0 + (('0x' || substr(md5('0y_' || label || '_' || sim || '_' || id), 1, 8))::BIGINT / 4294967296.0) * (y1 - y0) AS y FROM box, range({SIMS}) t(sim), LATERAL (SELECT unnest(range(1, n + 1)) AS id)),
  d AS (SELECT a.label, a.sim, sqrt((a.x-b.x)**2 + (a.y-b.y)**2) AS distance FROM u a JOIN u b ON a.label = b.label AND a.sim = b.sim),
  w AS (SELECT label, sim, radius, count(*) FILTER (distance > 0 AND distance <= radius) AS pairs FROM d, r GROUP BY ALL),
  v AS (SELECT label, radius, sqrt(area * pairs / (n * (n - 1)) / pi()) - radius AS v FROM w JOIN box USING (label), area),
  e AS (SELECT label, radius, avg(v) AS mean, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM v GROUP BY ALL)
  SELECT label, radius, round(sqrt(k / pi()) - radius, 6) + 0.0 AS value, round(mean, 6) + 0.0 AS mean, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high FROM k JOIN e USING (label, radius)"""


@query(ENVELOPE)
def ripley_envelope(spark, d):
    return _rounded(permutation.ripley_envelope(_cells(spark, d), "cluster", RADII, SIMS), "value", "mean", "low", "high")


# expression


@query(f"WITH {EXPR}, q AS (SELECT cell_id, sum(value) AS umi, count(*) FILTER (WHERE value > 0) AS genes FROM expr GROUP BY cell_id) SELECT s_suppkey AS cell_id, coalesce(umi, 0.0) AS umi, coalesce(genes, 0) AS genes FROM supplier LEFT JOIN q ON cell_id = s_suppkey WHERE coalesce(genes, 0) >= 50")
def qc_metrics(spark, d):
    return expression.quality_control(_spots(spark, d), _expr(spark, d), 50)


TOTAL = "tot AS (SELECT cell_id, sum(value) AS s FROM expr GROUP BY cell_id)"


@query(f"WITH {EXPR}, {TOTAL} SELECT cell_id, gene_id, round(log2(value / CASE WHEN s = 0 THEN 1 ELSE s END * 1e5 + 1), 6) AS value FROM expr JOIN tot USING (cell_id)")
def tpm_log2(spark, d):
    return _rounded(expression.log2_tpm(_expr(spark, d)), "value")


@query(f"WITH {EXPR}, {TOTAL}, l AS (SELECT cell_id, gene_id, log2(value / s * 1e6 + 1) AS v FROM expr JOIN tot USING (cell_id)), m AS (SELECT gene_id, sum(v) / (SELECT count(*) FROM supplier) AS m FROM l GROUP BY gene_id) SELECT cell_id, gene_id, round(v - m, 6) + 0.0 AS value FROM l JOIN m USING (gene_id)")
def cpm_log2_center(spark, d):
    return _rounded(expression.cpm_log2_center(_expr(spark, d), _spots(spark, d)), "value")


@query(f"WITH {EXPR}, {TOTAL}, k AS (SELECT gene_id, count(*) AS n FROM expr WHERE value > 0 GROUP BY gene_id) SELECT cell_id, gene_id, round(CASE WHEN n >= 5 THEN ln(1 + value / s * 1e4) ELSE 0 END, 6) AS value FROM expr JOIN tot USING (cell_id) JOIN k USING (gene_id)")
def vst_normalize(spark, d):
    return _rounded(expression.log1p_vst(_expr(spark, d), _spots(spark, d)), "value")


@query(f"WITH {EXPR}, n AS (SELECT count(*)::DOUBLE AS n FROM supplier) SELECT gene_id, round(sum(value) / any_value(n), 6) AS mean, round(sum(value * value) / any_value(n) - (sum(value) / any_value(n))**2, 4) AS var_pop FROM expr, n GROUP BY gene_id")
def gene_moments(spark, d):
    m = expression.gene_means(_expr(spark, d), _spots(spark, d))
    return _rounded(_rounded(m, "mean"), "var_pop", places=4).select("gene_id", "mean", "var_pop")


@query(f"WITH {EXPR}, t AS (SELECT gene_id, sum(value) AS total FROM expr GROUP BY gene_id) SELECT gene_id, gene_name, total FROM (SELECT p_partkey AS gene_id, p_type AS gene_name, coalesce(total, 0.0) AS total, row_number() OVER (PARTITION BY p_type ORDER BY coalesce(total, 0.0) DESC, p_partkey) AS rn FROM part LEFT JOIN t ON gene_id = p_partkey) WHERE rn = 1")
def dedup_genes(spark, d):
    genes = _t(spark, d, "part").select(F.col("p_partkey").alias("gene_id"), F.col("p_type").alias("gene_name"))
    return expression.dedup_genes(_expr(spark, d), genes)


@query(f"""WITH {EXPR}, z AS (SELECT count(*) AS z FROM part), r AS (SELECT cell_id, gene_id, rank() OVER (PARTITION BY cell_id ORDER BY value DESC) + (count(*) OVER (PARTITION BY cell_id, value) - 1) / 2.0 AS rk FROM expr WHERE value > 0),
  st AS (SELECT cell_id, count(*) AS k FROM r GROUP BY cell_id), sz AS (SELECT p_brand AS set_name, count(*) AS size FROM part GROUP BY p_brand),
  h AS (SELECT cell_id, p_brand AS set_name, sum(rk) AS sr, count(*) AS hits FROM r JOIN part ON p_partkey = gene_id GROUP BY ALL)
  SELECT s_suppkey AS cell_id, sz.set_name, round(1 - ((coalesce(sr, 0) + (size - coalesce(hits, 0)) * (coalesce(k, 0) + (z - coalesce(k, 0) + 1) / 2.0)) / size) / z, 9) AS score
  FROM supplier CROSS JOIN sz CROSS JOIN z LEFT JOIN st ON st.cell_id = s_suppkey LEFT JOIN h ON h.cell_id = s_suppkey AND h.set_name = sz.set_name""")
def ucell_score(spark, d):
    part = _t(spark, d, "part")
    genes = part.select(F.col("p_partkey").alias("gene_id"))
    sets = part.select(F.col("p_brand").alias("set_name"), F.col("p_partkey").alias("gene_id"))
    return _rounded(expression.gene_set_score(_expr(spark, d), _spots(spark, d), genes, sets), "score", places=9)


@query("WITH v AS (SELECT c_custkey, c_acctbal AS v FROM customer), k AS (SELECT greatest(round_even(count(*) * 0.05, 0), 1)::INT AS k FROM v), b AS (SELECT (SELECT v FROM (SELECT v, row_number() OVER (ORDER BY v) AS i FROM v), k WHERE i = k) AS lo, (SELECT v FROM (SELECT v, row_number() OVER (ORDER BY v DESC) AS i FROM v), k WHERE i = k) AS hi) SELECT c_custkey, round(coalesce((greatest(least(v, hi), lo) - lo) / nullif(hi - lo, 0), 0), 6) AS fraction FROM v, b")
def clip_min_max(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("fraction"))
    return _rounded(expression.clip_min_max(c, "fraction"), "fraction")


# spatial correlation


Z = "st AS (SELECT gene_id, sum(value) / (SELECT count(*) FROM spots) AS m, sqrt(sum(value * value) / (SELECT count(*) FROM spots) - (sum(value) / (SELECT count(*) FROM spots))**2) AS sd FROM few GROUP BY gene_id), z AS (SELECT s.cell_id, st.gene_id, (coalesce(value, 0) - m) / sd AS z FROM spots s CROSS JOIN st LEFT JOIN few f ON f.cell_id = s.cell_id AND f.gene_id = st.gene_id WHERE sd > 1e-6)"
MORAN = f"WITH RECURSIVE {FEW}, {SPOTS}, {GRID}, {Z} "


@query(MORAN + "SELECT a.gene_id, round(sum(a.z * b.z) / count(*), 6) + 0.0 AS i FROM grid JOIN z a ON a.cell_id = src JOIN z b ON b.cell_id = dst AND a.gene_id = b.gene_id GROUP BY a.gene_id")
def moran_univariate(spark, d):
    return _rounded(moran.univariate(_few(spark, d), _spots(spark, d), _grid(spark, d)), "i")


@query(MORAN + "SELECT a.gene_id AS gene_a, b.gene_id AS gene_b, round(sum(a.z * b.z) / count(*), 6) + 0.0 AS i FROM grid JOIN z a ON a.cell_id = src JOIN z b ON b.cell_id = dst AND b.gene_id = a.gene_id + 1 GROUP BY ALL")
def moran_bivariate(spark, d):
    pairs = spark.range(0, 40).select(F.col("id").alias("gene_a"), (F.col("id") + 1).alias("gene_b"))
    return _rounded(moran.bivariate(_few(spark, d), _spots(spark, d), _grid(spark, d), pairs), "i")


@query(MORAN + "SELECT a.gene_id AS gene_a, b.gene_id AS gene_b, round(sum(a.z * b.z) / count(*), 6) + 0.0 AS i FROM grid JOIN z a ON a.cell_id = src JOIN z b ON b.cell_id = dst GROUP BY ALL")
def moran_pairwise(spark, d):
    return _rounded(moran.pairwise(_few(spark, d), _spots(spark, d), _grid(spark, d)), "i")


@query(MORAN.rstrip() + f""", {_moves_sql("spots")},
  zp AS MATERIALIZED (SELECT perm, moved.cell_id, gene_id, z FROM moved JOIN idx ON idx.i = moved.place JOIN z ON z.cell_id = idx.cell_id),
  one AS MATERIALIZED (SELECT perm, gene_id, dst, sum(z) AS z, count(*) AS k FROM grid JOIN zp ON cell_id = src GROUP BY ALL),
  nul AS (SELECT perm, gene_id, sum(one.z * zp.z) / sum(k) AS i FROM one JOIN zp USING (perm, gene_id) WHERE cell_id = dst GROUP BY ALL),
  obs AS (SELECT a.gene_id, sum(a.z * b.z) / count(*) AS i FROM grid JOIN z a ON a.cell_id = src JOIN z b ON b.cell_id = dst AND a.gene_id = b.gene_id GROUP BY ALL),
  t AS (SELECT o.gene_id, o.i, coalesce((o.i - avg(n.i)) / nullif(CASE WHEN stddev_samp(n.i) > 1e-12 THEN stddev_samp(n.i) ELSE 0 END, 0), 0) AS z, (count(*) FILTER (WHERE n.i >= o.i - 1e-9) + 1) / {PERMS + 1}.0 AS p FROM obs o JOIN nul n USING (gene_id) GROUP BY o.gene_id, o.i)
  SELECT gene_id, round(i, 6) + 0.0 AS i, round(z, 4) + 0.0 AS z, round(p, 6) AS p FROM t""")
def moran_test(spark, d):
    t = moran.univariate_test(_few(spark, d), _spots(spark, d), cut(_grid(spark, d)), PERMS)
    return _rounded(_rounded(t, "i", "p"), "z", places=4).select("gene_id", "i", "z", "p")


# statistics


@query("WITH r AS (SELECT p_partkey, p_brand, (rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0) AS x, (rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0) AS y FROM part) SELECT p_brand, round(corr(x, y), 6) + 0.0 AS rho, count(*) AS n FROM r GROUP BY p_brand")
def spearman(spark, d):
    return _rounded(stats.spearman(_t(spark, d, "part"), ["p_brand"], "p_size", "p_retailprice"), "rho")


@query("WITH p AS (SELECT s_suppkey AS id, (('0x' || substr(md5(s_suppkey::VARCHAR), 1, 8))::BIGINT / 4294967296.0) ** 2 AS p FROM supplier), r AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM p) SELECT id, round(p, 6) AS p, round(least(min(p * n / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 1), 6) AS p_adj FROM r")
def bh_adjust(spark, d):
    u = F.conv(F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return _rounded(stats.bh_adjust(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (u * u).alias("p")), "p"), "p", "p_adj")


_G = "l_returnflag = 'R'"


@query(f"SELECT l_linestatus, round((avg(l_quantity) FILTER ({_G}) - avg(l_quantity) FILTER (NOT {_G})) / sqrt(((count(*) FILTER ({_G}) - 1) * var_samp(l_quantity) FILTER ({_G}) + (count(*) FILTER (NOT {_G}) - 1) * var_samp(l_quantity) FILTER (NOT {_G})) / (count(*) - 2)), 6) + 0.0 AS d FROM lineitem GROUP BY l_linestatus HAVING count(*) FILTER ({_G}) > 1")
def cohens_d(spark, d):
    g = _t(spark, d, "lineitem").groupBy("l_linestatus").agg(F.count_if(F.expr(_G)).alias("n"), stats.cohens_d(F.expr(_G), F.col("l_quantity")).alias("d"))
    return _rounded(g.where("n > 1").select("l_linestatus", "d"), "d")


@query(f"WITH s AS (SELECT l_linestatus, avg(l_extendedprice) FILTER ({_G}) AS a, avg(l_extendedprice) FILTER (NOT {_G}) AS b, var_samp(l_extendedprice) FILTER ({_G}) / count(*) FILTER ({_G}) AS va, var_samp(l_extendedprice) FILTER (NOT {_G}) / count(*) FILTER (NOT {_G}) AS vb FROM lineitem GROUP BY l_linestatus HAVING count(*) FILTER ({_G}) > 1) SELECT l_linestatus, round((a - b) / sqrt(va + vb), 6) + 0.0 AS t FROM s")
def welch_t(spark, d):
    t, _ = stats.welch_t(F.expr(_G), F.col("l_extendedprice"))
    g = _t(spark, d, "lineitem").groupBy("l_linestatus").agg(F.count_if(F.expr(_G)).alias("n"), t.alias("t"))
    return _rounded(g.where("n > 1").select("l_linestatus", "t"), "t")


@query("WITH r AS (SELECT p_brand, p_size > 25 AS g, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS rk FROM part) SELECT p_brand, round(sum(rk) FILTER (g) - count(*) FILTER (g) * (count(*) FILTER (g) + 1) / 2, 6) AS u FROM r GROUP BY p_brand HAVING count(*) FILTER (g) > 0")
def mann_whitney(spark, d):
    p = _t(spark, d, "part").withColumn("g", F.col("p_size") > 25)
    return _rounded(stats.mann_whitney(p, ["p_brand"], "g", "p_retailprice").where("n1 > 0").select("p_brand", "u"), "u")


# interaction


def _fractions(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a customer's orders by priority."""
    o = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("cell_id"), F.col("o_orderpriority").alias("cell_type")).agg(F.sum("o_totalprice").alias("v"))
    types = _t(spark, d, "orders").select(F.col("o_orderpriority").alias("cell_type")).distinct()
    full = o.select("cell_id").distinct().crossJoin(F.broadcast(types)).join(o, ["cell_id", "cell_type"], "left")
    return full.select("cell_id", "cell_type", (F.coalesce("v", F.lit(0.0)) / F.sum("v").over(Window.partitionBy("cell_id"))).alias("fraction"))


FRACTIONS = "o AS (SELECT o_custkey AS cell_id, o_orderpriority AS cell_type, sum(o_totalprice) AS v FROM orders GROUP BY ALL), fr AS (SELECT c.cell_id, t.cell_type, coalesce(v, 0) / sum(v) OVER (PARTITION BY c.cell_id) AS fraction FROM (SELECT DISTINCT cell_id FROM o) c CROSS JOIN (SELECT DISTINCT cell_type FROM o) t LEFT JOIN o USING (cell_id, cell_type))"
URGENT, LOW = "1-URGENT", "5-LOW"


@query(f"WITH {FRACTIONS}, f AS (SELECT cell_id, cell_type, round_even(fraction, 2) AS f FROM fr), r AS (SELECT *, rank() OVER (PARTITION BY cell_type ORDER BY f) + (count(*) OVER (PARTITION BY cell_type, f) - 1) / 2.0 AS r FROM f) SELECT a.cell_type AS type_a, b.cell_type AS type_b, round(corr(a.r, b.r), 3) + 0.0 AS rho, round(avg(a.f * b.f), 6) AS mean_product FROM r a JOIN r b ON a.cell_id = b.cell_id AND a.cell_type <> b.cell_type GROUP BY ALL")
def spearman_colocalization(spark, d):
    return _rounded(interaction.colocalization(_fractions(spark, d)), "rho", "mean_product").select("type_a", "type_b", "rho", "mean_product")


@query(f"""WITH {FRACTIONS}, w AS (SELECT cell_id, max(fraction) FILTER (cell_type = '{URGENT}') AS a, max(fraction) FILTER (cell_type = '{LOW}') AS b FROM fr GROUP BY cell_id),
  q AS (SELECT quantile_cont(a, 0.75) AS a75, quantile_cont(a, 0.85) AS a85, quantile_cont(b, 0.75) AS b75, quantile_cont(b, 0.85) AS b85 FROM w)
  SELECT cell_id, CASE WHEN a > a85 AND b > b85 THEN 'Both' WHEN a > a85 AND b < b75 THEN '{URGENT}' WHEN b > b85 AND a < a75 THEN '{LOW}' ELSE 'Other' END AS "group" FROM w, q""")
def cell_type_pair_groups(spark, d):
    return interaction.cell_type_groups(_fractions(spark, d), URGENT, LOW)


@query(f"WITH {FRACTIONS} SELECT cell_id, cell_type FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY fraction DESC, cell_type) AS rn FROM fr) WHERE rn = 1")
def most_abundant_type(spark, d):
    return interaction.most_abundant(_fractions(spark, d))


@query(f"""WITH {EXPR}, {TOTAL}, l AS (SELECT cell_id, gene_id, log2(value / s * 1e6 + 1) AS v FROM expr JOIN tot USING (cell_id)), p AS (SELECT DISTINCT p_partkey AS ligand, p_partkey % 100 + 1 AS receptor FROM part),
  x AS (SELECT a.cell_id, sum(a.v * b.v) AS s FROM l a JOIN p ON ligand = a.gene_id JOIN l b ON b.gene_id = receptor AND b.cell_id = a.cell_id GROUP BY a.cell_id)
  SELECT s_suppkey AS cell_id, round(coalesce(s, 0) / (SELECT count(*) FROM p), 6) AS score FROM supplier LEFT JOIN x ON x.cell_id = s_suppkey""")
def lr_raw_score(spark, d):
    return _rounded(interaction.lr_raw_score(_expr(spark, d), _spots(spark, d), _lr(spark, d)), "score")


def _lr(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_partkey").alias("ligand"), (F.col("p_partkey") % 100 + 1).alias("receptor")).distinct()


@query()
def lr_network_score(spark, d):
    return interaction.lr_network_score(_expr(spark, d), _spots(spark, d), _lr(spark, d))


HEX = "hex AS (SELECT s_suppkey AS cell_id, s_suppkey // 10 AS r, (s_suppkey % 10) * 2 + (s_suppkey // 10) % 2 AS c, (s_acctbal + 1000) / 11000 AS f FROM supplier)"
INTERFACE = "near AS (SELECT DISTINCT a.cell_id FROM hex a JOIN hex b ON (abs(a.r - b.r), abs(a.c - b.c)) IN ((0, 2), (1, 1)) WHERE b.f >= 0.5), lab AS (SELECT cell_id, CASE WHEN f >= 0.5 THEN 'Tumor' WHEN cell_id IN (SELECT cell_id FROM near) THEN 'Interface' ELSE 'Stroma' END AS label FROM hex)"


def _hex(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("s_suppkey")
    r, c = F.floor(k / 10), (k % 10) * 2 + F.floor(k / 10) % 2
    s = _t(spark, d, "supplier")
    cells = s.select(k.alias("cell_id"), F.concat_ws("x", r, c).alias("cell_name"), c.cast("double").alias("x"), r.cast("double").alias("y"))
    return cells, s.select(k.alias("cell_id"), F.lit("Malignant").alias("cell_type"), ((F.col("s_acctbal") + 1000) / 11000).alias("fraction"))


@query(f"WITH {HEX}, {INTERFACE} SELECT cell_id, label FROM lab")
def interface_labels(spark, d):
    return interaction.interface(*_hex(spark, d))


@query(f"WITH {HEX}, {INTERFACE} SELECT a.cell_id, round(min(sqrt((a.c - b.c)**2 + (a.r - b.r)**2)), 6) AS distance FROM hex a, hex b JOIN lab ON lab.cell_id = b.cell_id WHERE lab.label = 'Tumor' GROUP BY a.cell_id")
def nearest_border_distance(spark, d):
    cells, f = _hex(spark, d)
    tumor = interaction.interface(cells, f).where("label = 'Tumor'")
    return _rounded(spatial.nearest_distance(cells, cells.join(tumor, "cell_id", "left_semi")), "distance")


@query(f"WITH {HEX}, {INTERFACE} SELECT cell_id, CASE WHEN label = 'Stroma' AND cell_id % 3 = 0 THEN 'Interaction' ELSE label END AS label FROM lab")
def combined_interface(spark, d):
    cells, f = _hex(spark, d)
    groups = cells.select("cell_id", F.when(F.col("cell_id") % 3 == 0, "Both").otherwise("Other").alias("group"))
    return interaction.combine_interface(interaction.interface(cells, f), groups)


# signalling


def _signals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells, and which of five proteins each expresses and answers to, by its id."""
    c = _cells(spark, d)
    p = c.select("cell_id").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    value = lambda m: p.select("cell_id", F.concat(F.lit("p"), "k").alias("protein"), (F.pmod(F.col("cell_id") * (F.col("k") + m), F.lit(7)) - 3).cast("double").alias("value"))
    return c, value(2), value(3)


CCC = f"""{CELLS}, pk AS (SELECT cell_id, k FROM cells, range(5) t(k)), e AS (SELECT cell_id, 'p' || k AS protein, ((cell_id * (k + 2)) % 7 - 3)::DOUBLE AS value FROM pk), v AS (SELECT cell_id, 'p' || k AS protein, ((cell_id * (k + 3)) % 7 - 3)::DOUBLE AS value FROM pk),
  near AS (SELECT a.cell_id AS src, b.cell_id AS dst, a.cluster AS sender, b.cluster AS receiver FROM cells a JOIN cells b ON a.cluster <> b.cluster AND sqrt((a.x-b.x)**2 + (a.y-b.y)**2) <= {R}),
  z AS (SELECT cluster, count(*) AS n FROM cells GROUP BY cluster),
  pr AS (SELECT sender, receiver, count(*) AS neighboring_pairs, count(DISTINCT src) AS ts, count(DISTINCT dst) AS tr FROM near GROUP BY ALL),
  talk AS (SELECT sender, receiver, e.protein, count(*) AS communicating_pairs FROM near JOIN e ON e.cell_id = src AND e.value > 0 JOIN v ON v.cell_id = dst AND v.protein = e.protein AND v.value > 0 GROUP BY ALL),
  ccc AS (SELECT sender, protein, receiver, a.n AS sender_count, b.n AS receiver_count, neighboring_pairs, communicating_pairs, communicating_pairs / neighboring_pairs AS ratio FROM talk JOIN pr USING (sender, receiver) JOIN z a ON a.cluster = sender JOIN z b ON b.cluster = receiver WHERE ts >= 0.05 * a.n OR tr >= 0.05 * b.n)"""


@query(f"WITH {CCC} SELECT sender, protein, receiver, sender_count, receiver_count, neighboring_pairs, communicating_pairs, round(ratio, 6) AS ratio FROM ccc")
def ccc_counts(spark, d):
    c, e, v = _signals(spark, d)
    return _rounded(signaling.ccc_counts(c, "cluster", e, v, R), "ratio")


@query(f"WITH {CCC} SELECT sender, protein, receiver, count(*) AS n FROM ccc GROUP BY GROUPING SETS ((sender, protein), (protein, receiver), (sender), (protein), (receiver))")
def ccc_sankey_grouping_sets(spark, d):
    c, e, v = _signals(spark, d)
    return signaling.sankey(signaling.ccc_counts(c, "cluster", e, v, R))


@query(f"WITH {CCC} SELECT sender, receiver, count(*) AS n FROM ccc GROUP BY CUBE (sender, receiver)")
def ccc_matrix(spark, d):
    c, e, v = _signals(spark, d)
    return signaling.ccc_matrix(signaling.ccc_counts(c, "cluster", e, v, R))


def _strips(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells, and proteins that are expressed and active in strips of the plane, so that neighbours agree more than others."""
    c = _cells(spark, d)
    p = c.select("cell_id", "x", "y", "cluster").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    live = (F.pmod(F.floor(F.col("x") * 16) + F.col("k"), F.lit(2)) == 0) & (F.pmod(F.col("cell_id") + F.col("k"), F.lit(7)) > 0)
    value = lambda m: p.select("cell_id", F.concat(F.lit("p"), "k").alias("protein"), F.when(live, 1 + F.pmod(F.col("cell_id") * m, F.lit(3))).otherwise(0).cast("double").alias("value"))
    return c, value(1), value(2)


def _strip_sql(m: int) -> str:
    return f"SELECT cell_id, k AS protein, CASE WHEN (((floor(x * 16)::BIGINT + k) % 2) + 2) % 2 = 0 AND (cell_id + k) % 7 > 0 THEN 1 + (cell_id * {m}) % 3 ELSE 0 END::DOUBLE AS value FROM cells, range(5) t(k)"


def _drawn_sql(at: str, n: str) -> str:
    one = f"((((start + {at}) % 2147483647) * 48271 + 11) % 2147483647)"
    two = f"(({one} * {one} + {one} * 69621 + 7) % 2147483647)"
    return f"((({two} * {two} + 16807) % 2147483647) % {n})"


@query(f"""WITH {CELLS.replace("label::VARCHAR", "label::INT")}, e AS ({_strip_sql(1)}), v AS ({_strip_sql(2)}),
  near AS (SELECT a.cell_id AS src, b.cell_id AS dst, a.cluster AS sender, b.cluster AS receiver FROM cells a JOIN cells b ON a.cluster <> b.cluster AND sqrt((a.x-b.x)**2 + (a.y-b.y)**2) <= {R}),
  z AS (SELECT cluster, count(*) AS n FROM cells GROUP BY cluster),
  pr AS (SELECT sender, receiver, count(*) AS n, count(DISTINCT src) AS ts, count(DISTINCT dst) AS tr FROM near GROUP BY ALL),
  talk AS (SELECT sender, receiver, e.protein, count(*) FILTER (e.value > 0 AND v.value > 0) AS c, sum(e.value * v.value) AS total FROM near JOIN e ON e.cell_id = src JOIN v ON v.cell_id = dst AND v.protein = e.protein GROUP BY ALL),
  seen AS MATERIALIZED (SELECT sender, talk.protein, receiver, a.n AS sender_count, b.n AS receiver_count, pr.n AS neighboring_pairs, c AS communicating_pairs, c / pr.n AS ratio, total / pr.n AS mean, greatest(sender, receiver) AS hi, least(sender, receiver) AS lo FROM talk JOIN pr USING (sender, receiver) JOIN z a ON a.cluster = sender JOIN z b ON b.cluster = receiver WHERE (ts >= 0.05 * a.n OR tr >= 0.05 * b.n) AND c / pr.n > 0.2),
  pl AS MATERIALIZED (SELECT cell_id, cluster, row_number() OVER (PARTITION BY cluster ORDER BY cell_id) - 1 AS place FROM cells),
  pq AS (SELECT DISTINCT hi, lo, neighboring_pairs AS n, ('0x' || substr(md5('0_' || hi || '_' || lo), 1, 7))::BIGINT AS start FROM seen),
  sl AS (SELECT hi, lo, n, start, unnest(range(n * 1000)) AS k FROM pq),
  dr AS (SELECT hi, lo, k // sl.n AS draw, {_drawn_sql("2 * k", "a.n")} AS pi_, {_drawn_sql("2 * k + 1", "b.n")} AS pj FROM sl JOIN z a ON a.cluster = hi JOIN z b ON b.cluster = lo),
  ch AS MATERIALIZED (SELECT hi, lo, draw, i.cell_id AS ci, j.cell_id AS cj FROM dr JOIN pl i ON i.cluster = hi AND i.place = pi_ JOIN pl j ON j.cluster = lo AND j.place = pj),
  both_ AS (SELECT hi AS sender, lo AS receiver, draw, ci AS src, cj AS dst FROM ch UNION ALL SELECT lo, hi, draw, cj, ci FROM ch),
  nu AS (SELECT s.sender, s.protein, s.receiver, draw, any_value(s.mean) AS mean, avg(e.value * v.value) AS null_ FROM seen s JOIN both_ b ON b.sender = s.sender AND b.receiver = s.receiver JOIN e ON e.protein = s.protein AND e.cell_id = b.src JOIN v ON v.protein = s.protein AND v.cell_id = b.dst GROUP BY ALL),
  p AS MATERIALIZED (SELECT sender, protein, receiver, (count(*) FILTER (null_ >= mean) + 1) / 1001.0 AS pv FROM nu GROUP BY ALL)
  SELECT sender::VARCHAR AS sender, 'p' || protein AS protein, receiver::VARCHAR AS receiver, sender_count, receiver_count, neighboring_pairs, communicating_pairs, round(ratio, 6) AS ratio, round(pv, 6) AS pv, round(p_adj, 6) AS pv_adj FROM {_bh_sql("(SELECT * FROM seen JOIN p USING (sender, protein, receiver))", "pv")} WHERE p_adj < 0.01""")
def spatial_ccc(spark, d):
    c, e, v = _strips(spark, d)
    return _rounded(signaling.spatial_ccc(c, "cluster", e, v, R), "ratio", "pv", "pv_adj")


FLOW = f"""{RADIUS}, fl AS (SELECT b.cell_id, b.x, b.y, coalesce((b.x - a.x) / nullif(distance, 0), 0) AS ux, coalesce((b.y - a.y) / nullif(distance, 0), 0) AS uy, (a.cell_id % 5)::DOUBLE * greatest(b.cell_id % 7 - 3, 0) AS f FROM edges JOIN cells a ON a.cell_id = src JOIN cells b ON b.cell_id = dst),
  g AS (SELECT cell_id, x, y, avg(ux * f) AS mx, avg(uy * f) AS my, sum(f) AS total FROM fl WHERE f > 0 GROUP BY ALL),
  v AS (SELECT cell_id, x, y, coalesce(mx / nullif(sqrt(mx**2 + my**2), 0), 0) * total AS dx, coalesce(my / nullif(sqrt(mx**2 + my**2), 0), 0) * total AS dy, total FROM g)"""


@query(f"WITH {FLOW} SELECT cell_id, round(dx, 6) + 0.0 AS dx, round(dy, 6) + 0.0 AS dy, round(total, 6) AS total FROM v")
def velocity_arrows(spark, d):
    c = _cells(spark, d)
    e, a = c.select("cell_id", (F.col("cell_id") % 5).cast("double").alias("value")), c.select("cell_id", (F.col("cell_id") % 7 - 3).cast("double").alias("value"))
    return _rounded(signaling.velocity_within(c, e, a, R), "dx", "dy", "total").select("cell_id", "dx", "dy", "total")


@query("WITH l AS (SELECT l_suppkey, l_linenumber, sum(l_quantity * ((l_suppkey % 7 = l_linenumber)::INT * 9 + 1)) AS q FROM lineitem GROUP BY ALL), w AS (SELECT l_suppkey, max(q) FILTER (l_linenumber = 1) AS a, max(q) FILTER (l_linenumber <> 1) AS b FROM l GROUP BY ALL) SELECT l_suppkey::VARCHAR AS gene, a AS weight FROM w WHERE a >= 2 * coalesce(b, 0)")
def pattern_genes(spark, d):
    heavy = F.when(F.col("l_suppkey") % 7 == F.col("l_linenumber"), 10).otherwise(1)
    w = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("gene"), F.col("l_linenumber").alias("pattern")).agg(F.sum(F.col("l_quantity") * heavy).alias("weight"))
    return signaling.pattern_genes(w, 1)


# survival


def _survival(spark: SparkSession, d: str) -> DataFrame:
    """A customer's time is the days to the first order, its event whether that order is closed."""
    o = _t(spark, d, "orders").groupBy("o_custkey").agg(F.datediff(F.min("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("double").alias("time"), F.min("o_orderstatus").alias("s"))
    c = _t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_mktsegment", F.col("c_acctbal").alias("value"), "time", (F.col("s") == "F").cast("int").alias("event"))


SURV = "o AS (SELECT o_custkey, date_diff('day', DATE '1990-01-01', min(o_orderdate)::DATE)::DOUBLE AS time, min(o_orderstatus) AS s FROM orders GROUP BY o_custkey), sv AS (SELECT c_custkey, c_mktsegment, c_acctbal AS value, time, (s = 'F')::INT AS event FROM customer JOIN o ON o_custkey = c_custkey)"


@query(f"""WITH {SURV}, t AS (SELECT c_mktsegment, time, sum(event)::BIGINT AS events, count(*) AS n FROM sv GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY c_mktsegment ORDER BY time DESC)::BIGINT AS at_risk FROM t)
  SELECT c_mktsegment, time, events, at_risk, round(CASE WHEN max((events = at_risk)::INT) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) ELSE 0 END) OVER w) END, 6) AS survival FROM r WINDOW w AS (PARTITION BY c_mktsegment ORDER BY time)""")
def kaplan_meier(spark, d):
    return _rounded(survival.kaplan_meier(_survival(spark, d), ["c_mktsegment"]), "survival")


@query(f"""WITH {SURV}, g AS (SELECT *, CASE WHEN value >= quantile_cont(value, 0.5) OVER (PARTITION BY c_mktsegment) THEN 'High' ELSE 'Low' END AS g FROM sv),
  t AS (SELECT c_mktsegment, time, sum(event) AS d, count(*) AS m, sum(event * (g = 'Low')::INT) AS d1, sum((g = 'Low')::INT) AS m1 FROM g GROUP BY ALL),
  r AS (SELECT *, sum(m) OVER w AS n, sum(m1) OVER w AS n1 FROM t WINDOW w AS (PARTITION BY c_mktsegment ORDER BY time DESC)),
  s AS (SELECT c_mktsegment, sum(d1)::DOUBLE AS observed, sum(d * n1 / n) AS expected, sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS variance FROM r WHERE d > 0 GROUP BY c_mktsegment)
  SELECT c_mktsegment, observed, round(expected, 6) AS expected, round(variance, 6) AS variance, round(coalesce((observed - expected)**2 / nullif(variance, 0), 0), 6) AS chi2 FROM s""")
def logrank_stat(spark, d):
    g = survival.split(_survival(spark, d), "value", ["c_mktsegment"])
    return _rounded(survival.logrank(g, "group", ["c_mktsegment"], pvalue=False), "expected", "variance", "chi2")


@query("""WITH q AS (SELECT quantile_cont(c_acctbal, 1/3.0) AS lo, quantile_cont(c_acctbal, 2/3.0) AS hi FROM customer) SELECT c_custkey, CASE WHEN c_acctbal >= hi THEN 'High' ELSE 'Low' END AS "group" FROM customer, q WHERE c_acctbal >= hi OR c_acctbal <= lo""")
def tertile_split(spark, d):
    return survival.split(_t(spark, d, "customer"), "c_acctbal", how="tertile").select("c_custkey", "group")


@query()
def cox_univariate(spark, d):
    return survival.cox(_survival(spark, d), "c_mktsegment", "value")


# rasters


def _pixels(spark: SparkSession, d: str, shift: int = 0) -> DataFrame:
    """A mask of 50 x 50: the label of a pixel is the first part of the lines there."""
    l = _t(spark, d, "lineitem").where("l_partkey <= 60")
    row, col = F.floor("l_quantity").cast("int"), F.pmod(F.col("l_suppkey") + F.lit(shift), F.lit(50)).cast("int")
    return l.groupBy(row.alias("row"), col.alias("col")).agg((F.min("l_partkey") % 20 + 1).cast("int").alias("label"))


def _px(shift: int, name: str) -> str:
    return f"{name} AS (SELECT floor(l_quantity)::INT AS row, ((l_suppkey + {shift}) % 50)::INT AS col, (min(l_partkey) % 20 + 1)::INT AS label FROM lineitem WHERE l_partkey <= 60 GROUP BY ALL)"


PX = _px(0, "px")


@query(f"WITH {PX} SELECT label, count(*) AS area, round(avg(row), 6) AS centroid_row, round(avg(col), 6) AS centroid_col FROM px GROUP BY label")
def mask_areas_centroids(spark, d):
    return _rounded(raster.segments(_pixels(spark, d)), "centroid_row", "centroid_col")


@query(f"WITH {PX}, s AS (SELECT unnest([0, 0, 1, -1]) AS dr, unnest([1, -1, 0, 0]) AS dc) SELECT p.row, p.col, p.label FROM px p CROSS JOIN s LEFT JOIN px q ON q.row = p.row + dr AND q.col = p.col + dc GROUP BY ALL HAVING count(*) FILTER (q.label = p.label) < 4")
def mask_boundaries(spark, d):
    return raster.boundaries(_pixels(spark, d))


@query(f"WITH {PX}, {_px(1, 'qx')}, a AS (SELECT label, count(*) AS n FROM px GROUP BY label), b AS (SELECT label, count(*) AS n FROM qx GROUP BY label), i AS (SELECT px.label AS predicted, qx.label AS truth, count(*) AS intersection FROM px JOIN qx USING (row, col) GROUP BY ALL) SELECT predicted, truth, intersection, round(intersection / (a.n + b.n - intersection), 6) AS iou FROM i JOIN a ON a.label = predicted JOIN b ON b.label = truth")
def mask_iou(spark, d):
    return _rounded(raster.iou(_pixels(spark, d), _pixels(spark, d, 1)), "iou")


@query(f"""WITH {PX}, t AS (SELECT row, col, label + 100 AS label FROM px WHERE (row * 7 + col * 3 + label) % 10 < 4 + label % 7),
  a AS (SELECT label, count(*) AS n FROM px GROUP BY label), b AS (SELECT label, count(*) AS n FROM t GROUP BY label), i AS (SELECT px.label AS p, t.label AS q, count(*) AS n FROM px JOIN t USING (row, col) GROUP BY ALL),
  m AS (SELECT count(*) AS tp, coalesce(avg(i.n / (a.n + b.n - i.n)), 0) AS iou FROM i JOIN a ON a.label = p JOIN b ON b.label = q WHERE i.n / (a.n + b.n - i.n) >= 0.5),
  s AS (SELECT tp, iou, (SELECT count(*) FROM a) AS np, (SELECT count(*) FROM b) AS nt, (SELECT count(*) FROM px) AS ap, (SELECT count(*) FROM t) AS aq, (SELECT sum(n) FROM i) AS both_ FROM m)
  SELECT tp, np - tp AS fp, nt - tp AS fn, round(tp / np, 6) AS precision, round(tp / nt, 6) AS recall, round(2 * tp / (np + nt), 6) AS f1, round(iou, 6) AS mean_iou, round(both_ / (ap + aq - both_), 6) AS foreground_iou FROM s""")
def segmentation_metrics(spark, d):
    p = _pixels(spark, d)
    truth = p.where("(row * 7 + col * 3 + label) % 10 < 4 + label % 7").withColumn("label", F.col("label") + 100)
    return _rounded(raster.segmentation_metrics(p, truth), "precision", "recall", "f1", "mean_iou", "foreground_iou")


@query(f"WITH {PX}, a AS (SELECT label, row_number() OVER (ORDER BY label)::INT AS k FROM (SELECT label FROM px GROUP BY label HAVING count(*) BETWEEN 10 AND 100000)) SELECT row, col, k AS label FROM px JOIN a USING (label)")
def filter_by_size(spark, d):
    return raster.filter_by_size(_pixels(spark, d), 10, 100_000)


@query(f"WITH {PX} SELECT row, col, label FROM px WHERE label NOT IN (SELECT label FROM px WHERE row <= 1 OR row >= 50 OR col <= 0 OR col >= 49)")
def remove_edge_cells(spark, d):
    return raster.remove_edge_cells(_pixels(spark, d).where("label % 2 = 0 or (row between 2 and 49 and col between 1 and 48)"), 51, 50)


ORACLE_SQL["remove_edge_cells"] = f"WITH {PX}, q AS (SELECT * FROM px WHERE label % 2 = 0 OR (row BETWEEN 2 AND 49 AND col BETWEEN 1 AND 48)) SELECT row, col, label FROM q WHERE label NOT IN (SELECT label FROM q WHERE row <= 0 OR row >= 50 OR col <= 0 OR col >= 49)"


@query(f"WITH {PX}, s AS (SELECT r, c FROM range(-2, 3) t(r), range(-2, 3) u(c) WHERE r * r + c * c <= 4) SELECT (row + r)::INT AS row, (col + c)::INT AS col, min(label) AS label FROM px, s WHERE row + r BETWEEN 0 AND 59 AND col + c BETWEEN 0 AND 49 GROUP BY ALL")
def expand_masks(spark, d):
    return raster.expand(_pixels(spark, d), 60, 50, 2)


@query(f"WITH RECURSIVE {PX}, fg AS (SELECT row, col, (row::BIGINT << 32) + col AS id FROM px WHERE label % 3 = 0), e AS (SELECT a.id AS s, b.id AS t FROM fg a JOIN fg b ON abs(a.row - b.row) + abs(a.col - b.col) = 1), reach AS (SELECT id AS a, id AS b FROM fg UNION SELECT a, t FROM reach JOIN e ON s = b), m AS (SELECT a, min(b) AS c FROM reach GROUP BY a) SELECT row, col, dense_rank() OVER (ORDER BY c)::INT AS label FROM fg JOIN m ON a = id")
def raster_components(spark, d):
    return raster.components(_pixels(spark, d).where("label % 3 = 0").select("row", "col"))


@query(f"WITH {PX}, e AS (SELECT p.row, p.col, p.label FROM px p CROSS JOIN (SELECT unnest([0, 0, 1, -1]) AS dr, unnest([1, -1, 0, 0]) AS dc) s LEFT JOIN px q ON q.row = p.row + dr AND q.col = p.col + dc GROUP BY ALL HAVING count(*) FILTER (q.label = p.label) < 4), b AS (SELECT label, count(*) AS n FROM e GROUP BY label) SELECT label, round(CASE WHEN n IS NULL THEN 1 ELSE 4 * pi() * a / (n * n) END, 6) AS circularity FROM (SELECT label, count(*) AS a FROM px GROUP BY label) LEFT JOIN b USING (label)")
def mask_circularity(spark, d):
    return _rounded(raster.circularity(_pixels(spark, d)), "circularity")


def _transcripts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select((F.col("l_suppkey") % 60).cast("double").alias("x"), (F.col("l_quantity") * 1.1).alias("y"), F.col("l_returnflag").alias("gene"))


TR = "tr AS (SELECT least(greatest(trunc(l_quantity * 1.1)::INT, 0), 50) AS row, least(greatest((l_suppkey % 60)::INT, 0), 49) AS col, l_returnflag AS gene FROM lineitem), asg AS (SELECT coalesce(label, 0)::INT AS label, gene FROM tr LEFT JOIN px USING (row, col))"


@query(f"WITH {PX}, {TR} SELECT label, gene, count(*) AS n FROM asg GROUP BY ALL")
def transcript_assign(spark, d):
    return raster.assign(_transcripts(spark, d), _pixels(spark, d), 51, 50).groupBy("label", "gene").agg(F.count("*").alias("n"))


@query(f"WITH {PX}, {TR}, c AS (SELECT label, gene, count(*) AS n FROM asg WHERE label > 0 GROUP BY ALL), k AS (SELECT *, sum(n) OVER (PARTITION BY label) AS t FROM c), a AS (SELECT label, count(*) AS area FROM px GROUP BY label) SELECT label, gene, n, area FROM k JOIN a USING (label) WHERE t >= 10")
def transcript_counts(spark, d):
    p = _pixels(spark, d)
    return raster.transcript_counts(raster.assign(_transcripts(spark, d), p, 51, 50), p).select("label", "gene", "n", "area")


@query(f"WITH {PX}, {TR}, c AS (SELECT label, count(*) AS n FROM asg WHERE label > 0 GROUP BY label) SELECT label, round(coalesce(n, 0) / area, 6) AS density FROM (SELECT label, count(*) AS area FROM px GROUP BY label) LEFT JOIN c USING (label)")
def transcript_density(spark, d):
    p = _pixels(spark, d)
    return _rounded(raster.transcript_density(raster.assign(_transcripts(spark, d), p, 51, 50), p), "density")


# deconvolution


@query(f"""WITH {EXPR}, {TOTAL}, c AS (SELECT cell_id, gene_id, value / s * 1e5 AS v FROM expr JOIN tot USING (cell_id)), who AS (SELECT s_suppkey AS cell_id, n_name AS sub, r_name AS major FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
  b AS (SELECT cell_id, major AS cell_type FROM who UNION SELECT cell_id, sub FROM who), n AS (SELECT cell_type, count(*) AS n FROM b GROUP BY cell_type)
  SELECT gene_id, cell_type, round(sum(v) / any_value(n), 6) AS value FROM c JOIN b USING (cell_id) JOIN n USING (cell_type) GROUP BY gene_id, cell_type""")
def generate_reference(spark, d):
    a, l = _annotation(spark, d)
    return _rounded(deconvolution.generate_reference(_expr(spark, d), a, l), "value")


def _annotation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    a = _t(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("cell_id"), F.col("n_name").alias("sub"))
    return a, n.select(F.col("r_name").alias("major"), F.col("n_name").alias("sub"))


@query(f"WITH {EXPR}, {TOTAL}, pick AS (SELECT s_suppkey AS cell_id FROM supplier WHERE s_acctbal > 5000) SELECT gene_id, round(sum(value / s * 1e6) / (SELECT count(*) FROM pick), 6) AS value FROM expr JOIN tot USING (cell_id) JOIN pick USING (cell_id) GROUP BY gene_id")
def malignant_reference(spark, d):
    chosen = _t(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("cell_id"))
    return _rounded(deconvolution.malignant_reference(_expr(spark, d), chosen), "value")


@query("WITH a AS (SELECT c_custkey AS cell_id, c_mktsegment AS sub FROM customer) SELECT cell_id, sub FROM (SELECT *, row_number() OVER (PARTITION BY sub ORDER BY md5('123_' || cell_id), cell_id) AS rn FROM a) WHERE rn <= 20")
def downsample_cells(spark, d):
    return deconvolution.downsample(_t(spark, d, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("sub")), 20)


@query()
def nnls_deconvolution(spark, d):
    a, l = _annotation(spark, d)
    e = _expr(spark, d)
    ref = cut(deconvolution.generate_reference(e, a, l))
    sig = ref.withColumn("rn", F.row_number().over(Window.partitionBy("cell_type").orderBy(F.desc("value"), "gene_id"))).where("rn <= 50").select("cell_type", "gene_id")
    return deconvolution.deconvolve(e, _spots(spark, d), ref, l, sig)


@query()
def ridge_activity(spark, d):
    sig = _t(spark, d, "part").select(F.col("p_partkey").alias("gene_id"), F.col("p_brand").alias("protein"), (F.col("p_size") / 50).alias("weight"))
    return signaling.ridge_activity(expression.log2_tpm(_expr(spark, d)), sig)


@query()
def nmf_patterns(spark, d):
    act = _few(spark, d).select("cell_id", F.col("gene_id").cast("string").alias("protein"), F.col("value").alias("zscore"))
    return deconvolution.signaling_patterns(act, [2, 3, 4])[1]


@query()
def cluster_cells(spark, d):
    return deconvolution.cluster_cells(_few(spark, d), _spots(spark, d), n_pcs=10)


# plots and streams


@query(f"WITH {EXPR}, {SPOTS}, {TOTAL} SELECT spots.cell_id, x, y, round(coalesce(log2(value / s * 1e6 + 1), 0), 6) AS value FROM spots LEFT JOIN expr ON expr.cell_id = spots.cell_id AND gene_id = 7 LEFT JOIN tot ON tot.cell_id = spots.cell_id")
def gene_expression_plot(spark, d):
    return _rounded(plotdata.gene_expression(_spots(spark, d), _expr(spark, d), 7), "value")


@query("SELECT round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 4) AS intercept FROM part")
def linear_fit(spark, d):
    return _rounded(_rounded(plotdata.linear_fit(_t(spark, d, "part"), "p_size", "p_retailprice"), "slope"), "intercept", places=4)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    w = streaming.event_windows(_t(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))
    return _rounded(w, "total", places=4)


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark, d):
    return streaming.sessions(_t(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))




from . import catalog_spots  # noqa: E402, F401  adds its queries to this one's
