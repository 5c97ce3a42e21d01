"""More queries of the catalogue: markers, malignant inference, interaction tests and masks, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import CCC, CELLS, EXPR, FLOW, FRACTIONS, GRID, HEX, INTERFACE, LOW, PX, SPOTS, TOTAL, URGENT, R, _annotation, _bh_sql, _cells, _expr, _fractions, _grid, _hex, _normal_tail_sql, _pixels, _px, _rounded, _signals, _spots, _t, _t_tail_sql, query
from .functions import stats
from .operators import deconvolution, expression, graph, interaction, raster, signaling, spatial
from .plans import deconvolution as plans
from .plans import plotdata

# markers


def _panel(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All lines as 40 genes of suppliers; a gene is stronger in one region, and in one nation."""
    n, k = F.col("s_nationkey"), F.col("l_partkey") % 40
    lines = _t(spark, d, "lineitem").join(_t(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(_t(spark, d, "nation"), n == F.col("n_nationkey"))
    strong = 1 + F.when(k % 5 == F.col("n_regionkey"), 3).otherwise(0) + F.when(k % 25 == n, 6).otherwise(0)
    expr = lines.groupBy(F.col("l_suppkey").alias("cell_id"), k.alias("gene_id")).agg(F.sum(F.col("l_quantity") * strong).alias("value"))
    return expr, *_annotation(spark, d)


PANEL = """panel AS (SELECT l_suppkey AS cell_id, l_partkey % 40 AS gene_id, sum(l_quantity * (1 + CASE WHEN l_partkey % 40 % 5 = n_regionkey THEN 3 ELSE 0 END + CASE WHEN l_partkey % 40 % 25 = s_nationkey THEN 6 ELSE 0 END)) AS value FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL),
  logged AS (SELECT cell_id, gene_id, log2(value / sum(value) OVER (PARTITION BY cell_id) * 1e5 + 1) AS v FROM panel),
  who AS (SELECT s_suppkey AS cell_id, n_name AS sub, r_name AS major FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"""


def _welch_sql(sides: str) -> str:
    """Marker rows of ``sides`` (cell_type, other, gene_id, na, sa, qa, nb, sb, qb)."""
    return f"""sides AS ({sides}),
  va AS (SELECT *, sa / na AS ma, sb / nb AS mb, greatest((qa - na * (sa / na)**2) / (na - 1), 0) / na AS va, greatest((qb - nb * (sb / nb)**2) / (nb - 1), 0) / nb AS vb FROM sides WHERE na > 1 AND nb > 1),
  ts AS (SELECT cell_type, other, gene_id, ma - mb AS log_fc, CASE WHEN sqrt(va + vb) > 1e-12 THEN (ma - mb) / sqrt(va + vb) ELSE 0 END AS t, greatest(coalesce((va + vb)**2 / nullif(va**2 / (na - 1) + vb**2 / (nb - 1), 0), 1), 1) AS df FROM va),
  top_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_type, other ORDER BY t DESC, gene_id) AS rn FROM ts) WHERE rn <= 500),
  pv AS MATERIALIZED (SELECT *, {_t_tail_sql("t", "df")} AS p FROM top_),
  marks AS (SELECT * FROM {_bh_sql("pv", "p", "cell_type, other")} WHERE log_fc > 0.25 AND p_adj < 0.01)"""


ONE_REGION = """SELECT 'a' AS cell_type, '' AS other, gene_id, any_value(na) AS na, coalesce(sum(v) FILTER (a), 0) AS sa, coalesce(sum(v * v) FILTER (a), 0) AS qa, any_value(nb) AS nb, coalesce(sum(v) FILTER (NOT a), 0) AS sb, coalesce(sum(v * v) FILTER (NOT a), 0) AS qb FROM logged JOIN g USING (cell_id), n GROUP BY gene_id"""


@query(f"""WITH {PANEL}, g AS (SELECT cell_id, major = 'ASIA' AS a FROM who), n AS (SELECT count(*) FILTER (a) AS na, count(*) FILTER (NOT a) AS nb FROM g), {_welch_sql(ONE_REGION)}
  SELECT gene_id, round(log_fc, 6) AS log_fc, round(t, 6) AS t, round(p, 9) AS p, round(p_adj, 9) AS p_adj FROM marks""")
def welch_markers(spark, d):
    e, a, l = _panel(spark, d)
    groups = a.join(l, "sub").select("cell_id", F.col("major").alias("group"))
    return _rounded(_rounded(deconvolution.welch_markers(expression.log2_tpm(e), groups, "ASIA"), "log_fc", "t"), "p", "p_adj", places=9)


ALL_SIDES = """SELECT a.major AS cell_type, b.major AS other, genes.gene_id, a.n AS na, coalesce(x.s, 0) AS sa, coalesce(x.q, 0) AS qa, b.n AS nb, coalesce(y.s, 0) AS sb, coalesce(y.q, 0) AS qb
    FROM nm a JOIN nm b ON a.major <> b.major CROSS JOIN genes LEFT JOIN m x ON x.major = a.major AND x.gene_id = genes.gene_id LEFT JOIN m y ON y.major = b.major AND y.gene_id = genes.gene_id
    UNION ALL SELECT ns.sub, '', genes.gene_id, ns.n, coalesce(x.s, 0), coalesce(x.q, 0), nm.n - ns.n, coalesce(y.s, 0) - coalesce(x.s, 0), coalesce(y.q, 0) - coalesce(x.q, 0)
    FROM ns JOIN nm USING (major) CROSS JOIN genes LEFT JOIN s x ON x.sub = ns.sub AND x.gene_id = genes.gene_id LEFT JOIN m y ON y.major = ns.major AND y.gene_id = genes.gene_id"""


@query(f"""WITH {PANEL}, s AS (SELECT major, sub, gene_id, sum(v) AS s, sum(v * v) AS q FROM logged JOIN who USING (cell_id) GROUP BY ALL), m AS (SELECT major, gene_id, sum(s) AS s, sum(q) AS q FROM s GROUP BY ALL),
  ns AS (SELECT major, sub, count(*) AS n FROM who GROUP BY ALL), nm AS (SELECT major, count(*) AS n FROM who GROUP BY ALL), genes AS (SELECT DISTINCT gene_id FROM s), {_welch_sql(ALL_SIDES)}
  SELECT cell_type, gene_id FROM marks WHERE other = '' UNION ALL SELECT cell_type, gene_id FROM marks WHERE other <> '' GROUP BY ALL HAVING count(*) >= (SELECT count(*) - 1 FROM nm)""")
def reference_markers(spark, d):
    e, a, l = _panel(spark, d)
    return deconvolution.reference_markers(expression.log2_tpm(e), a, l)


@query(f"""WITH {EXPR}, {TOTAL}, c AS (SELECT cell_id, gene_id, value / s * 1e5 AS v FROM expr JOIN tot USING (cell_id)), who AS (SELECT s_suppkey AS cell_id, n_name AS sub, r_name AS major FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
  b AS (SELECT cell_id, major AS cell_type FROM who UNION SELECT cell_id, sub FROM who), n AS (SELECT cell_type, count(*) AS n FROM b GROUP BY cell_type), a AS (SELECT gene_id, cell_type, sum(v) / any_value(n) AS value FROM c JOIN b USING (cell_id) JOIN n USING (cell_type) GROUP BY gene_id, cell_type),
  o AS (SELECT p_partkey AS gene_id, CASE WHEN p_partkey % 2 = 0 THEN 'ASIA' ELSE 'New' END AS cell_type, p_retailprice AS value FROM part WHERE p_size > 10)
  SELECT gene_id, cell_type, round(value, 6) AS value FROM (SELECT gene_id, cell_type, value FROM a WHERE cell_type NOT IN (SELECT cell_type FROM o) UNION ALL SELECT gene_id, cell_type, value FROM o) WHERE gene_id IN (SELECT gene_id FROM a) AND gene_id IN (SELECT gene_id FROM o)""")
def merge_references(spark, d):
    a, l = _annotation(spark, d)
    other = _t(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("gene_id"), F.when(F.col("p_partkey") % 2 == 0, "ASIA").otherwise("New").alias("cell_type"), F.col("p_retailprice").alias("value"))
    return _rounded(deconvolution.merge_references(deconvolution.generate_reference(_expr(spark, d), a, l), other), "value")


# malignant inference


#: How spots go with a signature, made up from their number.
SPOT_R = "co AS (SELECT s_suppkey AS cell_id, (s_suppkey * 37 % 201 - 60) / 100.0::DOUBLE AS r, (s_suppkey * 53 % 100) / 100.0::DOUBLE AS p_adj FROM supplier)"


@query(f"""WITH {EXPR}, {SPOT_R}, x AS (SELECT co.*, co.cell_id % 5 AS cluster, coalesce(genes, 0) AS genes, (r > 0 AND p_adj < 0.25)::INT AS sure FROM co LEFT JOIN (SELECT cell_id, count(*) FILTER (value > 0) AS genes FROM expr GROUP BY cell_id) USING (cell_id)),
  al AS (SELECT avg(genes) AS g, avg(sure) AS s FROM x), rk AS (SELECT cluster, r, rank() OVER (PARTITION BY cluster ORDER BY abs(r)) + (count(*) OVER w - 1) / 2.0 AS k, count(*) OVER w AS t FROM x WHERE r <> 0 WINDOW w AS (PARTITION BY cluster, abs(r))),
  w AS (SELECT cluster, coalesce((coalesce(sum(k) FILTER (r > 0), 0) - count(*) * (count(*) + 1) / 4) / nullif(sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24 - sum(t * t - 1) / 48), 0), 0) AS z FROM rk GROUP BY cluster),
  c AS (SELECT cluster, count(*) AS n, avg(r) AS mean_r, avg(sure) AS share, avg(genes) AS genes FROM x GROUP BY cluster)
  SELECT cluster, n, round(mean_r, 6) + 0.0 AS mean_r, round(coalesce(z, 0), 6) + 0.0 AS z, round(share, 6) AS share_significant, round(genes - g, 6) + 0.0 AS depth_gap, coalesce(mean_r > 0 AND z > 1.6448536269514722 AND share >= s - 1e-12 AND genes > g, false) AS malignant FROM c LEFT JOIN w USING (cluster), al""")
def cluster_stats(spark, d):
    k = F.col("s_suppkey")
    co = _t(spark, d, "supplier").select(k.alias("cell_id"), ((k * 37 % 201 - 60) / 100).alias("r"), ((k * 53 % 100) / 100).alias("p_adj"))
    out = deconvolution.cluster_stats(co.select("cell_id", (F.col("cell_id") % 5).alias("cluster")), co, expression.quality_control(_spots(spark, d), _expr(spark, d), 0))
    return _rounded(out.drop("p"), "mean_r", "z", "share_significant", "depth_gap")


CENTRED = "l AS (SELECT cell_id, gene_id, log2(value / sum(value) OVER (PARTITION BY cell_id) * 1e6 + 1) AS v FROM expr), g AS (SELECT gene_id, sum(v) / (SELECT count(*) FROM cells) AS m FROM l GROUP BY gene_id), dense AS (SELECT cells.cell_id, g.gene_id, coalesce(v, 0) - m AS x FROM cells CROSS JOIN g LEFT JOIN l ON l.cell_id = cells.cell_id AND l.gene_id = g.gene_id)"
SUPPLIERS = "cells AS (SELECT s_suppkey AS cell_id FROM supplier)"


@query(f"WITH {EXPR}, {SUPPLIERS}, {CENTRED} SELECT cell_id, gene_id, round(x, 6) + 0.0 AS value FROM dense")
def cpm_log2_center_dense(spark, d):
    return _rounded(expression.cpm_log2_center(_expr(spark, d), _spots(spark, d), dense=True), "value")


_P3 = "CASE WHEN p0 = 0 THEN 0 ELSE round_even(p0 * pow(10, 2 - floor(log10(p0))), 0) / pow(10, 2 - floor(log10(p0))) END"
_T = _t_tail_sql("(r0 * sqrt((n - 2) / greatest(1 - r0 * r0, 1e-300)))", "(n - 2)::DOUBLE")
SIGNATURE = f"r0 AS (SELECT cell_id, corr(x, w) AS r0, count(*) AS n FROM dense JOIN (SELECT p_partkey AS gene_id, p_size - 25 AS w FROM part) USING (gene_id) GROUP BY cell_id), p0 AS MATERIALIZED (SELECT cell_id, r0, {_T} AS p0 FROM r0), rp AS (SELECT cell_id, round(r0, 3) + 0.0 AS r, {_P3} AS p FROM p0), sg AS MATERIALIZED (SELECT * FROM {_bh_sql('rp', 'p')})"


def _signature(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_partkey").alias("gene_id"), (F.col("p_size") - 25).cast("double").alias("weight"))


@query(f"WITH {EXPR}, {SUPPLIERS}, {CENTRED}, {SIGNATURE} SELECT cell_id, r, round(p, 9) AS p, round(p_adj, 9) AS p_adj FROM sg")
def signature_correlation(spark, d):
    return _rounded(_rounded(deconvolution.signature_correlation(_expr(spark, d), _signature(spark, d), _spots(spark, d)), "r", places=3), "p", "p_adj", places=9)


def _stretch_sql(rows: str, k: str) -> str:
    return f"(SELECT cell_id, coalesce((greatest(least(r, hi), lo) - lo) / nullif(hi - lo, 0), 0) AS f FROM {rows}, (SELECT max(r) FILTER (i = kk) AS lo, max(r) FILTER (j = kk) AS hi FROM (SELECT r, row_number() OVER (ORDER BY r) AS i, row_number() OVER (ORDER BY r DESC) AS j, {k} AS kk FROM {rows})))"


#: Orders as spots, all lines as 40 genes.
ORDER_EXPR = "expr AS (SELECT l_orderkey AS cell_id, l_partkey % 40 AS gene_id, sum(l_quantity) AS value FROM lineitem GROUP BY ALL), cells AS (SELECT DISTINCT cell_id FROM expr)"
WITH_FIRST = "r1 AS MATERIALIZED (SELECT cell_id, coalesce(corr(x, w), 0) AS r FROM dense JOIN pf USING (gene_id) GROUP BY cell_id)"


@query(f"""WITH {ORDER_EXPR}, {CENTRED}, r0 AS MATERIALIZED (SELECT cell_id, round(corr(x, gene_id - 20), 3) + 0.0 AS r FROM dense GROUP BY cell_id), one AS MATERIALIZED {_stretch_sql("r0", "100")},
  pf AS (SELECT gene_id, avg(x) AS w FROM dense JOIN one USING (cell_id) WHERE f >= 1 GROUP BY gene_id), {WITH_FIRST} SELECT cell_id, round(f, 6) AS fraction FROM {_stretch_sql("r1", "100")}""")
def malignant_rounds(spark, d):
    e = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id"), (F.col("l_partkey") % 40).alias("gene_id")).agg(F.sum("l_quantity").alias("value"))
    sig = spark.range(40).select(F.col("id").alias("gene_id"), (F.col("id") - 20).cast("double").alias("weight"))
    return _rounded(plans.malignant_by_rounds(e, e.select("cell_id").distinct(), sig)[0], "fraction")


@query(f"""WITH {EXPR}, {SUPPLIERS}, {CENTRED}, {SIGNATURE}, k AS (SELECT greatest(1, round_even(0.05 * count(*), 0))::INT AS k, greatest(greatest(1, round_even(0.05 * count(*), 0))::INT, count(*) FILTER (r > 0 AND p_adj < 0.25)) AS n FROM sg),
  pick AS (SELECT cell_id FROM (SELECT cell_id, row_number() OVER (ORDER BY r DESC, cell_id) AS rn FROM sg), k WHERE rn <= n), pf AS (SELECT gene_id, avg(x) AS w FROM dense JOIN pick USING (cell_id) GROUP BY gene_id),
  {WITH_FIRST} SELECT cell_id, round(f, 6) AS fraction FROM {_stretch_sql("r1", "(SELECT k FROM k)")}""")
def malignant_bulk(spark, d):
    return _rounded(plans.malignant_bulk(_expr(spark, d), _spots(spark, d), _signature(spark, d))[0], "fraction")


# interaction


@query(f"WITH {FRACTIONS}, x AS (SELECT cell_type, fraction - 0.2 AS v FROM fr), r AS (SELECT cell_type, v, rank() OVER (PARTITION BY cell_type ORDER BY abs(v)) + (count(*) OVER w - 1) / 2.0 AS k, count(*) OVER w AS t FROM x WHERE v <> 0 WINDOW w AS (PARTITION BY cell_type, abs(v))) SELECT cell_type, round(sum(k) FILTER (v > 0), 1) AS w, round((sum(k) FILTER (v > 0) - count(*) * (count(*) + 1) / 4) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24 - sum(t * t - 1) / 48), 6) AS z, count(*)::DOUBLE AS n FROM r GROUP BY cell_type")
def wilcoxon(spark, d):
    x = _fractions(spark, d).select("cell_type", (F.col("fraction") - 0.2).alias("v"))
    return _rounded(_rounded(stats.wilcoxon(x, ["cell_type"], "v"), "z"), "w", places=1)


SCORES = "sc AS (SELECT cell_id, ((cell_id * 31) % 97)::DOUBLE AS score FROM (SELECT DISTINCT o_custkey AS cell_id FROM orders))"
GROUPS = f"w AS (SELECT cell_id, max(fraction) FILTER (cell_type = '{URGENT}') AS a, max(fraction) FILTER (cell_type = '{LOW}') AS b FROM fr GROUP BY cell_id), q AS (SELECT quantile_cont(a, 0.75) AS a75, quantile_cont(a, 0.85) AS a85, quantile_cont(b, 0.75) AS b75, quantile_cont(b, 0.85) AS b85 FROM w), gr AS (SELECT cell_id, CASE WHEN a > a85 AND b > b85 THEN 'Both' WHEN a > a85 AND b < b75 THEN '{URGENT}' WHEN b > b85 AND a < a75 THEN '{LOW}' ELSE 'Other' END AS g FROM w, q)"


@query(f"""WITH {FRACTIONS}, {GROUPS}, {SCORES}, x AS (SELECT g = 'Both' AS b, score FROM gr JOIN sc USING (cell_id) WHERE g <> 'Other'), r AS (SELECT b, score, rank() OVER (ORDER BY score) + (count(*) OVER w - 1) / 2.0 AS k, count(*) OVER w AS t FROM x WINDOW w AS (PARTITION BY score)),
  s AS (SELECT count(*) FILTER (b) AS n1, count(*) FILTER (NOT b) AS n2, count(*) AS n, coalesce(sum(k) FILTER (b), 0) - count(*) FILTER (b) * (count(*) FILTER (b) + 1) / 2 AS u, sum(t * t - 1) AS ties, avg(score) FILTER (b) - avg(score) FILTER (NOT b) AS gap, coalesce(var_samp(score) FILTER (b), 0) AS v1, coalesce(var_samp(score) FILTER (NOT b), 0) AS v2 FROM r),
  t AS (SELECT n1, coalesce((abs(u - n1 * n2 / 2) - 0.5) / nullif(sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))), 0), 0) AS z, CASE WHEN n1 < 2 OR n2 < 2 THEN 0 ELSE gap / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n - 2)) END AS d0 FROM s),
  f AS (SELECT n1, {_normal_tail_sql("z")} AS p, CASE WHEN d0 = 0 THEN 0 ELSE round_even(d0 * pow(10, 1 - floor(log10(abs(d0)))), 0) / pow(10, 1 - floor(log10(abs(d0)))) END AS d FROM t)
  SELECT n1 AS n_both, round(d, 6) AS d, round(p, 6) AS p, n1 > 5 AND p < 0.05 AND d < 0 AS interaction FROM f""")
def cell_type_pair(spark, d):
    f = _fractions(spark, d)
    scores = f.select("cell_id", F.pmod(F.col("cell_id") * 31, F.lit(97)).cast("double").alias("score")).distinct()
    return _rounded(interaction.cell_type_pair(f, scores, URGENT, LOW), "d", "p")


@query("SELECT DISTINCT a.p_brand AS ligand, b.p_brand AS receptor FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_brand IN (SELECT p_brand FROM part WHERE p_size < 10) AND b.p_brand IN (SELECT p_brand FROM part WHERE p_size < 10)")
def valid_pairs(spark, d):
    p = _t(spark, d, "part")
    pairs = p.select("p_partkey", F.col("p_brand").alias("ligand")).join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_brand").alias("receptor")), "p_partkey")
    return interaction.valid_pairs(pairs, p.where("p_size < 10").select(F.col("p_brand").alias("gene_name")))


THIN = HEX.replace("/ 11000 AS f", "/ 11000 * 0.6 AS f")


@query(f"""WITH {THIN}, {INTERFACE}, st AS (SELECT h.cell_id, h.c, h.r, h.cell_id % 3 = 0 AS both_ FROM hex h JOIN lab USING (cell_id) WHERE label = 'Stroma' AND h.cell_id % 3 < 2),
  far AS (SELECT st.cell_id, both_, min(sqrt((st.c - b.c)**2 + (st.r - b.r)**2)) AS distance FROM st, hex b JOIN lab ON lab.cell_id = b.cell_id WHERE lab.label = 'Interface' GROUP BY ALL), o AS (SELECT avg(distance) AS observed, count(*) AS n FROM far WHERE both_),
  k AS (SELECT perm, distance, row_number() OVER (PARTITION BY perm ORDER BY md5(perm || '_' || cell_id), cell_id) AS rn FROM far, range(1000) t(perm) WHERE NOT both_), nu AS (SELECT perm, observed, avg(distance) AS d FROM k, o WHERE rn <= n GROUP BY ALL)
  SELECT round(observed, 6) AS observed, round(avg(d), 6) AS null_mean, round((count(*) FILTER (d <= observed) + 1) / 1001.0, 6) AS p FROM nu GROUP BY observed""")
def distance_to_interface(spark, d):
    cells, f = _hex(spark, d)
    f = f.withColumn("fraction", F.col("fraction") * 0.6)
    groups = cells.select("cell_id", F.when(F.col("cell_id") % 3 == 0, "Both").when(F.col("cell_id") % 3 == 1, "A").otherwise("Other").alias("group"))
    return _rounded(interaction.distance_to_interface(cells, interaction.interface(cells, f), groups), "observed", "null_mean", "p")


@query(f"WITH {CELLS} SELECT a.cell_id AS src, b.cell_id AS dst, a.x AS x_start, a.y AS y_start, b.x AS x_end, b.y AS y_end, 1.0::DOUBLE AS vec_len FROM cells a JOIN cells b ON a.cluster = '1' AND b.cluster = '2' AND a.cell_id % 3 > 0 AND b.cell_id % 4 > 0 AND sqrt((a.x-b.x)**2 + (a.y-b.y)**2) <= {R}")
def velocity_scst(spark, d):
    c = _cells(spark, d)
    e, a = (c.select("cell_id", (F.col("cell_id") % m).cast("double").alias("value")) for m in (3, 4))
    return signaling.velocity_scst(c, "cluster", "1", "2", e, a, R)


@query(f"WITH {SPOTS}, {GRID}, e AS (SELECT * FROM grid WHERE src % 7 > 0 AND dst % 7 > 0) SELECT cell_id FROM spots WHERE cell_id NOT IN (SELECT src FROM e) OR cell_id NOT IN (SELECT dst FROM e)")
def lonely_spots(spark, d):
    return graph.lonely(_spots(spark, d), _grid(spark, d).where("src % 7 > 0 and dst % 7 > 0")).select("cell_id")


@query("WITH e AS (SELECT l_suppkey AS cell_id, l_partkey AS gene_id, sum(l_quantity * (l_partkey % 3)) AS value FROM lineitem GROUP BY ALL) SELECT * FROM e WHERE gene_id IN (SELECT gene_id FROM e GROUP BY gene_id HAVING sum(value) > 0)")
def expressed_genes(spark, d):
    e = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("cell_id"), F.col("l_partkey").alias("gene_id")).agg(F.sum(F.col("l_quantity") * (F.col("l_partkey") % 3)).alias("value"))
    return expression.expressed(e)


# masks and plots


CIRCLES = f"WITH {PX}, e AS (SELECT p.row, p.col, p.label FROM px p CROSS JOIN (SELECT unnest([0, 0, 1, -1]) AS dr, unnest([1, -1, 0, 0]) AS dc) s LEFT JOIN px q ON q.row = p.row + dr AND q.col = p.col + dc GROUP BY ALL HAVING count(*) FILTER (q.label = p.label) < 4), b AS (SELECT label, count(*) AS n FROM e GROUP BY label), m AS (SELECT label, a, CASE WHEN n IS NULL THEN 1 ELSE 4 * pi() * a / (n * n) END AS c FROM (SELECT label, count(*) AS a FROM px GROUP BY label) LEFT JOIN b USING (label))"


@query(f"{CIRCLES}, i AS (SELECT label, avg(row * 3 + col) AS v FROM px GROUP BY label) SELECT count(*) AS n, round(avg(a), 6) AS mean_area, round(stddev_pop(a), 6) AS std_area, min(a) AS min_area, max(a) AS max_area, round(avg(c), 6) AS mean_circularity, round(sum(a) / 2550, 6) AS coverage, round(any_value(mi), 6) AS mean_intensity, round(any_value(si), 6) AS std_intensity FROM m, (SELECT avg(v) AS mi, stddev_pop(v) AS si FROM i)")
def quality_metrics(spark, d):
    p = _pixels(spark, d)
    out = raster.quality_metrics(p, 51, 50, p.select("row", "col", (F.col("row") * 3 + F.col("col")).cast("double").alias("value")))
    return _rounded(out, "mean_area", "std_area", "mean_circularity", "coverage", "mean_intensity", "std_intensity")


@query(f"WITH RECURSIVE {PX}, {_px(1, 'qx')}, {_px(2, 'rx')}, fg AS (SELECT row, col, (row::BIGINT << 32) + col AS id FROM (SELECT row, col FROM px WHERE label % 3 = 0 UNION ALL SELECT row, col FROM qx WHERE label % 3 = 0 UNION ALL SELECT row, col FROM rx WHERE label % 3 = 0) GROUP BY row, col HAVING count(*) >= 2), e AS (SELECT a.id AS s, b.id AS t FROM fg a JOIN fg b ON abs(a.row - b.row) + abs(a.col - b.col) = 1), reach AS (SELECT id AS a, id AS b FROM fg UNION SELECT a, t FROM reach JOIN e ON s = b), m AS (SELECT a, min(b) AS c FROM reach GROUP BY a) SELECT row, col, dense_rank() OVER (ORDER BY c)::INT AS label FROM fg JOIN m ON a = id")
def combined_masks(spark, d):
    return raster.combine([_pixels(spark, d, k).where("label % 3 = 0") for k in range(3)], "vote")


@query("WITH s AS (SELECT sum(w * w) AS w, sum(w * w * x) AS x, sum(w * w * y) AS y, sum(w * w * x * x) AS xx, sum(w * w * x * y) AS xy FROM (SELECT p_size::DOUBLE AS x, p_retailprice AS y, (1 + p_partkey % 5)::DOUBLE AS w FROM part)) SELECT round((w * xy - x * y) / (w * xx - x * x), 6) AS slope, round((y - (w * xy - x * y) / (w * xx - x * x) * x) / w, 4) AS intercept FROM s")
def weighted_fit(spark, d):
    p = _t(spark, d, "part").select("p_size", "p_retailprice", (1 + F.col("p_partkey") % 5).cast("double").alias("w"))
    return _rounded(_rounded(plotdata.linear_fit(p, "p_size", "p_retailprice", "w"), "slope"), "intercept", places=4)


@query(f"""WITH {CCC}, s AS (SELECT 'sender' AS side, sender AS name FROM ccc UNION ALL SELECT 'protein', protein FROM ccc UNION ALL SELECT 'receiver', receiver FROM ccc), n AS (SELECT side, name, count(*) AS n FROM s GROUP BY ALL),
  h AS (SELECT *, n / sum(n) OVER (PARTITION BY side) AS height, row_number() OVER w - 1 AS k FROM n WINDOW w AS (PARTITION BY side ORDER BY n DESC, name))
  SELECT side, name, n, round(height, 6) AS height, round(sum(height) OVER (PARTITION BY side ORDER BY k) - height / 2 + k * 0.02, 6) AS y_center FROM h""")
def sankey_nodes(spark, d):
    c, e, v = _signals(spark, d)
    return _rounded(plotdata.sankey_nodes(signaling.ccc_counts(c, "cluster", e, v, R)), "height", "y_center")


@query(f"""WITH {FLOW}, p AS (SELECT cell_id AS pid, x AS px, y AS py, (cell_id % 11)::DOUBLE AS value FROM cells WHERE cell_id % 4 = 0),
  k AS (SELECT v.cell_id, pid, value, row_number() OVER (PARTITION BY v.cell_id ORDER BY sqrt((x - px)**2 + (y - py)**2), pid) AS rn FROM v, p) SELECT cell_id, value AS intensity FROM k WHERE rn = 1""")
def arrow_intensity(spark, d):
    c = _cells(spark, d)
    e, a = c.select("cell_id", (F.col("cell_id") % 5).cast("double").alias("value")), c.select("cell_id", (F.col("cell_id") % 7 - 3).cast("double").alias("value"))
    arrows = signaling.velocity_arrows(signaling.velocity_within(c, e, a, R))
    points = c.where("cell_id % 4 = 0").select("cell_id", "x", "y", (F.col("cell_id") % 11).cast("double").alias("value"))
    return plotdata.arrow_intensity(arrows, points).select("cell_id", "intensity")


@query(f"WITH {HEX}, {INTERFACE} SELECT cell_id, c::DOUBLE AS x, r::DOUBLE AS y, label FROM hex JOIN lab USING (cell_id)")
def interface_plot(spark, d):
    cells, f = _hex(spark, d)
    return plotdata.interface(cells, interaction.interface(cells, f))


@query(f"WITH {SPOTS} SELECT cell_id, x, y, feature, value FROM (SELECT s.cell_id, s.x, s.y, s.cluster, s_name AS name FROM spots s JOIN supplier ON s_suppkey = s.cell_id) UNPIVOT (value FOR feature IN (cluster, name))")
def metadata_plot(spark, d):
    names = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("cell_id"), F.col("s_name").alias("name"))
    return plotdata.metadata(_spots(spark, d).join(names, "cell_id"), ["cluster", "name"])
