"""DBSCAN queries (U2, J3, G19, P13, G10, V3, G11) on the whole customer table: c_acctbal and c_nationkey
standardised, ε = 0.15, minPts = 8."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import round_half_up, sql_round
from ..operators.dbscan import dbscan
from ..sources import read_table
from .registry import register

EPS, MIN_PTS = 0.15, 8
FEATURES = ["c_acctbal", "c_nationkey"]


def _model(spark, sf_dir):
    pts = read_table(spark, sf_dir, "customer").select("c_custkey", *FEATURES)
    return dbscan(pts, "c_custkey", FEATURES, eps=EPS, min_pts=MIN_PTS, prep=False)


_DB_BASE = f"""
WITH RECURSIVE
st AS (SELECT avg(c_acctbal) AS ma, stddev_pop(c_acctbal) AS sa, avg(CAST(c_nationkey AS DOUBLE)) AS mn,
              stddev_pop(CAST(c_nationkey AS DOUBLE)) AS sn FROM customer),
z AS (SELECT c_custkey AS k, (c_acctbal - ma) / CASE WHEN sa = 0 THEN 1 ELSE sa END AS a,
             (CAST(c_nationkey AS DOUBLE) - mn) / CASE WHEN sn = 0 THEN 1 ELSE sn END AS b FROM customer, st),
pr AS (SELECT x.k AS p, y.k AS q FROM z x JOIN z y
       ON (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) <= CAST('{EPS * EPS!r}' AS DOUBLE)),
cnt AS (SELECT p, count(*) AS c FROM pr GROUP BY p),
core AS (SELECT p FROM cnt WHERE c >= {MIN_PTS}),
edges AS (SELECT pr.p AS a, pr.q AS b FROM pr JOIN core c1 ON c1.p = pr.p JOIN core c2 ON c2.p = pr.q
          WHERE pr.p <> pr.q),
r(node, comp) AS (SELECT p, p FROM core UNION SELECT e.b, r.comp FROM r JOIN edges e ON e.a = r.node),
cc AS (SELECT node, min(comp) AS comp FROM r GROUP BY node),
cid AS (SELECT comp, dense_rank() OVER (ORDER BY comp) - 1 AS cluster FROM (SELECT DISTINCT comp FROM cc)),
corelab AS (SELECT cc.node AS p, cid.cluster FROM cc JOIN cid USING (comp)),
border AS (SELECT pr.p, min(corelab.cluster) AS bc FROM pr JOIN corelab ON corelab.p = pr.q
           WHERE pr.p NOT IN (SELECT p FROM corelab) GROUP BY pr.p),
lab AS (SELECT cnt.p AS c_custkey, CAST(coalesce(corelab.cluster, border.bc, -1) AS INTEGER) AS cluster,
               corelab.cluster IS NOT NULL AS is_core, cnt.c AS n_neighbours
        FROM cnt LEFT JOIN corelab USING (p) LEFT JOIN border USING (p))
"""


@register("dbscan_labels", _DB_BASE + "SELECT c_custkey, cluster, is_core FROM lab")
def q_dbscan_labels(spark, sf_dir):
    return _model(spark, sf_dir).labels.select("c_custkey", "cluster", "is_core")


@register("dbscan_summary", _DB_BASE + """
SELECT count(DISTINCT CASE WHEN cluster >= 0 THEN cluster END) AS n_clusters,
       CAST(sum(CASE WHEN cluster = -1 THEN 1 ELSE 0 END) AS BIGINT) AS n_noise, count(*) AS n_rows FROM lab""")
def q_dbscan_summary(spark, sf_dir):
    return _model(spark, sf_dir).summary


@register("dbscan_noise", _DB_BASE + """
SELECT c.* FROM customer c JOIN lab ON lab.c_custkey = c.c_custkey WHERE lab.cluster = -1""")
def q_dbscan_noise(spark, sf_dir):
    m = _model(spark, sf_dir)
    return m.outliers(read_table(spark, sf_dir, "customer"))


@register("dbscan_averages", _DB_BASE + f"""
SELECT lab.cluster, count(*) AS size, {sql_round('avg(c.c_acctbal)', 4)} AS avg_c_acctbal,
       {sql_round('avg(CAST(c.c_nationkey AS DOUBLE))', 4)} AS avg_c_nationkey
FROM customer c JOIN lab ON lab.c_custkey = c.c_custkey WHERE lab.cluster >= 0 GROUP BY lab.cluster""")
def q_dbscan_averages(spark, sf_dir):
    a = _model(spark, sf_dir).averages
    return a.select("cluster", "size", round_half_up("avg_c_acctbal", 4).alias("avg_c_acctbal"),
                    round_half_up("avg_c_nationkey", 4).alias("avg_c_nationkey"))


@register("dbscan_score", _DB_BASE + f"""
, sp AS (SELECT s_suppkey, (s_acctbal - ma) / CASE WHEN sa = 0 THEN 1 ELSE sa END AS a,
                (CAST(s_nationkey AS DOUBLE) - mn) / CASE WHEN sn = 0 THEN 1 ELSE sn END AS b FROM supplier, st),
mem AS (SELECT z.k, z.a, z.b, lab.cluster FROM z JOIN lab ON lab.c_custkey = z.k WHERE lab.cluster >= 0),
ds AS (SELECT sp.s_suppkey, mem.cluster, sqrt((sp.a - mem.a) * (sp.a - mem.a) + (sp.b - mem.b) * (sp.b - mem.b)) AS d
       FROM sp, mem),
ag AS (SELECT s_suppkey, cluster, min(d) AS min_distance, avg(d) AS avg_distance FROM ds GROUP BY 1, 2),
best AS (SELECT s_suppkey, CASE WHEN min_distance <= {EPS} THEN cluster ELSE -1 END AS assigned FROM (
         SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY min_distance, cluster) AS rn FROM ag) WHERE rn = 1)
SELECT ag.s_suppkey, ag.cluster, {sql_round('ag.min_distance', 6)} AS min_distance,
       {sql_round('ag.avg_distance', 6)} AS avg_distance, best.assigned
FROM ag JOIN best USING (s_suppkey)""")
def q_dbscan_score(spark, sf_dir):
    m = _model(spark, sf_dir)
    sup = read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"),
        F.col("s_nationkey").alias("c_nationkey"))
    s = m.score(sup)
    return s.select(F.col("c_custkey").alias("s_suppkey"), "cluster",
                    round_half_up("min_distance", 6).alias("min_distance"),
                    round_half_up("avg_distance", 6).alias("avg_distance"), "assigned")
