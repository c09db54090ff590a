"""Tree queries (M1, M3, O2, G14) on lineitem with a derived class (raw columns are noise)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import round_half_up, sql_round
from ..operators.evaluate import confusion
from ..operators.trees import best_split, forest, tree
from ..sources import read_table
from .registry import register

TREE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


def lineitem_classes(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("row_key"),
        "l_orderkey", *TREE_FEATURES,
        ((F.col("l_quantity") > 25) & (F.col("l_discount") > 0.04)).cast("int").alias("big_discount"))


@register("tree_fit")
def q_tree_fit(spark, sf_dir):
    m = tree(lineitem_classes(spark, sf_dir), "row_key", "big_discount", TREE_FEATURES, depth=6,
             split_col="l_orderkey", prep=False)
    return m.metrics


@register("forest_fit")
def q_forest_fit(spark, sf_dir):
    m = forest(lineitem_classes(spark, sf_dir), "row_key", "big_discount", TREE_FEATURES, trees=100, depth=10,
               split_col="l_orderkey", prep=False)
    return m.metrics


@register("forest_importances")
def q_forest_importances(spark, sf_dir):
    m = forest(lineitem_classes(spark, sf_dir), "row_key", "big_discount", TREE_FEATURES, trees=100, depth=10,
               split_col="l_orderkey", prep=False, cv=False)
    return m.importances


@register("tree_root_split", f"""
WITH b AS (SELECT l_quantity AS v, CASE WHEN l_quantity > 25 AND l_discount > 0.04 THEN 1 ELSE 0 END AS y
           FROM lineitem),
pv AS (SELECT v, sum(1 - y) AS c0, sum(y) AS c1 FROM b GROUP BY v),
t AS (SELECT sum(c0) AS t0, sum(c1) AS t1 FROM pv),
cum AS (SELECT v, lead(v) OVER (ORDER BY v) AS nv,
               sum(c0) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS l0,
               sum(c1) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS l1 FROM pv),
sc AS (SELECT (v + nv) / 2 AS thr, CAST(l0 AS DOUBLE) AS l0, CAST(l1 AS DOUBLE) AS l1,
              CAST(t0 - l0 AS DOUBLE) AS r0, CAST(t1 - l1 AS DOUBLE) AS r1,
              CAST(l0 + l1 AS DOUBLE) AS nl, CAST(t0 + t1 - l0 - l1 AS DOUBLE) AS nr, CAST(t0 + t1 AS DOUBLE) AS n
       FROM cum, t WHERE nv IS NOT NULL),
g AS (SELECT thr, nl, nr, (nl / n) * (1 - (l0 / nl) * (l0 / nl) - (l1 / nl) * (l1 / nl))
                       + (nr / n) * (1 - (r0 / nr) * (r0 / nr) - (r1 / nr) * (r1 / nr)) AS gini FROM sc)
SELECT 'l_quantity' AS feature, thr AS threshold, {sql_round('gini', 6)} AS gini, CAST(nl AS BIGINT) AS n_left,
       CAST(nr AS BIGINT) AS n_right
FROM g ORDER BY gini, thr LIMIT 1""")
def q_tree_root_split(spark, sf_dir):
    b = best_split(lineitem_classes(spark, sf_dir), "l_quantity", "big_discount")
    return b.select("feature", "threshold", round_half_up("gini", 6).alias("gini"),
                    F.col("n_left").cast("long").alias("n_left"), F.col("n_right").cast("long").alias("n_right"))


@register("class_metrics", """
SELECT CASE WHEN l_quantity > 25 AND l_discount > 0.04 THEN 1 ELSE 0 END AS label,
       CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END AS prediction, count(*) AS count
FROM lineitem GROUP BY 1, 2""")
def q_class_metrics(spark, sf_dir):
    df = lineitem_classes(spark, sf_dir).withColumn("rule", (F.col("l_quantity") > 30).cast("int"))
    return confusion(df, "big_discount", "rule")


@register("tree_rules")
def q_tree_rules(spark, sf_dir):
    """M3: depth, leaves and the if/else rules of the fitted tree (rows-only: Spark bins thresholds)."""
    m = tree(lineitem_classes(spark, sf_dir), "row_key", "big_discount", TREE_FEATURES, depth=6,
             split_col="l_orderkey", prep=False, cv=False)
    return spark.createDataFrame([(m.depth, m.leaves, m.rules)], "depth int, leaves int, rules string")
