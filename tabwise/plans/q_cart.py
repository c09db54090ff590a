"""Exact-tree queries (M3, G14, O2, V1) on lineitem with a derived class; the SQL grows the same tree level by level."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import round_half_up, sql_round
from ..operators.cart import cart
from ..operators.evaluate import confusion
from .q_trees import TREE_FEATURES, lineitem_classes
from .registry import register

DEPTH = 3
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
_SCORE = "(l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1)"


def _tree_sql(where: str = "true") -> str:
    """CTEs rows_0 (all rows of lineitem with x0…x3, y, node) up to rows_DEPTH, best_0…, and nodes, fitted where ``where`` holds."""
    xs = ", ".join(f"{f} AS x{j}" for j, f in enumerate(TREE_FEATURES))
    out = [f"""rows_0 AS (SELECT {', '.join(f'{k} AS k{i}' for i, k in enumerate(_KEYS))}, {xs}, 1 AS node, {where} AS fits,
  CASE WHEN l_quantity > 25 AND l_discount > 0.04 THEN 1 ELSE 0 END AS y FROM lineitem)"""]
    for lv in range(DEPTH):
        cells = " UNION ALL ".join(f"SELECT node, {j} AS f, x{j} AS v, count(*) AS n, sum(y) AS n1 FROM rows_{lv} WHERE fits GROUP BY node, x{j}"
                                   for j in range(len(TREE_FEATURES)))
        value = "CASE f " + " ".join(f"WHEN {j} THEN x{j}" for j in range(len(TREE_FEATURES))) + " END"
        out.append(f"""cells_{lv} AS ({cells}),
cum_{lv} AS (SELECT node, f, v, lead(v) OVER w AS nv, sum(n) OVER u AS ln, sum(n1) OVER u AS l1, sum(n) OVER a AS tn, sum(n1) OVER a AS t1 FROM cells_{lv}
  WINDOW w AS (PARTITION BY node, f ORDER BY v), u AS (PARTITION BY node, f ORDER BY v ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY node, f)),
side_{lv} AS (SELECT node, f, (v + nv) / 2 AS threshold, CAST(ln - l1 AS DOUBLE) AS l0, CAST(l1 AS DOUBLE) AS l1,
  CAST(tn - t1 - (ln - l1) AS DOUBLE) AS r0, CAST(t1 - l1 AS DOUBLE) AS r1 FROM cum_{lv} WHERE nv IS NOT NULL AND t1 > 0 AND t1 < tn),
best_{lv} AS (SELECT node, f, threshold FROM (
  SELECT *, row_number() OVER (PARTITION BY node ORDER BY {_SCORE} DESC, f, threshold) AS k FROM side_{lv}) WHERE k = 1),
rows_{lv + 1} AS (SELECT r.* EXCLUDE (node), CASE WHEN b.f IS NULL THEN r.node WHEN {value} > threshold THEN 2 * r.node + 1 ELSE 2 * r.node END AS node
  FROM rows_{lv} r LEFT JOIN best_{lv} b ON b.node = r.node)""")
    names = "CASE f " + " ".join(f"WHEN {j} THEN '{f}'" for j, f in enumerate(TREE_FEATURES)) + " END"
    levels = [f"SELECT r.node, {lv} AS depth, count(*) AS n, sum(y) AS n1, any_value(f) AS f, any_value(threshold) AS threshold FROM rows_{lv} r "
              f"LEFT JOIN best_{lv} b ON b.node = r.node WHERE fits AND r.node >= {2 ** lv} GROUP BY r.node" for lv in range(DEPTH)]
    levels.append(f"SELECT node, {DEPTH}, count(*), sum(y), NULL, NULL FROM rows_{DEPTH} WHERE fits AND node >= {2 ** DEPTH} GROUP BY node")
    out.append(f"""nodes AS (SELECT node, depth, n, n1, {names} AS feature, threshold, CASE WHEN n1 > n - n1 THEN '1' ELSE '0' END AS prediction
  FROM ({' UNION ALL '.join(levels)}))""")
    return "WITH " + ",\n".join(out)


def _fit(df):
    return cart(df, "row_key", "big_discount", TREE_FEATURES, depth=DEPTH)


@register("cart_nodes", _tree_sql() + f"""
SELECT CAST(node AS BIGINT) AS node, CAST(depth AS INTEGER) AS depth, CAST(n AS BIGINT) AS n, CAST(n1 AS BIGINT) AS n_class_1, feature,
       {sql_round('threshold', 6)} AS threshold, prediction FROM nodes""")
def q_cart_nodes(spark, sf_dir):
    """M3: every node of the exact tree over all rows."""
    nodes = _fit(lineitem_classes(spark, sf_dir)).nodes
    return nodes.select("node", "depth", "n", F.element_at("counts", 2).alias("n_class_1"), "feature",
                        round_half_up("threshold", 6).alias("threshold"), "prediction")


@register("cart_predict", _tree_sql() + f"""
SELECT k0 AS l_orderkey, k1 AS l_linenumber, k2 AS l_partkey, k3 AS l_suppkey, k4 AS l_quantity, prediction,
       {sql_round('100.0 * greatest(n1, n - n1) / n', 6)} AS confidence, {sql_round('100.0 * n1 / n', 6)} AS probability_1
FROM rows_{DEPTH} JOIN nodes USING (node)""")
def q_cart_predict(spark, sf_dir):
    """V1: class, confidence and probability of every row of lineitem."""
    rows = lineitem_classes(spark, sf_dir)
    p = _fit(rows).predict(rows)
    return p.select(*[F.col(f"row_key.{k}").alias(k) for k in _KEYS], "prediction", round_half_up("confidence", 6).alias("confidence"),
                    round_half_up(F.element_at("probabilities", "1"), 6).alias("probability_1"))


@register("cart_confusion", _tree_sql("l_orderkey % 5 <> 0") + f"""
SELECT CAST(y AS VARCHAR) AS label, prediction, count(*) AS count FROM rows_{DEPTH} JOIN nodes USING (node) WHERE NOT fits GROUP BY 1, 2""")
def q_cart_confusion(spark, sf_dir):
    """A tree fitted on four folds, judged on the fifth."""
    rows = lineitem_classes(spark, sf_dir)
    held = F.pmod("l_orderkey", F.lit(5)) == 0
    judged = _fit(rows.where(~held)).predict(rows.where(held).withColumn("row_key", F.struct("row_key", "big_discount")))
    return confusion(judged.select(F.col("row_key.big_discount").cast("string").alias("label"), "prediction"), "label", "prediction")


@register("cart_importances", _tree_sql() + f""",
w AS (SELECT node, feature, (CAST(n1 AS DOUBLE) * n1 + CAST(n - n1 AS DOUBLE) * (n - n1)) / n AS w FROM nodes),
g AS (SELECT p.feature, sum(c.cw - p.w) AS gain FROM w p JOIN (SELECT node // 2 AS node, sum(w) AS cw FROM w GROUP BY 1) c USING (node)
      WHERE p.feature IS NOT NULL GROUP BY 1),
e(feature) AS (VALUES {', '.join(f"('{f}')" for f in TREE_FEATURES)})
SELECT feature, {sql_round('coalesce(gain / (SELECT sum(gain) FROM g), 0.0)', 6)} AS importance,
       CAST(row_number() OVER (ORDER BY coalesce(gain, 0.0) DESC, feature) AS INTEGER) AS rank FROM e LEFT JOIN g USING (feature)""")
def q_cart_importances(spark, sf_dir):
    """O2: features by the impurity that their splits take away."""
    imp = _fit(lineitem_classes(spark, sf_dir)).importances
    return imp.select("feature", round_half_up("importance", 6).alias("importance"), F.col("rank").cast("int").alias("rank"))
