"""Random-forest queries (M1, O2, G14, V1) on lineitem with a derived class; the SQL draws the same bags and features from
md5 and grows the trees level by level."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import round_half_up, sql_round
from ..operators.bagged import CUT_ROWS, bagged_forest, poisson_steps
from ..operators.evaluate import confusion
from .q_trees import TREE_FEATURES, lineitem_classes
from .registry import register

TREES, DEPTH, BINS, TRIES, SEED = 30, 5, 32, 2, 42
_P = len(TREE_FEATURES)
_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_SCORE = "(l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1)"


def _forest_sql(where: str = "true") -> str:
    """CTEs ``base`` (rows with id, b0…, y, fits) and ``nodes`` (tree, node, n, n1, f, cut) of the forest fitted where ``where`` holds."""
    xs = ", ".join(f"CAST({f} AS DOUBLE) AS x{j}" for j, f in enumerate(TREE_FEATURES))
    cuts = ", ".join(f"list_distinct(list_transform(range(1, {BINS}), lambda b: v{j}[CAST(ceil(n * b / {float(BINS)}) AS BIGINT)])) AS c{j}" for j in range(_P))
    lists = ", ".join(f"list(x{j} ORDER BY x{j}) AS v{j}" for j in range(_P))
    order = ", ".join(f"x{j}" for j in range(_P))
    bins = ", ".join(f"len(list_filter(c{j}, lambda c: c < x{j})) AS b{j}" for j in range(_P))
    bag = " + ".join(f"CASE WHEN u >= {s} THEN 1 ELSE 0 END" for s in poisson_steps())
    out = [f"""src AS MATERIALIZED (SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS id, {xs}, {where} AS fits,
  CASE WHEN l_quantity > 25 AND l_discount > 0.04 THEN 1 ELSE 0 END AS y FROM lineitem),
cuts AS MATERIALIZED (SELECT {cuts} FROM (SELECT count(*) AS n, {lists} FROM (SELECT * FROM src WHERE fits ORDER BY md5(id || ':cuts:{SEED}'), id, {order} LIMIT {CUT_ROWS}))),
base AS MATERIALIZED (SELECT id, fits, y, {bins} FROM src, cuts),
r_0 AS MATERIALIZED (SELECT * FROM (SELECT tree, b0, b1, b2, b3, y, 1 AS node, {bag} AS w FROM (
  SELECT *, CAST('0x' || substr(md5(id || ':' || (tree // 4) || ':{SEED}'), 1 + 8 * (tree % 4), 8) AS BIGINT) AS u
  FROM base, range({TREES}) t(tree) WHERE fits)) WHERE w > 0)"""]
    value = "CASE f " + " ".join(f"WHEN {j} THEN b{j}" for j in range(_P)) + " END"
    for lv in range(DEPTH + 1):
        out.append(f"n_{lv} AS MATERIALIZED (SELECT tree, node, sum(w) AS n, sum(w * y) AS n1 FROM r_{lv} GROUP BY tree, node)")
        if lv == DEPTH:
            break
        cells = " UNION ALL ".join(f"SELECT tree, node, {j} AS f, b{j} AS b, sum(w) AS n, sum(w * y) AS n1 FROM r_{lv} GROUP BY ALL" for j in range(_P))
        out.append(f"""try_{lv} AS (SELECT tree, node, f FROM (SELECT tree, node, f, row_number() OVER (PARTITION BY tree, node
  ORDER BY md5('{SEED}:' || tree || ':' || node || ':' || f), f) AS o FROM n_{lv}, range({_P}) g(f)) WHERE o <= {TRIES}),
cum_{lv} AS (SELECT tree, node, f, b, lead(b) OVER w AS nb, sum(n) OVER u AS ln, sum(n1) OVER u AS l1, sum(n) OVER a AS tn, sum(n1) OVER a AS t1
  FROM ({cells}) JOIN try_{lv} USING (tree, node, f)
  WINDOW w AS (PARTITION BY tree, node, f ORDER BY b), u AS (PARTITION BY tree, node, f ORDER BY b ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY tree, node, f)),
side_{lv} AS (SELECT tree, node, f, b, CAST(ln - l1 AS DOUBLE) AS l0, CAST(l1 AS DOUBLE) AS l1, CAST(tn - t1 - (ln - l1) AS DOUBLE) AS r0,
  CAST(t1 - l1 AS DOUBLE) AS r1 FROM cum_{lv} WHERE nb IS NOT NULL AND t1 > 0 AND t1 < tn),
s_{lv} AS MATERIALIZED (SELECT tree, node, f, b AS cut FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY {_SCORE} DESC, f, b) AS o FROM side_{lv}) WHERE o = 1),
r_{lv + 1} AS MATERIALIZED (SELECT r.* REPLACE (CASE WHEN {value} > cut THEN 2 * r.node + 1 ELSE 2 * r.node END AS node) FROM r_{lv} r JOIN s_{lv} USING (tree, node))""")
    levels = [f"SELECT tree, node, n, n1, f, cut FROM n_{lv} LEFT JOIN s_{lv} USING (tree, node)" for lv in range(DEPTH)]
    out.append(f"nodes AS MATERIALIZED ({' UNION ALL '.join([*levels, f'SELECT tree, node, n, n1, NULL, NULL FROM n_{DEPTH}'])})")
    return "WITH " + ",\n".join(out)


def _votes_sql(rows: str) -> str:
    """CTE ``votes``: (id, y, p1) with the mean share of class 1 in percent, of the rows of ``base`` where ``rows`` holds."""
    value = "CASE f " + " ".join(f"WHEN {j} THEN b{j}" for j in range(_P)) + " END"
    out = [f"b AS (SELECT row_number() OVER () AS rid, * FROM base WHERE {rows})",
           f"w_0 AS (SELECT rid, id, y, b0, b1, b2, b3, tree, 1 AS node FROM b, range({TREES}) t(tree))"]
    for lv in range(DEPTH):
        out.append(f"w_{lv + 1} AS (SELECT w.* REPLACE (CASE WHEN f IS NULL THEN w.node WHEN {value} > cut THEN 2 * w.node + 1 ELSE 2 * w.node END AS node) "
                   f"FROM w_{lv} w JOIN nodes USING (tree, node))")
    out.append(f"votes AS (SELECT rid, any_value(id) AS id, any_value(y) AS y, 100 * avg(CAST(n1 AS DOUBLE) / n) AS p1 FROM w_{DEPTH} JOIN nodes USING (tree, node) GROUP BY rid)")
    return ",\n" + ",\n".join(out)


def _rows(spark, sf_dir):
    key = F.concat_ws(":", *[F.col(f"row_key.{c}").cast("string") for c in _ID])
    return lineitem_classes(spark, sf_dir).withColumn("row_key", key)


def _fit(rows):
    return bagged_forest(rows, "row_key", "big_discount", TREE_FEATURES, trees=TREES, depth=DEPTH, bins=BINS, tries=TRIES, seed=SEED)


@register("bagged_nodes", _forest_sql() + """
SELECT CAST(tree AS INTEGER) AS tree, CAST(node AS BIGINT) AS node, CAST(n AS BIGINT) AS n, CAST(n1 AS BIGINT) AS n_class_1,
       CASE f """ + " ".join(f"WHEN {j} THEN '{f}'" for j, f in enumerate(TREE_FEATURES)) + f""" END AS feature,
       {sql_round("CASE f " + " ".join(f"WHEN {j} THEN list_sort(c{j})[cut + 1]" for j in range(_P)) + " END", 6)} AS threshold FROM nodes, cuts""")
def q_bagged_nodes(spark, sf_dir):
    """M1: every node of every tree, fitted on all rows."""
    nodes = _fit(_rows(spark, sf_dir)).node_table
    return nodes.select("tree", "node", "n", F.element_at("counts", 2).alias("n_class_1"), "feature", round_half_up("threshold", 6).alias("threshold"))


@register("bagged_importances", _forest_sql() + f""",
v AS (SELECT tree, node, f, (CAST(n1 AS DOUBLE) * n1 + CAST(n - n1 AS DOUBLE) * (n - n1)) / n AS v FROM nodes),
g AS (SELECT p.tree, p.f, sum(c.v - p.v) AS gain FROM v p JOIN (SELECT tree, node // 2 AS node, sum(v) AS v FROM v GROUP BY ALL) c USING (tree, node)
      WHERE p.f IS NOT NULL GROUP BY ALL),
s AS (SELECT f, gain / sum(gain) OVER (PARTITION BY tree) AS share FROM g),
e(f, feature) AS (VALUES {', '.join(f"({j}, '{f}')" for j, f in enumerate(TREE_FEATURES))}),
i AS (SELECT feature, coalesce(sum(share), 0.0) / (SELECT count(DISTINCT tree) FROM g) AS importance FROM e LEFT JOIN s USING (f) GROUP BY feature)
SELECT feature, {sql_round('importance', 6)} AS importance, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM i""")
def q_bagged_importances(spark, sf_dir):
    """O2: features by the impurity that their splits take away, averaged over the trees."""
    imp = _fit(_rows(spark, sf_dir)).importances
    return imp.select("feature", round_half_up("importance", 6).alias("importance"), "rank")


@register("bagged_predict", _forest_sql() + _votes_sql("true") + f"""
SELECT id AS row_key, CASE WHEN round(p1, 9) > round(100 - p1, 9) THEN '1' ELSE '0' END AS prediction,
       {sql_round('greatest(p1, 100 - p1)', 4)} AS confidence, {sql_round('p1', 4)} AS probability_1 FROM votes""")
def q_bagged_predict(spark, sf_dir):
    """V1: class, confidence and probability of every row of lineitem."""
    rows = _rows(spark, sf_dir)
    p = _fit(rows).predict(rows)
    return p.select("row_key", "prediction", round_half_up("confidence", 4).alias("confidence"),
                    round_half_up(F.element_at("probabilities", "1"), 4).alias("probability_1"))


@register("bagged_confusion", _forest_sql("l_orderkey % 5 <> 0") + _votes_sql("NOT fits") + """
SELECT CAST(y AS VARCHAR) AS label, CASE WHEN round(p1, 9) > round(100 - p1, 9) THEN '1' ELSE '0' END AS prediction, count(*) AS count FROM votes GROUP BY 1, 2""")
def q_bagged_confusion(spark, sf_dir):
    """A forest fitted on four folds, judged on the fifth."""
    rows = _rows(spark, sf_dir)
    held = F.pmod("l_orderkey", F.lit(5)) == 0
    judged = _fit(rows.where(~held)).predict(rows.where(held).withColumn("row_key", F.struct("row_key", "big_discount")))
    return confusion(judged.select(F.col("row_key.big_discount").cast("string").alias("label"), "prediction"), "label", "prediction")
