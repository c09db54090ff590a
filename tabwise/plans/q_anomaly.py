"""Isolation-forest queries (U5, G18, P14, O7) on the whole events table (value, user, event type); the SQL draws the
same samples, features and thresholds from md5 and walks the trees by joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql_round
from ..operators.iforest import isolation_forest
from ..sources import read_table
from .registry import register

TREES, SAMPLE, SEED, SHARE, LEVELS = 100, 256, 42, 0.05, 8
_KEPT = ["event_id", "user_id", "event_type", "value"]


def _forest_sql() -> str:
    """CTEs up to ``score`` (event_id, s) and ``cut`` (least score that at most SHARE of the rows exceed)."""
    def draw(tag):
        return f"CAST(('0x' || substr(md5('{SEED}:' || tree || ':' || node || ':{tag}'), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496.0"
    c = "CASE WHEN {0} > 2 THEN 2.0 * (ln({0} - 1) + 0.5772156649015329) - 2.0 * ({0} - 1) / {0} WHEN {0} = 2 THEN 1.0 ELSE 0.0 END"
    out = [f"""code AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS c FROM (SELECT DISTINCT event_type FROM events)),
e AS (SELECT event_id, CAST(user_id AS DOUBLE) AS x0, CAST(c AS DOUBLE) AS x1, CAST(value AS DOUBLE) AS x2 FROM events JOIN code USING (event_type)),
t AS (SELECT unnest(range({TREES})) AS tree),
pick AS (SELECT tree, x0, x1, x2 FROM (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY md5(event_id || ':' || tree || ':{SEED}'), CAST(event_id AS VARCHAR)) AS k
           FROM e, t) WHERE k <= {SAMPLE}),
r_0 AS (SELECT *, CAST(1 AS BIGINT) AS node FROM pick)"""]
    for lv in range(LEVELS + 1):
        ranges = " UNION ALL ".join(f"SELECT tree, node, {j} AS j, min(x{j}) AS lo, max(x{j}) AS hi FROM r_{lv} GROUP BY tree, node" for j in range(3))
        out.append(f"size_{lv} AS (SELECT tree, node, count(*) AS size FROM r_{lv} GROUP BY tree, node)")
        if lv == LEVELS:
            break
        out.append(f"""var_{lv} AS (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY j) - 1 AS i, count(*) OVER (PARTITION BY tree, node) AS k
  FROM ({ranges}) WHERE hi > lo),
split_{lv} AS (SELECT tree, node, j, lo + ({draw('v')}) * (hi - lo) AS thr FROM var_{lv} JOIN size_{lv} USING (tree, node)
  WHERE size > 1 AND i = floor(({draw('f')}) * k)),
r_{lv + 1} AS (SELECT tree, x0, x1, x2, 2 * node + CASE WHEN CASE j WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END < thr THEN 0 ELSE 1 END AS node
  FROM r_{lv} JOIN split_{lv} USING (tree, node))""")
    nodes = " UNION ALL ".join(f"SELECT tree, node, {lv} AS depth, size, " + ("j, thr" if lv < LEVELS else "NULL AS j, NULL AS thr") + f" FROM size_{lv}"
                               + (f" LEFT JOIN split_{lv} USING (tree, node)" if lv < LEVELS else "") for lv in range(LEVELS + 1))
    out.append(f"nodes AS ({nodes}),\nw_0 AS (SELECT *, CAST(1 AS BIGINT) AS node, CAST(NULL AS DOUBLE) AS path FROM e, t)")
    for lv in range(LEVELS + 1):
        out.append(f"""w_{lv + 1} AS (SELECT event_id, x0, x1, x2, tree,
  CASE WHEN j IS NULL THEN node ELSE 2 * node + CASE WHEN CASE j WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END < thr THEN 0 ELSE 1 END END AS node,
  CASE WHEN path IS NOT NULL THEN path WHEN j IS NULL THEN {lv} + {c.format('coalesce(size, 0)')} END AS path
  FROM w_{lv} LEFT JOIN nodes USING (tree, node))""")
    psi = f"least({SAMPLE}, (SELECT count(*) FROM events))"
    score = f"power(2.0, -avg(path) / ({c.format(psi)}))"
    out.append(f"""score AS (SELECT event_id, {sql_round(score, 6)} AS s FROM w_{LEVELS + 1} GROUP BY event_id),
hist AS (SELECT s, count(*) AS c FROM score GROUP BY s),
cut AS (SELECT min(s) AS cut FROM (SELECT s, coalesce(sum(c) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM hist)
        WHERE above <= floor({SHARE} * (SELECT count(*) FROM events)))""")
    return "WITH " + ",\n".join(out)


_SQL = _forest_sql()


def _events(spark, sf_dir):
    return read_table(spark, sf_dir, "events")


def _model(spark, sf_dir):
    return isolation_forest(_events(spark, sf_dir), "event_id", trees=TREES, sample=SAMPLE, seed=SEED, contamination=SHARE)


@register("iforest_scores", _SQL + " SELECT event_id, s AS anomaly_score, s > cut AS is_anomaly FROM score, cut")
def q_iforest_scores(spark, sf_dir):
    return _model(spark, sf_dir).scores


@register("iforest_summary", _SQL + f"""
SELECT CAST(sum(CASE WHEN s > cut THEN 1 ELSE 0 END) AS BIGINT) AS n_anomalies,
       {sql_round('100.0 * sum(CASE WHEN s > cut THEN 1 ELSE 0 END) / count(*)', 6)} AS anomaly_pct, count(*) AS n_rows FROM score, cut""")
def q_iforest_summary(spark, sf_dir):
    s = _model(spark, sf_dir).summary
    return s.select("n_anomalies", F.round("anomaly_pct", 6).alias("anomaly_pct"), "n_rows")


_ROWS = " SELECT event_id, user_id, event_type, value, s AS anomaly_score FROM score JOIN events USING (event_id), cut WHERE s > cut"


@register("iforest_anomalies", _SQL + _ROWS)
def q_iforest_anomalies(spark, sf_dir):
    return _model(spark, sf_dir).anomalies(_events(spark, sf_dir)).select(*_KEPT, "anomaly_score")


@register("iforest_top10", _SQL + _ROWS + " ORDER BY s DESC, event_id LIMIT 10")
def q_iforest_top10(spark, sf_dir):
    return _model(spark, sf_dir).anomalies(_events(spark, sf_dir), n=10).select(*_KEPT, "anomaly_score")
