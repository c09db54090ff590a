"""Ridge regression queries (M2, G15, P12, O3) on lineitem with a derived target (raw columns are noise)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import round_half_up, sql_round
from ..operators.ridge import ridge
from ..sources import read_table
from .registry import register

KEY_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def lineitem_ridge_input(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.struct(*KEY_COLS).alias("row_key"), "l_orderkey",
        F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"),
        (3 * F.col("l_quantity") - 40 * F.col("l_discount") + F.col("l_extendedprice") / 10000).alias("y"))


def fit_lineitem_ridge(spark, sf_dir):
    return ridge(lineitem_ridge_input(spark, sf_dir), key="row_key", target="y", features=["qty", "disc"],
                 alpha=1.0, folds=5, test_fold=0, split_col="l_orderkey", prep=False)


_BASE = """
WITH base AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_quantity AS q, l_discount AS d,
                     3 * l_quantity - 40 * l_discount + l_extendedprice / 10000 AS y FROM lineitem),
st AS (SELECT avg(q) AS mq, stddev_pop(q) AS sq, avg(d) AS md, stddev_pop(d) AS sd FROM base),
z AS (SELECT base.*, (q - mq) / CASE WHEN sq = 0 THEN 1 ELSE sq END AS zq,
                     (d - md) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS zd FROM base, st),
tr AS (SELECT count(*) AS n, avg(zq) AS aq, avg(zd) AS ad, avg(y) AS ay,
              covar_pop(zq, zq) * count(*) AS sqq, covar_pop(zq, zd) * count(*) AS sqd,
              covar_pop(zd, zd) * count(*) AS sdd, covar_pop(zq, y) * count(*) AS sqy,
              covar_pop(zd, y) * count(*) AS sdy FROM z WHERE l_orderkey % 5 <> 0),
w0 AS (SELECT *, (sqq + 1) * (sdd + 1) - sqd * sqd AS det FROM tr),
w AS (SELECT ((sdd + 1) * sqy - sqd * sdy) / det AS wq, ((sqq + 1) * sdy - sqd * sqy) / det AS wd, ay, aq, ad FROM w0),
te AS (SELECT z.*, (w.ay - w.aq * w.wq - w.ad * w.wd) + w.wq * z.zq + w.wd * z.zd AS p, w.wq, w.wd
       FROM z, w WHERE l_orderkey % 5 = 0)
"""


@register("ridge_coefs", _BASE + f"""
SELECT 'qty' AS feature, {sql_round('wq', 6)} AS coefficient FROM w
UNION ALL SELECT 'disc', {sql_round('wd', 6)} FROM w
UNION ALL SELECT '(intercept)', {sql_round('ay - aq * wq - ad * wd', 6)} FROM w""")
def q_ridge_coefs(spark, sf_dir):
    m = fit_lineitem_ridge(spark, sf_dir)
    return m.coefficients.select("feature", round_half_up("coefficient", 6).alias("coefficient"))


@register("ridge_metrics", _BASE + f"""
, mt AS (SELECT 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2, avg(abs(y - p)) AS mae,
               sqrt(sum((y - p) * (y - p)) / count(*)) AS rmse, CAST(count(*) AS DOUBLE) AS n FROM te)
SELECT 'r2' AS metric, {sql_round('r2', 6)} AS value FROM mt
UNION ALL SELECT 'mae', {sql_round('mae', 6)} FROM mt
UNION ALL SELECT 'rmse', {sql_round('rmse', 6)} FROM mt
UNION ALL SELECT 'n', n FROM mt""")
def q_ridge_metrics(spark, sf_dir):
    m = fit_lineitem_ridge(spark, sf_dir)
    return m.metrics.select("metric", round_half_up("value", 6).alias("value"))


@register("ridge_sample", _BASE + f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {sql_round('y', 6)} AS actual,
       {sql_round('p', 6)} AS predicted, {sql_round('abs(y - p)', 3)} AS abs_error
FROM te ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity LIMIT 20""")
def q_ridge_sample(spark, sf_dir):
    m = fit_lineitem_ridge(spark, sf_dir)
    s = m.sample(20)
    return s.select(*[F.col(f"row_key.{c}").alias(c) for c in KEY_COLS[:4]],
                    round_half_up("actual", 6).alias("actual"), round_half_up("predicted", 6).alias("predicted"),
                    "abs_error")


def _contributions(spark, sf_dir, rows):
    c = fit_lineitem_ridge(spark, sf_dir).contributions(rows, n=5)
    return c.select(*[F.col(f"row_key.{k}").alias(k) for k in KEY_COLS], "feature",
                    round_half_up("contribution", 6).alias("contribution"), F.col("rank").cast("int").alias("rank"))


_CONTRIBUTION = "CAST(CASE WHEN abs(cq) >= abs(cd) THEN {} ELSE {} END AS INTEGER) AS rank"


@register("ridge_contributions", _BASE + f"""
, c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, wq * zq AS cq, wd * zd AS cd FROM z, w)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, 'qty' AS feature,
       {sql_round('cq', 6)} AS contribution, {_CONTRIBUTION.format(1, 2)} FROM c
UNION ALL
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, 'disc', {sql_round('cd', 6)}, {_CONTRIBUTION.format(2, 1)} FROM c""")
def q_ridge_contributions(spark, sf_dir):
    """O3 for every row of lineitem."""
    return _contributions(spark, sf_dir, lineitem_ridge_input(spark, sf_dir))


def _blank_inputs(raw):
    """Rows as new inputs, with blanks: quantity missing on line 1, discount missing on line 2."""
    ln = F.col("row_key.l_linenumber")
    return raw.select("row_key", "l_orderkey", F.when(ln == 1, None).otherwise(F.col("qty")).alias("qty"),
                      F.when(ln == 2, None).otherwise(F.col("disc")).alias("disc"))


def _predict_filled(spark, sf_dir, rows):
    m = ridge(lineitem_ridge_input(spark, sf_dir), key="row_key", target="y", features=["qty", "disc"],
              alpha=1.0, folds=5, test_fold=0, split_col="l_orderkey", prep=True)
    p = m.predict(_blank_inputs(rows))
    return p.select(*[F.col(f"row_key.{k}").alias(k) for k in KEY_COLS], round_half_up("prediction", 6)
                    .alias("prediction"), F.array_join("missing_filled", ",").alias("missing_filled"))


@register("ridge_predict_filled", _BASE + f"""
, med AS (SELECT median(l_quantity) AS mq2, median(l_discount) AS md2 FROM lineitem),
inp AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
               CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END AS q,
               CASE WHEN l_linenumber = 2 THEN NULL ELSE l_discount END AS d FROM lineitem),
zz AS (SELECT inp.*, (coalesce(q, mq2) - mq) / CASE WHEN sq = 0 THEN 1 ELSE sq END AS zq,
              (coalesce(d, md2) - md) / CASE WHEN sd = 0 THEN 1 ELSE sd END AS zd FROM inp, med, st)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
       {sql_round('(w.ay - w.aq * w.wq - w.ad * w.wd) + w.wq * zq + w.wd * zd', 6)} AS prediction,
       concat_ws(',', CASE WHEN q IS NULL THEN 'qty' END, CASE WHEN d IS NULL THEN 'disc' END) AS missing_filled
FROM zz, w""")
def q_ridge_predict_filled(spark, sf_dir):
    """V1 + F11: ridge fitted with the shared preprocessing (median fills), scoring every row with blank fields."""
    return _predict_filled(spark, sf_dir, lineitem_ridge_input(spark, sf_dir))
