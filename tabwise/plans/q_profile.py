"""Profile and preprocessing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import round_half_up, sql_round
from ..operators.prep import fit_prep, fit_scaler
from ..operators.profile import missing_report, profile, summary
from ..sources import read_table
from .registry import register

# Column classes of the driver tables (the parquet schema decides them; dates count as text).
PROFILE_TABLES = {
    "customer": [("c_custkey", "n"), ("c_name", "t"), ("c_nationkey", "n"), ("c_acctbal", "n"),
                 ("c_mktsegment", "t")],
    "part": [("p_partkey", "n"), ("p_name", "t"), ("p_brand", "t"), ("p_type", "t"), ("p_size", "n"),
             ("p_retailprice", "n")],
    "lineitem": [("l_orderkey", "n"), ("l_partkey", "n"), ("l_suppkey", "n"), ("l_linenumber", "n"),
                 ("l_quantity", "n"), ("l_extendedprice", "n"), ("l_discount", "n"), ("l_tax", "n"),
                 ("l_returnflag", "t"), ("l_linestatus", "t"), ("l_shipdate", "t")],
}


def _profile_out(df):
    p = profile(df)
    return p.select(F.col("position").cast("long").alias("position"), "column", "type",
                    F.array_join("values", "|").alias("values"), "min", "max", "mean")


def _profile_sql(table: str, cols) -> str:
    parts = []
    for i, (c, kind) in enumerate(cols):
        if kind == "n":
            parts.append(
                f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS \"column\", 'numeric' AS type, "
                f"CAST(NULL AS VARCHAR) AS \"values\", {sql_round(f'min(CAST({c} AS DOUBLE))')} AS min, "
                f"{sql_round(f'max(CAST({c} AS DOUBLE))')} AS max, {sql_round(f'avg(CAST({c} AS DOUBLE))')} AS mean "
                f"FROM {table}")
        else:
            v = f"CAST({c} AS VARCHAR)"
            parts.append(
                f"SELECT CAST({i} AS BIGINT), '{c}', "
                f"CASE WHEN count(DISTINCT {v}) <= 50 THEN 'categorical' ELSE 'text' END, "
                f"CASE WHEN count(DISTINCT {v}) <= 50 THEN "
                f"array_to_string(list_sort(list(DISTINCT {v}) FILTER (WHERE {v} IS NOT NULL)), '|') ELSE '' END, "
                f"CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM {table}")
    return "\nUNION ALL\n".join(parts)


def _make_profile(table):
    def run(spark, sf_dir):
        return _profile_out(read_table(spark, sf_dir, table))
    return run


for _t, _cols in PROFILE_TABLES.items():
    register(f"profile_{_t}", _profile_sql(_t, _cols))(_make_profile(_t))


# ---------------------------------------------------------------------------------------------------------
# customer with NULLs made on both sides: acctbal every 7th key, segment every 5th, nation every 3rd,
# and a column that is 90 % missing (dropped by the > 80 % rule)
def customer_with_nulls(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        "c_custkey",
        "c_name",
        F.when(k % 3 == 0, None).otherwise(F.col("c_nationkey")).alias("c_nationkey"),
        F.when(k % 7 == 0, None).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(k % 5 == 0, None).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        F.when(k % 10 != 0, None).otherwise(F.col("c_acctbal")).alias("sparse_bal"),
    )


CUSTOMER_NULLS_SQL = """
SELECT c_custkey, c_name,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
       CASE WHEN c_custkey % 10 <> 0 THEN NULL ELSE c_acctbal END AS sparse_bal
FROM customer"""


@register("missing_report", f"""
WITH t AS ({CUSTOMER_NULLS_SQL}), n AS (SELECT count(*) AS n FROM t),
m AS (
  SELECT 0 AS position, 'c_custkey' AS "column", count(*) - count(c_custkey) AS k FROM t UNION ALL
  SELECT 1, 'c_name', count(*) - count(c_name) FROM t UNION ALL
  SELECT 2, 'c_nationkey', count(*) - count(c_nationkey) FROM t UNION ALL
  SELECT 3, 'c_acctbal', count(*) - count(c_acctbal) FROM t UNION ALL
  SELECT 4, 'c_mktsegment', count(*) - count(c_mktsegment) FROM t UNION ALL
  SELECT 5, 'sparse_bal', count(*) - count(sparse_bal) FROM t)
SELECT CAST(position AS BIGINT) AS position, "column", CAST(k AS BIGINT) AS n_missing,
       {sql_round('k / n', 6)} AS missing_share, k / n > 0.8 AS dropped
FROM m, n""")
def q_missing_report(spark, sf_dir):
    r = missing_report(customer_with_nulls(spark, sf_dir))
    return r.select(F.col("position").cast("long").alias("position"), "column", "n_missing",
                    round_half_up("missing_share", 6).alias("missing_share"), "dropped")


_FILLS_SQL = f"""
WITH t AS ({CUSTOMER_NULLS_SQL}),
seg AS (SELECT c_mktsegment AS v, count(*) AS n FROM t WHERE c_mktsegment IS NOT NULL GROUP BY 1),
mode_seg AS (SELECT v FROM seg ORDER BY n DESC, v ASC LIMIT 1)
"""


@register("prep_fills", _FILLS_SQL + f"""
SELECT 'c_nationkey' AS "column", 'median' AS kind, {sql_round('median(CAST(c_nationkey AS DOUBLE))', 6)} AS fill_num,
       CAST(NULL AS VARCHAR) AS fill_text FROM t
UNION ALL SELECT 'c_acctbal', 'median', {sql_round('median(c_acctbal)', 6)}, NULL FROM t
UNION ALL SELECT 'c_mktsegment', 'mode', NULL, v FROM mode_seg""")
def q_prep_fills(spark, sf_dir):
    m = fit_prep(customer_with_nulls(spark, sf_dir), key="c_custkey")
    ft = m.fills_table(spark)
    return ft.select("column", "kind", round_half_up("fill_num", 6).alias("fill_num"),
                     F.when(F.col("kind") == "mode", F.col("fill")).alias("fill_text"))


@register("prep_encode", f"""
WITH t AS ({CUSTOMER_NULLS_SQL}),
d AS (SELECT DISTINCT c_mktsegment AS value FROM t WHERE c_mktsegment IS NOT NULL)
SELECT 'c_mktsegment' AS "column", value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS BIGINT) AS code FROM d""")
def q_prep_encode(spark, sf_dir):
    m = fit_prep(customer_with_nulls(spark, sf_dir), key="c_custkey")
    return m.encodings_table(spark).select("column", "value", F.col("code").cast("long").alias("code"))


_PREP_TABLE_SQL = _FILLS_SQL + """,
codes AS (SELECT value, dense_rank() OVER (ORDER BY value) - 1 AS code
          FROM (SELECT DISTINCT c_mktsegment AS value FROM t WHERE c_mktsegment IS NOT NULL)),
med AS (SELECT median(CAST(c_nationkey AS DOUBLE)) AS nk, median(c_acctbal) AS ab FROM t),
clean AS (
  SELECT t.c_custkey,
         coalesce(CAST(t.c_nationkey AS DOUBLE), med.nk) AS c_nationkey,
         coalesce(t.c_acctbal, med.ab) AS c_acctbal,
         CAST(codes.code AS DOUBLE) AS c_mktsegment
  FROM t CROSS JOIN med CROSS JOIN mode_seg
  JOIN codes ON codes.value = coalesce(t.c_mktsegment, mode_seg.v))
"""


@register("prep_table", _PREP_TABLE_SQL + f"""
SELECT c_custkey, {sql_round('c_nationkey', 6)} AS c_nationkey, {sql_round('c_acctbal', 6)} AS c_acctbal,
       {sql_round('c_mktsegment', 6)} AS c_mktsegment FROM clean""")
def q_prep_table(spark, sf_dir):
    df = customer_with_nulls(spark, sf_dir)
    m = fit_prep(df, key="c_custkey")
    clean = m.transform(df)
    return clean.select("c_custkey", *[round_half_up(c, 6).alias(c) for c in m.columns])


@register("prep_scale", _PREP_TABLE_SQL + f""",
st AS (SELECT avg(c_nationkey) AS mn, stddev_pop(c_nationkey) AS sn, avg(c_acctbal) AS ma,
              stddev_pop(c_acctbal) AS sa, avg(c_mktsegment) AS ms, stddev_pop(c_mktsegment) AS ss FROM clean)
SELECT c_custkey,
  {sql_round('(c_nationkey - mn) / CASE WHEN sn = 0 THEN 1 ELSE sn END', 6)} AS c_nationkey,
  {sql_round('(c_acctbal - ma) / CASE WHEN sa = 0 THEN 1 ELSE sa END', 6)} AS c_acctbal,
  {sql_round('(c_mktsegment - ms) / CASE WHEN ss = 0 THEN 1 ELSE ss END', 6)} AS c_mktsegment
FROM clean, st""")
def q_prep_scale(spark, sf_dir):
    df = customer_with_nulls(spark, sf_dir)
    m = fit_prep(df, key="c_custkey")
    clean = m.transform(df)
    sc = fit_scaler(clean, m.columns)
    z = sc.transform(clean, keep=["c_custkey"])
    return z.select("c_custkey", *[round_half_up(c, 6).alias(c) for c in m.columns])


SUMMARY_STATEMENT = "which market segment will a customer join"


@register("summary_customer", """
SELECT count(*) AS n_rows, 5 AS n_columns, 3 AS n_numeric,
       CAST((count(DISTINCT c_name) > 50)::INTEGER + (count(DISTINCT c_mktsegment) > 50)::INTEGER AS INTEGER) AS n_text,
       'c_mktsegment' AS target
FROM customer""")
def q_summary_customer(spark, sf_dir):
    """Rows, columns, numeric and text columns, and the likely target for a statement."""
    return summary(read_table(spark, sf_dir, "customer"), SUMMARY_STATEMENT)
