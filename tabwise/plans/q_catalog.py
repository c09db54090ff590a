"""Catalog queries (P6–P11, R1, L1) over project-like tables derived from customer and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.catalog import hide_columns, latest_runs, patch, search, split_by, visible
from ..sources import infer_types, manifest, normalise_missing, parse_json_inputs, read_table
from .registry import register


def _projects(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    starred = F.when(F.col("c_custkey") % 11 == 0, F.lit(None)).otherwise(F.col("c_acctbal") > 5000)
    return c.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", starred.alias("starred"))


_PROJECTS_SQL = """(SELECT c_custkey, c_name, c_acctbal, c_mktsegment,
        CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal > 5000 END AS starred FROM customer)"""


@register("visible_projects", f"""
SELECT c_custkey, c_name, starred FROM {_PROJECTS_SQL} p WHERE coalesce(starred, false)""")
def q_visible_projects(spark, sf_dir):
    v = visible(_projects(spark, sf_dir), role="developer")
    return hide_columns(v, ("c_acctbal", "c_mktsegment"))


@register("search_projects", """
SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), lower('CUSTOMER#0000001'))""")
def q_search_projects(spark, sf_dir):
    return search(read_table(spark, sf_dir, "customer"), "CUSTOMER#0000001", column="c_name").select(
        "c_custkey", "c_name")


@register("patch_projects", """
WITH o AS (SELECT o_custkey, o_orderdate, CASE WHEN o_custkey % 3 = 0 THEN o_totalprice END AS bal,
                  CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS seg FROM orders),
b AS (SELECT o_custkey, bal FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, bal DESC) AS k
                                  FROM o WHERE bal IS NOT NULL) WHERE k = 1),
g AS (SELECT o_custkey, seg FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, seg DESC) AS k
                                  FROM o WHERE seg IS NOT NULL) WHERE k = 1)
SELECT c.c_custkey, c.c_name, coalesce(b.bal, c.c_acctbal) AS c_acctbal, coalesce(g.seg, c.c_mktsegment) AS c_mktsegment
FROM customer c LEFT JOIN b ON b.o_custkey = c.c_custkey LEFT JOIN g ON g.o_custkey = c.c_custkey""")
def q_patch_projects(spark, sf_dir):
    """Every order is a patch of its customer, many per key, merged field by field in the order of their dates."""
    base = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    changes = read_table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderdate", F.when(F.col("o_custkey") % 3 == 0, F.col("o_totalprice")).alias("c_acctbal"),
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).alias("c_mktsegment"))
    return patch(base, changes, "c_custkey", order="o_orderdate")


def _route(status):
    def run(spark, sf_dir):
        o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
        return split_by(o, "o_orderstatus", ["F", "O", "P"])[status]
    return run


for _s in ("F", "O"):
    register(f"route_split_{_s}", f"""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = '{_s}'""")(_route(_s))


@register("latest_run", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
WHERE rn = 1""")
def q_latest_run(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return latest_runs(o, project="o_custkey", order=["o_orderdate", "o_orderkey"]).select(
        "o_custkey", "o_orderkey", "o_totalprice")


@register("parse_event_props", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE json_valid(props)""")
def q_parse_event_props(spark, sf_dir):
    """JSON input rows parsed into typed columns (invalid rows are set aside, not failed)."""
    good, _bad = parse_json_inputs(read_table(spark, sf_dir, "events"), "props", "k int", keep=["event_id"])
    return good


@register("lineitem_manifest")
def q_lineitem_manifest(spark, sf_dir):
    """Name, size in bytes and rows of every file behind the lineitem table."""
    name = F.element_at(F.split("file_name", "/"), -1).alias("file_name")
    return manifest(read_table(spark, sf_dir, "lineitem")).select(name, "file_size", "n_rows")


@register("lineitem_manifest_rows", "SELECT count(*) AS n_rows FROM lineitem")
def q_lineitem_manifest_rows(spark, sf_dir):
    """The rows of all files together."""
    return manifest(read_table(spark, sf_dir, "lineitem")).agg(F.sum("n_rows").alias("n_rows"))


@register("clean_made_tokens", """
SELECT c_custkey AS key, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS balance,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey + 0 END::BIGINT AS nation,
       CASE WHEN c_custkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS active,
       CASE WHEN c_custkey % 3 = 0 THEN 1 WHEN c_custkey % 13 = 0 THEN NULL ELSE 0 END::INTEGER AS flag
FROM customer""")
def q_clean_made_tokens(spark, sf_dir):
    """S5 over customer rows turned to text with missing tokens put in: cleaned and typed again; yes/no stays text."""
    k, text = F.col("c_custkey"), lambda c: F.col(c).cast("string")
    raw = read_table(spark, sf_dir, "customer").select(
        text("c_custkey").alias("key"),
        F.when(k % 7 == 0, "NA").when(k % 11 == 0, " n/a ").otherwise(text("c_acctbal")).alias("balance"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(" "), text("c_nationkey"))).alias("nation"),
        F.when(k % 2 == 0, "Yes").otherwise("No").alias("active"),
        F.when(k % 3 == 0, "true").when(k % 13 == 0, "NaN").otherwise("FALSE").alias("flag"))
    return infer_types(normalise_missing(raw))


_LOG_SQL = """
WITH log AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN 'cleared' WHEN 'signup' THEN 'restarted'
                    ELSE 'ok' END AS status, event_type AS technique, value AS result FROM events),
lastrow AS (SELECT user_id, status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r
            FROM log) WHERE r = 1),
run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r
        FROM log WHERE status <> 'cleared') WHERE r = 1 AND status <> 'restarted')
SELECT run.user_id, run.event_id, run.technique,
       CASE WHEN lastrow.status = 'cleared' THEN 'cleared' ELSE run.status END AS status,
       CASE WHEN lastrow.status = 'cleared' THEN NULL ELSE run.result END AS result
FROM run JOIN lastrow USING (user_id)"""


@register("run_log_state", _LOG_SQL)
def q_run_log_state(spark, sf_dir):
    """L1-L3 with events as a run log: errors clear the results, signups restart the project."""
    log = read_table(spark, sf_dir, "events").select(
        "user_id", "ts", "event_id", F.when(F.col("event_type") == "error", "cleared")
        .when(F.col("event_type") == "signup", "restarted").otherwise("ok").alias("status"),
        F.col("event_type").alias("technique"), F.col("value").alias("result"))
    return latest_runs(log, project="user_id", order=["ts", "event_id"]).select("user_id", "event_id", "technique",
                                                                                 "status", "result")
