import duckdb

from __spark_entry__ import entry, oracle_sql, queries
from tabwise.sources import TABLES

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = entry(spark)
    rows = df.collect()
    assert len(rows) == 5 and df.columns == ["position", "column", "type", "values", "min", "max", "mean"]


def test_oracle_keys_subset_of_queries():
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) >= 50


def test_some_queries_match_duckdb_at_smallest_scale(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in ["profile_part", "prep_table", "ridge_coefs", "kmeans_lloyd3", "pca_variance", "tree_root_split",
                 "latest_run", "validate_docs"]:
        sdf = queries()[name](spark, SF)
        order = sorted(range(len(sdf.columns)), key=lambda i: sdf.columns[i])
        a = sorted(tuple(r[i] for i in order) for r in sdf.collect())
        res = con.execute(oracle_sql()[name])
        cols = [d[0] for d in res.description]
        order_b = sorted(range(len(cols)), key=lambda i: cols[i])
        b = sorted(tuple(r[i] for i in order_b) for r in res.fetchall())
        assert [sdf.columns[i] for i in order] == [cols[i] for i in order_b], name
        assert a == b, name
