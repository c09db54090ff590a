from tabwise.plans.registry import QUERIES
from tabwise.sources import read_table

SF = "/root/testdata/sf0.001"


def test_ridge_scores_every_row(spark):
    n = read_table(spark, SF, "lineitem").count()
    assert QUERIES["ridge_contributions"](spark, SF).count() == 2 * n
    assert QUERIES["ridge_predict_filled"](spark, SF).count() == n


def test_manifest_names_every_file_with_size_and_rows(spark):
    import os
    rows = QUERIES["lineitem_manifest"](spark, SF).collect()
    size = os.path.getsize(f"{SF}/lineitem.parquet")
    assert [(r.file_name, r.file_size) for r in rows] == [("lineitem.parquet", size)]
    assert rows[0].n_rows == read_table(spark, SF, "lineitem").count() == QUERIES["lineitem_manifest_rows"](spark, SF).first().n_rows
