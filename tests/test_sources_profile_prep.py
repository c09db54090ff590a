import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import sample_orchard
from tabwise.operators.prep import fit_prep, fit_scaler
from tabwise.operators.profile import missing_report, profile, summary
from tabwise.operators.stats import exact_medians, mode_of, value_counts
from tabwise.sources import add_key, normalise_missing, read_any, read_csv, read_json


def test_csv_null_tokens_and_types(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("id,x,flag,name\n1,1.5,true,a\n2,NA,false,b\n3,NaN,true,c\n4,,true,d\n5,null,false,e\n6,N/A,true,f\n")
    df = read_csv(spark, str(p))
    types = dict(df.dtypes)
    assert types["id"] == "bigint" and types["x"] == "double" and types["flag"] == "int"
    assert df.where(F.col("x").isNull()).count() == 5
    assert sorted(r[0] for r in df.select("flag").collect()) == [0, 0, 1, 1, 1, 1]


def test_json_lines_and_array(spark, tmp_path):
    a = tmp_path / "a.json"
    a.write_text('{"k": 1, "v": "x"}\n{"k": 2, "v": "NA"}\n')
    b = tmp_path / "b.json"
    b.write_text('[{"k": 1, "v": 2.5}, {"k": 2, "v": null}]')
    da, db = read_json(spark, str(a)), read_json(spark, str(b))
    assert da.where(F.col("v").isNull()).count() == 1
    assert db.count() == 2 and db.where(F.col("v").isNull()).count() == 1


def test_tab_text(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_text("a\tb\n1\tx\n2\ty\n")
    df = read_any(spark, str(p))
    assert df.columns == ["a", "b"] and dict(df.dtypes)["a"] == "bigint"


def test_add_key_unique(spark):
    df = add_key(spark.range(1000).repartition(7).select((F.col("id") % 3).alias("v")))
    assert df.select("row_key").distinct().count() == 1000


def test_profile_sample_table(spark, tmp_path):
    rows, schema = sample_orchard()
    lines = [",".join(c.split()[0] for c in schema.split(", "))] + [",".join(map(str, r)) for r in rows]
    (tmp_path / "orchard.csv").write_text("\n".join(lines))
    df = read_csv(spark, str(tmp_path / "orchard.csv"))
    prof = {r["column"]: r for r in profile(df).collect()}
    assert prof["tag"]["type"] == "text" and prof["tag"]["values"] == []
    assert prof["fruiting"]["type"] == "categorical" and prof["fruiting"]["values"] == ["No", "Yes"]
    assert prof["soil"]["values"] == ["chalk", "clay", "loam", "peat"]
    rings = [r[1] for r in rows]
    assert prof["rings"]["min"] == min(rings) and prof["rings"]["max"] == max(rings)
    assert abs(prof["rings"]["mean"] - round(float(np.mean(rings)), 3)) < 1e-9
    s = summary(df, "predict fruiting trees").first()
    assert s["n_rows"] == 60 and s["n_columns"] == 11 and s["n_text"] == 1 and s["target"] == "fruiting"


def test_json_is_typed_after_the_clean_up(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": "1", "y": "yes"}\n{"x": "NA", "y": "no"}\n{"x": "3", "y": null}\n')
    df = read_json(spark, str(tmp_path / "a.json"))
    assert dict(df.dtypes) == {"x": "bigint", "y": "string"}
    assert sorted((r["x"] or 0, r["y"] or "") for r in df.collect()) == [(0, "no"), (1, "yes"), (3, "")]


def test_profile_all_null_and_booleans(spark):
    df = spark.createDataFrame([(None, True), (None, False), (None, True)], "x double, b boolean")
    prof = {r["column"]: r for r in profile(df).collect()}
    assert prof["x"]["min"] is None and prof["x"]["mean"] is None
    assert prof["b"]["type"] == "numeric" and prof["b"]["max"] == 1.0
    nan = spark.createDataFrame([(float("nan"),), (float("nan"),), (float("nan"),)], "x double")
    p2 = profile(nan).first()
    assert p2["min"] is None and p2["mean"] is None


def test_missing_80_rule(spark):
    rows = [(i, None if i < 8 else float(i), None if i < 9 else float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "k long, kept double, dropped double")
    m = fit_prep(df, key="k")
    assert "kept" in m.columns and m.dropped.get("dropped") == "missing"
    rep = {r["column"]: r for r in missing_report(df).collect()}
    assert rep["kept"]["dropped"] is False and rep["dropped"]["dropped"] is True


def test_distinct_50_51_and_encoding(spark):
    rows = [(i, f"v{i % 50:02d}", f"w{i % 51:02d}") for i in range(102)]
    df = spark.createDataFrame(rows, "k long, a string, b string")
    m = fit_prep(df, key="k")
    assert "a" in m.categories and m.dropped.get("b") == "text"
    out = m.transform(df).where("k = 3").first()
    assert out["a"] == 3.0  # 'v03' is the 4th sorted value


def test_tied_mode_lowest_wins(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, "a"), (5, None)], "k long, c string")
    m = fit_prep(df, key="k")
    assert m.fills["c"] == "a"
    assert mode_of([("b", 2), ("a", 2)]) == "a"
    row = m.transform(df).where("k = 5").first()
    assert row["c"] == 0.0 and m.transform(df).where(F.col("c").isNull()).count() == 0


def test_zero_variance_scales_to_zero(spark):
    df = spark.createDataFrame([(i, 3.0) for i in range(5)], "k long, x double")
    z = fit_scaler(df, ["x"]).transform(df, keep=["k"])
    assert {r["x"] for r in z.collect()} == {0.0}


@pytest.mark.parametrize("limit", [100_000, 50])
def test_exact_medians_match_numpy(spark, limit):
    rng = np.random.default_rng(3)
    a = rng.normal(size=3001)
    b = np.round(rng.exponential(size=3000) * 3)  # heavy ties
    c = np.concatenate([np.full(1000, 7.0), rng.normal(size=999)])  # a third of rows one value
    rows = [(float(a[i]), float(b[i]) if i < 3000 else None, float(c[i]) if i < 1999 else None)
            for i in range(3001)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    med = exact_medians(df, ["a", "b", "c"], limit=limit, accuracy=100)
    assert math.isclose(med["a"], float(np.median(a)), rel_tol=0, abs_tol=1e-12)
    assert math.isclose(med["b"], float(np.median(b)), abs_tol=1e-12)
    assert math.isclose(med["c"], float(np.median(c[:1999])), abs_tol=1e-12)


def test_prep_keeps_rows_and_fills_everything(spark):
    rows, schema = sample_orchard()
    rows = [tuple(None if (i + j) % 9 == 0 and j > 0 else v for j, v in enumerate(r)) for i, r in enumerate(rows)]
    df = add_key(spark.createDataFrame(rows, schema))
    m = fit_prep(df, key="row_key")
    clean = m.transform(df)
    assert clean.count() == 60 and "tag" not in clean.columns
    nulls = clean.select([F.sum(F.col(c).isNull().cast("int")).alias(c) for c in m.columns]).first()
    assert all(v == 0 for v in nulls)


def test_value_counts_bounded(spark):
    df = spark.range(500).select((F.col("id") % 7).cast("string").alias("s"), F.col("id").cast("string").alias("t"))
    vc = value_counts(df, ["s", "t"], 50)
    assert vc["t"] is None and [v for v, _ in vc["s"]] == [str(i) for i in range(7)]


def test_normalise_missing_decimal(spark):
    from decimal import Decimal

    df = spark.createDataFrame([(Decimal("1.00"), "NA")], "a decimal(10,2), b string")
    out = normalise_missing(df)
    assert dict(out.dtypes)["a"] == "double" and out.first()["b"] is None


def test_approximate_medians_and_unseen_category(spark):
    rng = np.random.default_rng(12)
    vals = rng.normal(size=5000)
    df = spark.createDataFrame([(i, float(v), ["a", "b", "c", "d"][i % 4]) for i, v in enumerate(vals)],
                               "k long, x double, s string")
    approx = exact_medians(df, ["x"], approximate=True)["x"]
    assert abs(approx - float(np.median(vals))) < 0.01
    m = fit_prep(df, key="k", exact=False)
    new = spark.createDataFrame([(9000, None, "zzz"), (9001, 1.0, "c")], "k long, x double, s string")
    out = {r["k"]: r for r in m.transform(new).collect()}
    assert out[9000]["s"] == 1.0 and out[9000]["x"] == m.fills["x"]  # unseen → median code of 0..3
    assert out[9001]["s"] == 2.0 and out[9001]["x"] == 1.0
