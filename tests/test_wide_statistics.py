"""Statistics of tables with hundreds of columns against NumPy."""

import numpy as np
import pandas as pd
import pytest

from tabwise.operators import stats
from tabwise.operators.pca import pca


@pytest.fixture
def wide(spark):
    rng = np.random.default_rng(11)
    X = rng.normal(size=(900, 8)) @ rng.normal(size=(8, 500)) + rng.normal(size=(900, 500)) * 0.1
    X[:, ::7] += 1e8  # large values must not cancel
    cols = [f"c {i}" for i in range(500)]
    return spark.createDataFrame(pd.DataFrame(X, columns=cols)), cols, X


def test_covariance_of_500_columns(wide, monkeypatch):
    df, cols, X = wide
    truth, spread = np.cov(X.T, bias=True), np.sqrt(np.outer(X.var(0), X.var(0)))
    for parts, fan in ((3, 64), (17, 2)):  # in one step; in several, blocks merged two by two
        monkeypatch.setattr(stats, "FAN", fan)
        n, m, cov = stats.centered_moments(df.repartition(parts), cols)
        assert n == 900 and np.allclose(m, X.mean(0), rtol=1e-12, atol=1e-9)
        assert np.abs((cov - truth) / spread).max() < 1e-6 and (cov == cov.T).all()
    ms = stats.mean_std(df, cols)
    assert np.allclose([ms[c][0] for c in cols], X.mean(0), rtol=1e-12, atol=1e-9) and np.allclose([ms[c][1] for c in cols], X.std(0), rtol=1e-6)


def test_both_ways_agree_on_nulls_and_empty_tables(spark, monkeypatch):
    rows = [(None if i % 9 == 0 else float(i), float(i * i % 7), None if i % 4 == 0 else 3.0) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, n double")
    for table in (df, df.where("false"), df.withColumn("n", df.n * None)):
        plain = stats.centered_moments(table, ["a", "b", "n"]), stats.mean_std(table, ["a", "b", "n"])
        with monkeypatch.context() as m:
            m.setattr(stats, "WIDE", 1)
            other = stats.centered_moments(table, ["a", "b", "n"]), stats.mean_std(table, ["a", "b", "n"])
        assert plain[0][0] == other[0][0] and all(np.allclose(x, y) for x, y in zip(plain[0][1:], other[0][1:]))
        for c in "abn":
            assert [v is None for v in plain[1][c]] == [v is None for v in other[1][c]]
            assert np.allclose([v or 0 for v in plain[1][c]], [v or 0 for v in other[1][c]])


def test_pca_of_500_columns(wide):
    df, cols, X = wide
    model = pca(df.selectExpr("monotonically_increasing_id() as id", "*"), "id", cols, prep=False)
    ev = np.linalg.eigvalsh(np.corrcoef(X.T))[::-1]
    assert np.allclose(model.eigenvalues[:8], ev[:8], rtol=1e-4) and abs(model.eigenvalues.sum() - 500) < 1e-3
