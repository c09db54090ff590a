import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwise.operators.kmeans import kmeans, kmeans_from, lloyd, elbow_k
from tabwise.operators.pca import pca, pca_reduce
from tabwise.operators.ridge import ridge
from tabwise.operators.trees import best_split, forest, tree


def _frame(spark, X, y=None, key="k"):
    cols = [f"x{j}" for j in range(X.shape[1])]
    rows = [(i, *map(float, X[i])) + ((float(y[i]),) if y is not None else ()) for i in range(len(X))]
    schema = f"{key} long, " + ", ".join(f"{c} double" for c in cols) + (", y double" if y is not None else "")
    return spark.createDataFrame(rows, schema), cols


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(400, 3)) * [1.0, 5.0, 0.2] + [3, -1, 10]
    y = X @ [2.0, -0.5, 7.0] + rng.normal(size=400)
    df, cols = _frame(spark, X, y)
    m = ridge(df, "k", "y", cols, alpha=50.0, folds=5, test_fold=0, prep=False)
    Z = (X - X.mean(0)) / X.std(0)
    tr = np.arange(400) % 5 != 0
    Zc, yc = Z[tr] - Z[tr].mean(0), y[tr] - y[tr].mean()
    w = np.linalg.solve(Zc.T @ Zc + 50.0 * np.eye(3), Zc.T @ yc)
    b = y[tr].mean() - Z[tr].mean(0) @ w
    assert np.allclose(m.coef, w, atol=1e-8) and abs(m.intercept - b) < 1e-8
    met = {r["metric"]: r["value"] for r in m.metrics.collect()}
    p = Z[~tr] @ w + b
    r2 = 1 - ((y[~tr] - p) ** 2).sum() / ((y[~tr] - y[~tr].mean()) ** 2).sum()
    assert abs(met["r2"] - r2) < 1e-9 and abs(met["mae"] - np.abs(y[~tr] - p).mean()) < 1e-9
    assert m.sample(20).count() == 20
    top = m.contributions(df, n=2)
    assert top.groupBy("k").count().agg(F.max("count")).first()[0] == 2


def test_pca_matches_numpy_and_errors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 2))
    X = np.column_stack([base[:, 0], base[:, 0] * 0.8 + base[:, 1] * 0.3, base[:, 1], rng.normal(size=300)])
    df, cols = _frame(spark, X)
    m = pca(df, "k", cols, prep=False)
    ev = np.sort(np.linalg.eigvalsh(np.cov(((X - X.mean(0)) / X.std(0)).T, bias=True)))[::-1]
    assert np.allclose(m.eigenvalues, ev, atol=1e-9)
    var = m.variance.orderBy("component").collect()
    assert all(var[i]["explained_pct"] >= var[i + 1]["explained_pct"] for i in range(len(var) - 1))
    assert abs(var[-1]["cumulative_pct"] - 100.0) < 1e-9
    out, side = pca_reduce(df, "k", 2, cols, prep=False)
    assert out.columns == ["k", "PC1", "PC2"] and out.count() == 300
    scores = np.array([[r["PC1"], r["PC2"]] for r in out.orderBy("k").collect()])
    assert abs(scores[:, 0].var() - ev[0]) < 1e-8  # PC variance = eigenvalue (population)
    for bad in (0, 5):
        with pytest.raises(ValueError):
            pca_reduce(df, "k", bad, cols, prep=False)
    with pytest.raises(ValueError):
        pca_reduce(df, "k", 1, cols[:2], prep=False)


def test_lloyd_matches_numpy_and_sizes(spark):
    rng = np.random.default_rng(4)
    X = np.vstack([rng.normal(loc=c, size=(60, 2)) for c in ([0, 0], [6, 6], [0, 8])])
    df, cols = _frame(spark, X)
    m = kmeans_from(df, "k", cols, init_centers=[[-1, -1], [1, 1], [-1, 1]], iterations=5)
    Z = (X - X.mean(0)) / X.std(0)
    C = np.array([[-1, -1], [1, 1], [-1, 1]], dtype=float)
    for _ in range(5):
        lab = np.argmin(((Z[:, None, :] - C[None]) ** 2).sum(2), axis=1)
        C = np.array([Z[lab == j].mean(0) if (lab == j).any() else C[j] for j in range(3)])
    assert np.allclose(m.centers, C, atol=1e-9)
    assert sum(r["size"] for r in m.sizes.collect()) == 180
    full = kmeans(df, "k", cols, k=None, k_range=(2, 5), seed=1, prep=False)
    assert full.k in (2, 3, 4, 5) and full.elbow_table.count() == 4
    assert -1.0 <= full.silhouette <= 1.0
    assert elbow_k([2, 3, 4, 5], [100, 20, 15, 12]) == 3


def test_trees_importances_probabilities_and_split(spark):
    rng = np.random.default_rng(5)
    X = rng.uniform(size=(600, 3))
    y = ((X[:, 0] > 0.6) | (X[:, 1] < 0.2)).astype(float)
    df, cols = _frame(spark, X, y)
    t = tree(df, "k", "y", cols, depth=4, cv=False, prep=False)
    assert t.depth <= 4 and t.leaves >= 2
    imp = [r["importance"] for r in t.importances.collect()]
    assert abs(sum(imp) - 1.0) < 1e-9
    acc = {r["metric"]: r["value"] for r in t.metrics.collect()}["accuracy"]
    assert acc > 0.9
    f = forest(df, "k", "y", cols, trees=10, depth=5, cv=True, folds=3, prep=False)
    metrics = {r["metric"]: r["value"] for r in f.metrics.collect()}
    assert "cv_score" in metrics and metrics["accuracy"] > 0.9
    pred = f.predict(df.drop("y")).collect()
    for r in pred[:20]:
        assert abs(sum(p["probability"] for p in r["probabilities"]) - 100.0) < 1e-6
    # exact root split on x0 against a brute-force Gini scan
    b = best_split(df, "x0", "y").first()
    xs = np.sort(np.unique(X[:, 0]))
    best = None
    for i in range(len(xs) - 1):
        thr = (xs[i] + xs[i + 1]) / 2
        left = X[:, 0] <= xs[i]
        g = 0.0
        for side in (left, ~left):
            n = side.sum()
            p1 = y[side].mean()
            g += n / len(y) * (1 - p1 ** 2 - (1 - p1) ** 2)
        if best is None or g < best[0] - 1e-15:
            best = (g, thr)
    assert abs(b["gini"] - best[0]) < 1e-12 and abs(b["threshold"] - best[1]) < 1e-12


def test_forest_does_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(400, 3))
    rows = [(i, *map(float, X[i]), int(X[i, 0] + X[i, 1] > 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, y int")
    got = [[(r["feature"], r["importance"]) for r in forest(d, "k", "y", ["a", "b", "c"], trees=8, depth=4, cv=False, prep=False)
            .importances.orderBy("feature").collect()] for d in (df, df.repartition(5), df.orderBy(F.desc("k")).coalesce(1))]
    assert got[0] == got[1] == got[2]


def test_rules_and_scoring_speak_of_classes_and_categories(spark):
    rows = [(i, ["red", "green", "blue"][i % 3], float(i % 7), "warm" if i % 3 == 0 else "cold") for i in range(90)]
    df = spark.createDataFrame(rows, "k long, colour string, size double, kind string")
    t = tree(df, "k", "kind", depth=3, cv=False)
    assert "colour in {red}" in t.rules and "Predict: warm" in t.rules and "feature" not in t.rules.split("\n", 1)[1]
    new = spark.createDataFrame([(1000, "red", None), (1001, None, 2.0)], "k long, colour string, size double")
    out = {r["k"]: r for r in t.predict(new).collect()}
    assert out[1000]["prediction"] == "warm" and out[1000]["missing_filled"] == ["size"] and out[1001]["missing_filled"] == ["colour"]
    assert out[1000]["target_col"] == "kind"


def test_kmeans_scoring_lists_filled_columns(spark):
    df = spark.createDataFrame([(i, float(i % 2) * 10, float(i % 2) * 10 + i / 100) for i in range(40)], "k long, a double, b double")
    m = kmeans_from(df, "k", ["a", "b"], [[-1.0, -1.0], [1.0, 1.0]], 2, prep=True)
    got = m.score(spark.createDataFrame([(1, 0.0, None), (2, 10.0, 10.0)], "k long, a double, b double")).collect()
    assert {r["k"]: r["missing_filled"] for r in got} == {1: ["b"], 2: []}
