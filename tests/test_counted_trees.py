"""Trees grown on counted cells against the rows themselves."""

import numpy as np
from pyspark.sql import functions as F

from tabwise.operators.trees import best_bins, count_cells, feature_cuts, forest, tree


def _rows(spark, n=3000):
    rng = np.random.default_rng(8)
    a, b, c = rng.integers(0, 6, n), rng.integers(0, 5, n), rng.normal(size=n).round(1)
    y = ((a > 2) & (b < 3)) ^ (rng.random(n) < 0.1)
    rows = [(i, float(a[i]), float(b[i]) if i % 50 else None, float(c[i]), int(y[i]) if i % 70 else None) for i in range(n)]
    return spark.createDataFrame(rows, "k long, a double, b double, c double, y int"), rows


def test_rows_that_share_bins_are_counted_once_and_all_of_them(spark):
    df, rows = _rows(spark)
    x = F.array("a", F.coalesce("b", F.lit(float("nan")))).alias("x")
    cells = count_cells(df.select("k", x, F.col("y").cast("double").alias("label"), (F.col("k") % 5).alias("fold")),
                        [np.arange(5) + 0.5, np.arange(4) + 0.5]).collect()
    n = np.concatenate([np.frombuffer(r["n"], np.int64) for r in cells])
    assert n.sum() == sum(r[4] is not None for r in rows) and len(n) <= 6 * 5 * 2 * 5 + 60


def test_tree_of_cells_splits_as_a_scan_of_the_rows_does(spark):
    df, rows = _rows(spark)
    m = tree(df, "k", "y", ["a", "b", "c"], depth=4, cv=True, prep=False)
    train = [r for r in rows if r[0] % 5 and r[4] is not None]
    y = np.array([r[4] for r in train])
    best = None
    for f in range(3):
        v = np.array([np.inf if r[f + 1] is None else r[f + 1] for r in train])
        for cut in feature_cuts(v, 64):
            left = v <= cut
            g = sum(s.sum() * 2 * y[s].mean() * (1 - y[s].mean()) for s in (left, ~left) if s.any())
            if best is None or g < best[0] - 1e-9:
                best = (g, f, cut)
    root = m.trees[0]
    assert (root.feature[0], m.cuts[root.feature[0]][root.cut[0]]) == best[1:]
    assert root.counts[0].tolist() == [int((y == 0).sum()), int((y == 1).sum())]
    pred = m.test_pred.where("label is not null").collect()
    acc = {r["metric"]: r["value"] for r in m.metrics.collect()}
    assert abs(acc["accuracy"] - np.mean([r["label"] == r["prediction"] for r in pred])) < 1e-12
    assert m.cv_scores[0] == m.accuracy and len(m.cv_scores) == 5 and 0.8 < acc["cv_score"] < 0.95


def test_bags_of_cells_spread_like_bags_of_rows(spark):
    df, rows = _rows(spark)
    m = forest(df, "k", "y", ["a", "b", "c"], trees=60, depth=3, cv=False, prep=False)
    n = sum(r[0] % 5 > 0 and r[4] is not None for r in rows)
    whole = np.array([t.counts[0].sum() for t in m.trees])
    assert abs(whole.mean() - n) < 4 * np.sqrt(n / 60) and 0.5 * n < whole.var() < 1.7 * n
    assert len({tuple(t.feature[:3]) for t in m.trees}) > 1
    again = forest(df.repartition(7), "k", "y", ["a", "b", "c"], trees=60, depth=3, cv=False, prep=False)
    assert [t.counts.tolist() for t in m.trees] == [t.counts.tolist() for t in again.trees]


def test_best_bin_leaves_no_side_empty():
    hist = np.zeros((1, 1, 4, 2))
    hist[0, 0, 2] = (3, 4)
    assert best_bins(hist)[0][0] < 0
    hist[0, 0, 3] = (5, 0)
    gain, j, b, left, whole = best_bins(hist)
    assert gain[0] > 0 and b[0] == 2 and left[0].tolist() == [3, 4] and whole[0].tolist() == [8, 4]


def test_nodes_without_a_split_stay_leaves(spark):
    """A tree that finds nothing to split while others do, and one class alone."""
    df = spark.createDataFrame([(i, float(i % 2), 1.0, 1.0, 1.0, i % 2) for i in range(60)], "k long, a double, b double, c double, d double, y int")
    m = forest(df, "k", "y", ["a", "b", "c", "d"], trees=12, depth=3, cv=True, folds=3, prep=False)
    assert {t.feature[0] for t in m.trees} == {0, -1} and m.accuracy is not None and len(m.cv_scores) == 3
    one = tree(df.withColumn("y", F.lit(4)), "k", "y", ["a", "b"], prep=False)
    assert (one.depth, one.leaves, one.accuracy) == (0, 1, 1.0) and "Predict: 4" in one.rules
