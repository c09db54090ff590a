"""Least and mean distances by trees against all pairs."""

import numpy as np

from tabwise.operators import distances
from tabwise.operators.distances import _Opened, _tree, tree_distance_stats


def _pairs(q, x):
    return np.sqrt(((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))


def test_far_members_are_not_visited_one_by_one(monkeypatch):
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(20_000, 2)), rng.integers(1, 4, 20_000)
    x[:9000, 1] = rng.integers(0, 5, 9000)  # stripes
    q = rng.normal(size=(200, 2)) * 0.1 + (2.5, 1)
    seen, plain = [], distances._near
    monkeypatch.setattr(distances, "_near", lambda a, b: seen.append(len(b)) or plain(a, b))
    total, least = _Opened(_tree(x, w), 2).answer(q, np.inf)
    d = _pairs(q, x)
    assert np.allclose(total, d @ w, rtol=1e-12, atol=0) and np.array_equal(least, d.min(axis=1))
    assert sum(seen) < len(x) / 2


def test_stats_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(distances, "CHUNK_POINTS", 700)
    monkeypatch.setattr(distances, "GROUP_QUERIES", 150)
    rng = np.random.default_rng(4)
    for d in (1, 2, 3):
        x, c = rng.normal(size=(4000, d)), rng.integers(0, 3, 4000)
        x[c == 2] += 50
        x[:600] = x[0]  # copies
        c[:600] = 1
        q = np.concatenate([rng.normal(size=(400, d)), rng.normal(size=(30, d)) * 30])
        mem = spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(x, c)], "x array<double>, cluster int")
        ask = spark.createDataFrame([(i, list(map(float, a))) for i, a in enumerate(q)] + [(1000, [None] * d)], "key long, x array<double>")
        got = {(r["key"], r["cluster"]): r for r in tree_distance_stats(ask, mem, d).collect()}
        assert len(got) == 3 * (len(q) + 1) and np.isnan(got[1000, 0]["avg_distance"]) and np.isnan(got[1000, 0]["min_distance"])
        for k in range(3):
            r = _pairs(q, x[c == k])
            mine = [got[i, k] for i in range(len(q))]
            assert np.array_equal([m["min_distance"] for m in mine], r.min(axis=1))
            assert np.allclose([m["avg_distance"] for m in mine], r.mean(axis=1), rtol=1e-11, atol=0)
    none = tree_distance_stats(ask, mem.where("cluster > 7"), 3)
    assert none.count() == 0
