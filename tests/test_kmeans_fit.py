"""k-means|| seeding and the sweep against a plain version; odd tables."""

import hashlib

import numpy as np
import pytest

from tabwise.operators.kmeans import kmeans
from tabwise.operators.kmeans_fit import candidates, fit_rows, fit_sweep, reduce_candidates


def digest(*names):
    return hashlib.md5(":".join(map(str, names)).encode()).hexdigest()


def plain(points, ks, seed, rounds, oversample, steps):
    """{k: (centres, inertia)} of points {key text: vector}, by loops over them."""
    ids = sorted(points)
    X = {i: np.array(points[i], dtype=float) for i in ids}

    def near(x, centres):
        d = [float(((x - c) ** 2).sum()) for c in centres]
        return d.index(min(d)), min(d)
    found = [X[min(ids, key=lambda i: (digest(i, "start", seed), i))]]
    for r in range(rounds):
        d2 = {i: near(X[i], found)[1] for i in ids}
        cost, new = sum(d2.values()), {}
        for i in ids:
            if int(digest(i, r, seed)[:13], 16) / 16 ** 13 * cost < oversample * d2[i]:
                new.setdefault(tuple(X[i]), i)
        found += [np.array(x) for x, _ in sorted(new.items(), key=lambda p: p[1])]
    weight = [0] * len(found)
    for i in ids:
        weight[near(X[i], found)[0]] += 1
    taken = [weight.index(max(weight))]
    while len(taken) < max(ks):
        gain = [w * near(c, [found[t] for t in taken])[1] for w, c in zip(weight, found)]
        if max(gain) <= 0:
            break
        taken.append(gain.index(max(gain)))
    out = {}
    for k in ks:
        centres = [found[t] for t in taken[:k]]
        for _ in range(steps):
            own = {i: near(X[i], centres)[0] for i in ids}
            centres = [np.mean([X[i] for i in ids if own[i] == j], axis=0) if j in own.values() else c for j, c in enumerate(centres)]
        out[k] = (np.array(centres), sum(near(X[i], centres)[1] for i in ids))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_plain_version(spark, seed):
    rng = np.random.default_rng(seed)
    X = np.vstack([rng.normal(c, 0.6, size=(50, 3)) for c in ([0, 0, 0], [5, 5, 0], [0, 6, 3])] + [np.ones((75, 3))])  # a third on one value
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(X)], "k int, a double, b double, c double")
    expected = plain({str(i): x for i, x in enumerate(X)}, [2, 3, 5], seed, 3, 8, 6)
    for parts in (1, 5):
        got = fit_sweep(fit_rows(df.repartition(parts), "k", ["a", "b", "c"]), [2, 3, 5], seed, 6, 3, 8)
        for k in (2, 3, 5):
            assert np.allclose(got[k][0], expected[k][0], atol=1e-9) and abs(got[k][1] - expected[k][1]) < 1e-6


def test_about_oversample_rows_join_a_round(spark):
    df = spark.range(20_000).selectExpr("id as k", "sin(id) as a", "cos(id * 7) as b")
    rows = fit_rows(df, "k", ["a", "b"])
    assert 1 + 20 <= len(candidates(rows, 16, 4, 7)) <= 1 + 4 * 16 * 2


def test_odd_tables(spark):
    schema = "k int, a double, b double"
    # two different rows for k up to 4: two centres, nothing left over
    few = spark.createDataFrame([(i, float(i % 2), 0.0) for i in range(30)], schema)
    fits = fit_sweep(fit_rows(few, "k", ["a", "b"]), [2, 3, 4])
    assert all(len(c) == 2 and cost == 0 for c, cost in fits.values())
    # null and repeated keys, missing and NaN values, one constant column
    odd = spark.createDataFrame([(None, 1.0, 5.0), (None, 2.0, 5.0), (3, None, 5.0), (3, float("nan"), 5.0), (3, 9.0, 5.0), (3, 9.0, 5.0)], schema)
    assert sorted(r["x"][0] for r in fit_rows(odd, "k", ["a", "b"]).collect()) == [1.0, 2.0, 9.0, 9.0]
    m = kmeans(odd.where("not isnan(a)"), "k", ["a", "b"], k=2, prep=False)
    assert m.k == 2 and sum(r["size"] for r in m.sizes.collect()) == 5
    one = kmeans(spark.createDataFrame([(1, 2.0, 3.0)], schema), "k", ["a", "b"], k=3, prep=False)
    assert one.k == 1 and one.inertia == 0
    with pytest.raises(ValueError):
        fit_sweep(fit_rows(few.where("false"), "k", ["a", "b"]), [2])


def test_reduction_takes_heavy_and_distant():
    points = np.array([[0.0], [0.1], [10.0], [30.0]])
    assert reduce_candidates(points, np.array([5.0, 6.0, 4.0, 1.0]), 3).ravel().tolist() == [0.1, 30.0, 10.0]
