"""Hashed forest against a plain one that grows every tree by itself."""

import hashlib
import math
import random

import pytest

from tabwise.operators import bagged
from tabwise.operators.bagged import bagged_forest


def md5(*names):
    return hashlib.md5(":".join(map(str, names)).encode()).hexdigest()


def times(id_, t, seed):
    """Poisson(1) by the distribution function."""
    u = int(md5(id_, t // 4, seed)[8 * (t % 4):8 * (t % 4) + 8], 16) / 2 ** 32
    n, p = 0, math.exp(-1)
    total = p
    while u >= total and n < 12:
        n += 1
        p /= n
        total += p
    return n


def plain(rows, k, trees, depth, bins, tries, seed):
    """{(tree, node): (counts, feature, threshold)} of rows (id, x, class)."""
    p = len(rows[0][1])
    cuts = []
    sample = sorted(rows, key=lambda r: (md5(r[0], "cuts", seed), r[0], r[1]))[:bagged.CUT_ROWS]
    for f in range(p):
        v = sorted(x[f] for _, x, _ in sample)
        cuts.append(sorted({v[math.ceil(len(v) * b / bins) - 1] for b in range(1, bins)}))
    out = {}

    def grow(t, node, here, level):
        counts = [sum(w for _, y, w in here if y == c) for c in range(k)]
        best = None
        if level < depth and sum(c > 0 for c in counts) > 1:
            for f in sorted(range(p), key=lambda f: (md5(seed, t, node, f), f))[:tries]:
                for cut in cuts[f]:
                    sides = [[sum(w for x, y, w in here if y == c and (x[f] > cut) == s) for c in range(k)] for s in (False, True)]
                    if all(map(sum, sides)):
                        found = (-sum(sum(float(c) * c for c in s) / sum(s) for s in sides), f, cut)
                        best = min(best or found, found)
        out[t, node] = (counts, best and best[1], best and best[2])
        if best:
            for s in (0, 1):
                grow(t, 2 * node + s, [r for r in here if (r[0][best[1]] > best[2]) == bool(s)], level + 1)
    for t in range(trees):
        bag = [(x, y, times(i, t, seed)) for i, x, y in rows]
        if any(w for _, _, w in bag):
            grow(t, 1, [r for r in bag if r[2]], 0)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_plain_forest(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    xs = [(float(rnd.randrange(40)), rnd.choice([0.5, 0.5, 2.0, float(rnd.randrange(6))]), rnd.random()) for _ in range(300)]
    rows = [(str(i), x, int(x[0] > 15) + int(x[1] > 2 and rnd.random() < 0.8)) for i, x in enumerate(xs)]
    df = spark.createDataFrame([(int(i), *x, f"c{y}") for i, x, y in rows], "id int, a double, b double, c double, label string")
    expected = plain(rows, 3, 5, 3, 8, 2, seed)
    for parts, cells in ((1, 1_000_000), (6, 40)):  # with few cells held, partial counts are handed on again and again
        monkeypatch.setattr(bagged, "CELLS", cells)
        m = bagged_forest(df.repartition(parts), "id", "label", ["a", "b", "c"], trees=5, depth=3, bins=8, tries=2, seed=seed)
        got = {(t, i): (c, f, None if f is None else m.cuts[f][b]) for t, i, _, _, c, f, b in m.nodes}
        assert got == expected
    p = {r.id: r for r in m.predict(df).collect()}
    assert len(p) == 300
    for i, x, _ in rows:
        share = [0.0] * 3
        for t in range(5):
            node = 1
            while expected[t, node][1] is not None:
                node = 2 * node + int(x[expected[t, node][1]] > expected[t, node][2])
            c = expected[t, node][0]
            share = [s + 100 * v / sum(c) / 5 for s, v in zip(share, c)]
        r = p[int(i)]
        assert all(abs(r.probabilities[f"c{c}"] - s) < 1e-6 for c, s in enumerate(share))
        assert r.confidence == max(r.probabilities.values()) == r.probabilities[r.prediction]
    imp = m.importances.collect()
    assert abs(sum(r.importance for r in imp) - 1) < 1e-9 and [r["rank"] for r in imp] == [1, 2, 3]


def test_learns_and_does_not_depend_on_the_layout(spark):
    df = spark.range(4000).selectExpr("id", "sin(id) as a", "cos(id * 3) as b", "sin(id * 11) as noise",
                                      "if(sin(id) > 0.2 and cos(id * 3) < 0.4, 'yes', 'no') as label")
    held = df.where("id % 4 = 0")
    m = bagged_forest(df.where("id % 4 <> 0"), "id", "label", ["a", "b", "noise"], trees=20, depth=6)
    right = m.predict(held).join(held, "id").where("prediction = label").count()
    assert right > 0.95 * held.count() and m.importances.first().feature != "noise"
    other = bagged_forest(df.where("id % 4 <> 0").repartition(7), "id", "label", ["a", "b", "noise"], trees=20, depth=6)
    assert sorted(map(str, m.nodes)) == sorted(map(str, other.nodes))


def test_odd_tables(spark):
    schema = "id int, a double, b double, label string"
    odd = spark.createDataFrame([(1, None, 1.0, "x"), (None, float("nan"), 1.0, "x"), (None, 1.0, 1.0, "y"), (3, 2.0, 1.0, None), (3, 5.0, 1.0, "y"), (3, 5.0, 1.0, "y")], schema)
    m = bagged_forest(odd, "id", "label", ["a", "b"], trees=40, depth=2, tries=2)
    p = m.predict(odd).collect()
    assert len(p) == 6 and all(abs(sum(r.probabilities.values()) - 100) < 1e-6 for r in p)
    assert {r.prediction for r in p if r.id == 1} == {"x"} and {r.prediction for r in p if r.id == 3} == {"y"}
    one = bagged_forest(odd.where("label = 'y'"), "id", "label", ["a", "b"], trees=3)
    assert all(n[5] is None for n in one.nodes) and all(r.importance == 0 for r in one.importances.collect())
    for bad in (dict(depth=15), dict(bins=1), dict(trees=0)):
        with pytest.raises(ValueError):
            bagged_forest(odd, "id", "label", ["a"], **bad)
    with pytest.raises(ValueError):
        bagged_forest(odd.where("false"), "id", "label", ["a"])
