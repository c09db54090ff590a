"""Exact tree against a plain search over all thresholds."""

import random

import pytest

from tabwise.operators.cart import cart


def plain(rows, k, depth, min_leaf=1, node=1, level=0):
    """{node: (n, counts, f, threshold)} of rows (x, y)."""
    counts = [sum(y == c for _, y in rows) for c in range(k)]
    best = None
    if level < depth and sum(c > 0 for c in counts) > 1:
        for f in range(len(rows[0][0])):
            values = sorted({x[f] for x, _ in rows})
            for a, b in zip(values, values[1:]):
                t = (a + b) / 2
                sides = [[sum(y == c and (x[f] > t) == s for x, y in rows) for c in range(k)] for s in (False, True)]
                if min(map(sum, sides)) >= min_leaf:
                    score = sum(sum(float(c) * c for c in s) / sum(s) for s in sides)
                    if best is None or (-score, f, t) < best:
                        best = (-score, f, t)
    out = {node: (len(rows), counts, best and best[1], best and best[2])}
    if best:
        for s in (0, 1):
            out |= plain([r for r in rows if (r[0][best[1]] > best[2]) == bool(s)], k, depth, min_leaf, 2 * node + s, level + 1)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_plain_search(spark, seed):
    rnd = random.Random(seed)
    rows = [((float(rnd.randrange(300)), rnd.choice([0.5, 1.5, float(rnd.randrange(9))])), 0) for _ in range(400)]
    rows = [(x, int(x[0] > 120) + int(x[1] > 3 and rnd.random() < 0.8)) for x, _ in rows]
    df = spark.createDataFrame([(i, *x, f"c{y}") for i, (x, y) in enumerate(rows)], "id int, a double, b double, label string")
    model = cart(df.repartition(3), "id", "label", ["a", "b"], depth=4, min_leaf=1 + 4 * seed)
    got = {r.node: (r.n, r.counts, r.f, r.threshold) for r in model.nodes.collect()}
    assert got == plain(rows, 3, 4, 1 + 4 * seed)
    p = {r.id: r for r in model.predict(df).collect()}
    leaf = {r.id: r.node for r in model.leaves_of(df).collect()}
    assert len(p) == len(rows)
    for i, _ in enumerate(rows):
        n, counts, f, _ = got[leaf[i]]
        assert f is None and p[i].prediction == f"c{counts.index(max(counts))}" and abs(p[i].confidence - 100 * max(counts) / n) < 1e-9
    assert abs(sum(r.importance for r in model.importances.collect()) - 1) < 1e-9


def test_xor_nulls_and_small_tables(spark):
    rows = [(i, float(i % 2), float(i // 2 % 2), "yes" if i % 2 != i // 2 % 2 else "no") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, a double, b double, label string")
    m = cart(df, "id", "label", ["a", "b"], depth=5)
    assert tuple(m.shape.first()) == (2, 4) and m.predict(df).join(df, "id").where("prediction <> label").count() == 0
    odd = spark.createDataFrame([(1, None, "x"), (2, float("nan"), "x"), (3, 1.0, "y"), (4, 2.0, None)], "id int, a double, label string")
    m = cart(odd, "id", "label", ["a"])
    assert {r.id: r.prediction for r in m.predict(odd).collect()} == {1: "x", 2: "x", 3: "y", 4: "y"}
    one = cart(odd.where("label = 'x'"), "id", "label", ["a"])
    assert tuple(one.shape.first()) == (0, 1)
    assert cart(odd.where("false"), "id", "label", ["a"]).nodes.count() == 0
    with pytest.raises(ValueError):
        cart(odd, "id", "label", ["a"], depth=21)
