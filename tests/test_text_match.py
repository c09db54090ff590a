"""Pruned text matching against all pairs."""

import math
import random
import re
from collections import Counter

import pytest

from tabwise.operators import advise, text_scores

SF = "/root/testdata/sf0.001"


def every_pair(left, right, n):
    sim = advise.tfidf_similarity(left, "id", "text", right, "id", "text").collect()
    by = {}
    for r in sim:
        by.setdefault(r.l, []).append((-int(r.cosine * 1e9 + 0.5), r.r, r.cosine))
    return {(l, r): (round(c, 9), k) for l, rows in by.items() for k, (_, r, c) in enumerate(sorted(rows)[:n], 1)}


def pruned(left, right, n):
    return {(r.l, r.r): (round(r.cosine, 9), r["rank"]) for r in advise.top_matches(left, "id", "text", right, "id", "text", n).collect()}


@pytest.mark.parametrize("n", [1, 3, 50])
def test_same_matches_as_all_pairs(spark, n):
    rnd = random.Random(n)
    words = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(3000)]
    text = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 25)))
    right = [(k, text()) for k in range(60)] + [(100, None), (101, "only here")]
    left = [(k, text()) for k in range(80)] + [(200, right[5][1]), (201, None), (202, "nothing in common"), (203, right[5][1] + " " + right[6][1])]
    left, right = (spark.createDataFrame(r, "id long, text string") for r in (left, right + [(102, right[7][1])]))
    got, want = pruned(left, right, n), every_pair(left, right, n)
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 2e-9 and got[k][1] == want[k][1] for k in want)


def test_empty_sides(spark):
    some = spark.createDataFrame([(1, "a b")], "id long, text string")
    assert pruned(some, some.where("false"), 3) == {} and pruned(some.where("false"), some, 3) == {}


def test_few_pairs_are_completed(spark):
    """Left texts that hold words of one right text each, and common words: most pairs share only common words."""
    rnd = random.Random(2)
    right = [(k, " ".join(f"r{k}x{i}" for i in range(12)) + " the of and") for k in range(200)]
    left = [(k, " ".join(f"r{k % 200}x{rnd.randrange(12)}" for _ in range(9)) + " the of and the") for k in range(100)]
    left, right = (spark.createDataFrame(r, "id long, text string") for r in (left, right))
    lw, rw = advise.tfidf_weights(left, "id", "text", right, "id", "text")
    bounds = advise.match_bounds(lw, rw, 1)
    pairs = advise.candidate_pairs(bounds, rw).count()
    assert pairs < 200 < lw.join(rw, "t").select("l", "r").distinct().count() == 20_000
    assert pruned(left, right, 1) == every_pair(left, right, 1)


def plainly(left, right, n):
    """The matches in plain Python: token counts of a key's texts together, null keys out."""
    def counts(rows):
        out = {}
        for k, t in rows:
            out.setdefault(k, Counter()).update(re.findall("[a-z0-9]+", re.sub("[^A-Za-z0-9]", " ", t or "").lower()))
        return out

    by, size = counts(right), len({k for k, _ in right})
    df = Counter(t for c in by.values() for t in c)
    idf = lambda t: math.log((1 + size) / (1 + df[t])) + 1
    unit = lambda c: {t: f * idf(t) / math.sqrt(sum((g * idf(u)) ** 2 for u, g in c.items())) for t, f in c.items()}
    vectors, out = {r: unit(c) for r, c in by.items() if r is not None}, {}
    for l, c in counts(left).items():
        if l is not None:
            v = unit(c)
            found = [(sum(x * w[t] for t, x in v.items() if t in w), r) for r, w in vectors.items()]
            best = sorted((-math.floor(s * 1e9 + 0.5), r, s) for s, r in found if s)
            out.update({(l, r): (s, k) for k, (_, r, s) in enumerate(best[:n], 1)})
    return out


def odd_sides():
    rnd = random.Random(5)
    words = [f"W{int(rnd.paretovariate(0.7))}" for _ in range(2000)]
    text = lambda: "é.".join(rnd.choice(words) for _ in range(rnd.randrange(0, 20)))
    right = [(k, text()) for k in range(30)] + [(None, "W1 nowhere"), (40, None), (41, "W1 W2 W2"), (42, "w2 w1 w2"), (43, "w1"), (43, "w3")]
    left = [(k, text()) for k in range(50)] + [(k, text()) for k in range(5)] + [(None, "w1 w2"), (None, "w3"), (60, "w1 nowhere"), (61, None), (62, "W2 w2\nw1")]
    return left, right


@pytest.mark.parametrize("broadcast, cells", [(0, 1 << 20), (16 << 20, 1)])
def test_repeated_and_null_keys(spark, monkeypatch, broadcast, cells):
    """Both ways, the scan against an index and the joins, give the plain matches, in blocks of one row too."""
    monkeypatch.setattr(advise, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(text_scores, "CELLS", cells)
    monkeypatch.setattr(text_scores, "TEXT_BYTES", cells)
    left, right = odd_sides()
    lf, rt = (spark.createDataFrame(r, "id long, text string") for r in (left, right))
    for n in (2, 100):
        got, want = {(r.l, r.r): (r.cosine, r["rank"]) for r in advise.top_matches(lf, "id", "text", rt, "id", "text", n).collect()}, plainly(left, right, n)
        assert got.keys() == want.keys()
        assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)
    every = {(r.l, r.r): r.cosine for r in advise.tfidf_similarity(lf, "id", "text", rt, "id", "text").collect()}
    assert every.keys() == want.keys() and all(abs(every[k] - want[k][0]) < 1e-9 for k in want)


def test_texts_stay_where_they_are(spark):
    """With a right side that can be broadcast no token of a left text is written or shuffled: the plan reads and scores."""
    left = spark.createDataFrame([(1, "a b"), (2, "b c")], "id long, text string").repartition(4)
    found = advise.top_matches(left.where("id > 0"), "id", "text", left, "id", "text", 1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and not any(x in plan for x in ("Join", "Aggregate", "Window"))
    assert sorted((r.l, r.r) for r in found.collect()) == [(1, 1), (2, 2)]
