"""Periodic runs against a plain search of all periods, and the wavelet tree against sorting."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwise.llm import periodic_runs as R

COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def brute(words):
    """Every maximal stretch of every period, the least period of each stretch."""
    found = {}
    w = np.unique(np.array(words, object), return_inverse=True)[1] if words else np.empty(0, int)
    for q in range(1, len(w) // 3 + 1):
        same = np.concatenate([[False], w[:-q] == w[q:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if e + q - s >= max(24, 3 * q):
                found.setdefault((s, e + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def planted(doc_id, text):
    words = text.encode().split() if text else []
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def expected(doc_id, words):
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return (doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def periodic_words(seed):
    """Texts of few words, of nested repeats, of powers of powers, and broken ones."""
    rnd = random.Random(seed)
    out = []
    for _ in range(rnd.randrange(1, 6)):
        kind = rnd.randrange(5)
        unit = [rnd.choice("ab" if kind < 3 else "abcdefghij") for _ in range(rnd.randrange(1, 40))]
        if kind == 0:
            unit = unit[:3] * rnd.randrange(3, 20) + unit[:2]
        if kind == 4:
            unit = (unit[:5] * rnd.randrange(5, 9) + ["x"]) + unit[:2]
        out += unit * rnd.randrange(1, 9)
        if rnd.random() < 0.5:
            out += [rnd.choice("abcxyz") for _ in range(rnd.randrange(0, 30))]
    if out and rnd.random() < 0.4:
        out[rnd.randrange(len(out))] = "!"
    return [w.encode() for w in out[:1500]]


@pytest.mark.parametrize("block", range(6))
def test_runs_of_odd_texts(block):
    texts = [periodic_words(100 * block + k) for k in range(100)]
    for words, runs in zip(texts, R.find_runs(texts)):
        assert runs == brute(words), words


def test_runs_of_all_short_binary_words():
    """Thue-Morse, Fibonacci and all-equal words, alone and repeated."""
    morse, fib = [0], [[0], [0, 1]]
    while len(morse) < 700:
        morse += [1 - x for x in morse]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    texts = [[b"%d" % x for x in t] for t in (morse, fib[-1], [0] * 3000, [0] * 23, [0] * 24, fib[8] * 7, morse[:32] * 9, [0, 0, 1] * 8, [*range(8)] * 3, [])]
    for words, runs in zip(texts, R.find_runs(texts)):
        assert runs == brute(words)


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    v = rng.permutation(500)
    tree = R.WaveletMatrix(v)
    low = rng.integers(0, 500, 300)
    high = np.array([rng.integers(x, 501) for x in low])
    x = rng.integers(0, 520, 300)
    for a, b, y, s, c in zip(low, high, x, tree.successor(low, high, x), tree.count_below(low, high, x)):
        part = np.sort(v[a:b])
        assert c == (part < y).sum() and s == (part[part >= y][0] if (part >= y).any() else -1)


def test_rows_of_every_sort(spark):
    texts = [None, "", " \t", "a " * 24, "a " * 23, "  x" * 30, " ".join(map(str, range(200))), "x y z\n" * 3000, "a b " * 11 + "é é"]
    rows = [*enumerate(texts), (None, "b " * 30), (3, "a " * 24)] + [(k, " ".join(w.decode() for w in periodic_words(k))) for k in range(100, 220)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("n", F.lit("x"))
    got = R.digest(R.periodic_runs(R.with_made_runs(df))).select(COLUMNS).collect()
    def order(r):
        return (r[0] is not None, r[0] or 0, r[-1])
    assert sorted(map(tuple, got), key=order) == sorted((expected(d, planted(d, t)) for d, t in rows), key=order)
    texts = {r.doc_id: r.collapsed for r in R.periodic_runs(df.where("doc_id in (3, 7)"), texts=True).collect()}
    assert texts == {3: "a", 7: "x y z"}
    assert R.digest(R.periodic_runs(R.with_made_runs(df.limit(0)))).count() == 0


def test_the_table_of_the_driver(spark):
    from tabwise.llm.queries import QUERIES
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op13_runs"](spark, "/root/testdata/sf0.001").select(COLUMNS).collect()
    want = [expected(d, planted(d, t)) for d, t in rows]
    assert sorted(map(tuple, got)) == sorted(want) and any(r[1] for r in want)
