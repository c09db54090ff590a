"""Suffix dedup against a dictionary of all 50-byte strings, and the column-wise order against sorting."""

import hashlib
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwise.llm import suffix_dedup as S

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def expected(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            if d is not None:
                first[b[i:i + 50]] = min(d, first.get(b[i:i + 50], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49):
            if d is not None and first[b[i:i + 50]] < d:
                gone[i:i + 50] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), int((gone[1:] > gone[:-1]).sum() + gone[0]) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df, **options):
    return sorted(map(tuple, S.remove_repeats(df, **options).select(COLUMNS).collect()), key=str)


def texts(seed, n=60):
    """Texts with shared passages of 40 to 200 bytes, near copies, long equal runs and odd characters."""
    rnd = random.Random(seed)
    word = ["alpha", "bet", "Gämma", "de", "lta…", "x", "the", "of", "😀z"]
    passages = [" ".join(rnd.choice(word) for _ in range(rnd.randrange(7, 40))) for _ in range(6)] + ["a" * 120, "ab" * 90]
    out = []
    for _ in range(n):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else " ".join(rnd.choice(word) for _ in range(rnd.randrange(1, 30))) for _ in range(rnd.randrange(1, 6))]
        out.append(rnd.choice(["", " ", "\n"]).join(parts))
    return out + [out[0], out[1] + "!", out[2][3:], "a" * 300, "a" * 49, "a" * 50, ""]


@pytest.mark.parametrize("seed", range(4))
def test_column_wise_order_equals_sorting(seed):
    rnd = random.Random(seed)
    pieces = [bytes(rnd.choice(b"ab\x00\xff" if seed % 2 else bytes(range(256))) for _ in range(rnd.randrange(0, 70))) for _ in range(40)]
    pieces += pieces[:5] + [b"ab" * 30, b"ba" * 31, b""]
    bwt, lcp, m = S.collection_order(pieces)
    present = sorted(set(b"".join(pieces)))
    rank = {c: k + 1 for k, c in enumerate(present)}
    suffixes = sorted(([(rank[c], 0) for c in t[i:]] + [(0, k)], k, i) for k, t in enumerate(pieces) for i in range(len(t) + 1))
    assert bwt.tolist() == [rank[pieces[k][i - 1]] if i else 0 for _, k, i in suffixes] and m == len(pieces)
    want = [0]
    for (a, _, _), (b, _, _) in zip(suffixes, suffixes[1:]):
        want.append(next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))))
    assert lcp.tolist() == [min(w, 50) for w in want]


def test_least_owner_of_every_window():
    rnd = random.Random(5)
    base = bytes(rnd.choice(b"ab ") for _ in range(400))
    pieces = [base[i:i + rnd.randrange(50, 114)] for i in (rnd.randrange(0, 280) for _ in range(60))]
    owners = np.array([rnd.randrange(-5, 50) for _ in pieces])
    first = {}
    for t, o in zip(pieces, owners.tolist()):
        for i in range(len(t) - 49):
            first[t[i:i + 50]] = min(o, first.get(t[i:i + 50], o))
    which, window, least = S.least_owners(pieces, owners)
    assert list(zip(which.tolist(), window.tolist(), least.tolist())) == [(k, i, first[t[i:i + 50]]) for k, t in enumerate(pieces) for i in range(len(t) - 49)]


@pytest.mark.parametrize("options", [{}, {"bitmap_rows": 0}, {"hot_docs": 3}, {"hot_docs": 1, "bitmap_rows": 0}])
def test_equals_a_dictionary_of_all_strings(spark, options):
    """By bitmap and by join, with whole bins and with frequent or all shared seeds as hot ones."""
    rows = [(k * 7 % 67 - 3, t) for k, t in enumerate(texts(1))]
    rows += [(None, rows[3][1]), (None, None), (5, rows[9][1]), (5, rows[9][1]), (900, None), (901, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("same", F.lit("x"))
    assert got(df, **options) == expected(rows)


def test_a_table_with_itself_and_none(spark):
    rows = [(k, t) for k, t in enumerate(texts(2, 20))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df.union(df)) == expected(rows + rows)
    assert got(df.limit(0)) == []


def test_a_common_passage_and_copies(spark):
    """A third of the rows are one text, a third share a passage in different surroundings."""
    rnd = random.Random(8)
    passage = " ".join(str(rnd.randrange(10**6)) for _ in range(30))
    rows = [(k, " ".join(str(rnd.randrange(10**7)) for _ in range(20)) + passage + str(rnd.random())) for k in range(100)]
    rows += [(200 + k, "one text that stands here many times over, " * 3) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df) == expected(rows)
    assert S.remove_repeats(df).where("doc_id = 250").first().kept == b""


def test_the_table_of_the_driver(spark):
    from tabwise.llm.queries import QUERIES
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    df = QUERIES["op12_suffixes"](spark, "/root/testdata/sf0.001").select(COLUMNS)
    want = expected(rows)
    assert sorted(map(tuple, df.collect()), key=str) == want and any(r[2] for r in want)


def shuffled(spark):
    """Bytes of shuffle files in the session's own folders."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.stat().st_size for d in folders for f in Path(d).rglob("shuffle_*.data"))


def test_seeds_beyond_the_bitmap_come_in_rounds(spark, monkeypatch):
    """beyond the bitmap no stretch goes through a join as a row of its own, and nearly all pieces shared means several rounds."""
    rnd = random.Random(11)
    rows = [(k, " ".join(str(rnd.randrange(10**6)) for _ in range(300))) for k in range(40)]
    rows += [(100 + k, t if k % 4 else t[:500] + "x" + t[500:]) for k, t in rows] + [(7, rows[3][1][40:]), (None, rows[5][1]), (8, rows[9][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6, "doc_id")
    written, cut = [], S.cut_lineage

    def cut_lineage(frame):
        written.append(cut(frame))
        return written[-1]

    monkeypatch.setattr(S, "cut_lineage", cut_lineage)
    before = spark.conf.get("spark.sql.parquet.compression.codec"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    held = shuffled(spark)
    result = S.remove_repeats(df, bitmap_rows=0)
    text = sum(len(t) for _, t in rows)
    assert shuffled(spark) - held < text / 10  # the pieces alone were over the text
    assert sorted(map(tuple, result.select(COLUMNS).collect()), key=str) == expected(rows)
    names = [frame.columns for frame in written]
    assert ["run", "n", "packed"] in names and names.count(["doc_id", "same", "span"]) > 1
    assert (spark.conf.get("spark.sql.parquet.compression.codec"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_shares_are_dealt_evenly(spark):
    """One key for each partition, and turned seeds, whose high bits are even, are the seeds again when turned twice."""
    for tasks in (1, 3, 86):
        keys = S._one_for_each(spark, tasks).tolist()
        sizes = spark.createDataFrame([(k,) for k in keys], "bucket int").repartition(tasks, "bucket").rdd.glom().map(len).collect()
        assert sizes == [1] * tasks
    rnd = np.random.default_rng(3)
    data = rnd.integers(97, 123, 200_000).astype(np.uint8)
    _, _, seed, _ = S.seeded_windows(data, np.array([len(data)]))
    turned = S._turned(seed)
    assert (S._turned(turned) == seed).all() and (S._turned(turned.view(np.int64)).view(np.uint64) == seed).all() and int(turned.max()) < 1 << 48
    counts = np.bincount((turned >> np.uint64(44)).astype(np.int64), minlength=16)
    assert counts.max() < 1.3 * counts.mean()
