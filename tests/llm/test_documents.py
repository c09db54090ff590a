"""Near-duplicates, decontamination, BPE, token files, licences, quality: against brute force and edge rows."""

import itertools
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tabwise.llm import bpe, decontam, license_scan, minhash, quality, token_files  # noqa: E402
from tabwise.llm.common import Generations  # noqa: E402
from tabwise.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
# clashing names: the operators' own columns, null in places
SCHEMA = "doc_id long, text string, bands string, comp long, part int, seed string, class_id long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", d, None, None, 1) for d, t in rows], SCHEMA)


def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near_rows():
    """Groups of edited copies around the threshold, a shared passage, copies, short and empty texts."""
    rng, rows = random.Random(5), []
    base, passage = prose(rng, 80), prose(rng, 40)
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = "edit" + str(rng.random())
        rows.append((100 + i, " ".join(w)))
    rows += [(300 + i, " ".join(passage + prose(rng, 30))) for i in range(40)]
    rows += [(400 + i, "One two  three\tFOUR" if i % 2 else "one two three four") for i in range(6)]
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "a"), (504, "A"), (505, "ä"), (506, "Ä"), (507, "x " * 20_000)]
    return rows


def test_near_duplicates_match_brute_force(spark):
    rows = near_rows()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, rows + [(None, "lost")])).collect()}
    assert got == brute.near_duplicates(dict(rows))
    out = minhash.near_duplicates(frame(spark, [(1, "b c"), (1, "a b"), (2, "a b")])).collect()  # a repeated id
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out) == [(1, 1, True), (2, 1, False)]
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_exact_join_finds_what_stars_miss(spark):
    """With no star round at all, the prefix join alone gives every link."""
    rows = near_rows()
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), stars=0).collect()}
    assert got == {d: c for d, (_, c) in brute.near_duplicates(dict(rows)).items()}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)
    a, b = np.sort(h[:200]), np.sort(h[50:250])
    same = np.mean([minhash.signature(a, 4000) == minhash.signature(b, 4000)])
    assert abs(same - 150 / 250) < 0.05
    assert (minhash.signature(np.sort(h[:3]), 64) != 0).all()  # empty bins are filled


def test_masks_miss_no_window():
    fits = [{o + x for x in m} for m in decontam.MASKS for o in range(decontam.WINDOW - m[-1])]
    for bad in itertools.combinations(range(decontam.WINDOW), decontam.WINDOW - decontam.AGREE):
        assert any(not f & set(bad) for f in fits)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(3)
    items = {i: " ".join(prose(rng, rng.randrange(10, 50))) for i in range(12)}
    items[12] = items[3]  # the same text again
    docs = {0: None, 1: "", 2: "short text"}
    for d in range(3, 60):
        w = prose(rng, rng.randrange(20, 90))
        if d % 3 == 0:
            v = items[d % 13].split()
            for _ in range(rng.randrange(0, 7)):
                v[rng.randrange(len(v))] = "other"
            at = rng.randrange(len(w))
            w[at:at] = v
        docs[d] = " ".join(w).upper() if d % 5 == 0 else " ".join(w)
    bench = spark.createDataFrame([*items.items(), (None, "no id"), (99, None), (98, "")], "item_id long, text string")
    every = frame(spark, [*docs.items(), (3, docs[3]), (None, items[1])])
    got = {r.doc_id: set(r.item_ids) for r in decontam.contaminated_documents(every, bench).collect()}
    want = brute.contaminated(docs, items)
    assert got == want and len(want) > 8
    kept = decontam.decontaminate(every, bench)
    assert {r.doc_id for r in kept.collect()} == set(docs) - set(want) | {None} and kept.columns == every.columns
    assert decontam.contaminated_documents(every, bench.where("false")).count() == 0
    assert decontam.contaminated_documents(every.where("false"), bench).count() == 0


def test_decontamination_query_on_driver_tables(spark):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {d: t for d, t in texts(spark).items() if len(t) < 4000}
    got = {r.doc_id: {int(i) for i in r.item_ids.split(",")} for r in QUERIES["op1_decontaminate"](spark, SF).collect()}
    assert {d: s for d, s in got.items() if d in docs} == brute.contaminated(docs, items)


ODD = ["", " ", "a", "It's  we'll\n\n  x", "\x00\x1c\x85 　", "日本語 🙂👍🏽 é", "x" * 5000, "1234567 ²½ ١٢", "<unk> <s> <|endoftext|>", " \t \r\n" * 30]


def test_bpe_equals_the_library_and_round_trips(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = [*enumerate(ODD), (50, None), (51, "again"), (51, "again"), (None, "no id"), *texts(spark).items()]
    rows = bpe.encode(frame(spark, docs), path, public_tokenizers.PATTERN, decode=True).collect()
    assert len(rows) == len(docs)
    want = sorted((d if d is not None else -1, library.encode_ordinary(t or ""), (t or "").encode()) for d, t in docs)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids, bytes(r.decoded)) for r in rows) == want
    ids = spark.createDataFrame([(1, library.encode_ordinary(ODD[5])), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode(ids, path).collect()} == {1: ODD[5].encode(), 2: b"", 3: b""}
    assert bpe.encode(frame(spark, []), path, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.serialise({b"a": 0, b"b": 2})


def test_wavelet_matrix_operations():
    rng = np.random.default_rng(4)
    for n, top in ((0, 4), (1, 1), (700, 3), (3000, 40_000)):
        a = rng.integers(0, top, n).astype(np.uint32)
        ids = [None, 7] if n else []
        counts = np.array([n - n // 3, n // 3])[:len(ids)]
        head, back, c, wm = token_files.unpack(token_files.pack(ids, counts, a, 3, 5))
        assert (wm.decode() == a).all() and back == ids and c.tolist() == counts.tolist() and head["part"] == 3
        for i in rng.integers(0, n, 20) if n else []:
            assert wm.access(int(i)) == a[i]
        for s in set(a[:5].tolist()) | {top + 1}:
            at = np.flatnonzero(a == s)
            assert wm.count(s) == len(at) and wm.count(s, n // 4, n // 2) == ((at >= n // 4) & (at < n // 2)).sum()
            assert [wm.select(s, k) for k in range(min(3, len(at)))] == at[:3].tolist() and wm.select(s, len(at)) == -1


def test_token_files_equal_the_library(spark, tmp_path):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    special = ["<|endoftext|>", "a<|endoftext|>b c", "<|startoftext|> x <|ENDOFTEXT|>", "<|endoftext", "é <|endoftext|><|endoftext|>"]
    docs = [*((200 + i, t) for i, t in enumerate(special)), *((i, t) for i, t in enumerate(ODD)), (50, None), (51, "b"), (51, "a"), (None, "no id"), *((d + 100, t) for d, t in texts(spark).items())]
    rows = token_files.corpus_tokens(frame(spark, docs), path, 2, folder=str(tmp_path / "t"), shard_rows=30, file_tokens=9_000).collect()
    start, want = 0, []
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in rows), key=lambda r: r[1]) == want
    names = sorted(p.name for p in (tmp_path / "t").iterdir() if not p.name.endswith(".crc"))
    assert len(names) > 5 and all(n.endswith(".wm") for n in names)
    assert token_files.corpus_tokens(frame(spark, []), path, 2, folder=str(tmp_path / "none")).count() == 0


def test_generations_keep_what_is_used():
    cache, learnt = Generations(3), []

    def learn(keys):
        learnt.extend(keys)
        return {k: k for k in keys}
    for step in range(6):
        assert cache.fill({"often", step}, learn)["often"] == "often"
    assert learnt.count("often") == 1


def test_license_scan(spark):
    assert license_scan.align([1, 2, 3, 9, 5], [1, 2, 3, 4, 5], 0) == (4, 0, 5)
    assert license_scan.align([0, 0, 1, 2, 7, 3, 4], [1, 2, 3, 4], 2) == (4, 2, 7)
    rows = [(1, "Ünd text. This work is LICENSED under the GNU General Public License, version 3. End."), (2, None), (3, ""),
            (4, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."), (5, "licensed under the sea, a song"),
            (6, "permission is hereby granted free of charge to any person having a copy of this software and associated documentation files the "
                "software to deal in the software without any restriction including without limitation the rights to use copy modify merge publish "
                "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
            (4, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."), (None, "Released under the MIT License.")]
    got = {r.doc_id: r for r in license_scan.licensed_documents(frame(spark, rows)).collect()}
    assert {d: r.licenses for d, r in got.items()} == {1: "GPL-3.0", 4: "CC-BY-NC-4.0,MIT", 6: "MIT"}
    assert got[4].spans == "CC-BY-NC-4.0:0:27:100,MIT:29:59:100" and got[1].spans == "GPL-3.0:10:79:100"
    assert license_scan.licensed_documents(frame(spark, [])).count() == 0


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scored = QUERIES["op10_quality"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9
    assert sum(r.predicted for r in rows if r.quality) / sum(1 for r in rows if r.quality) > 0.95
    assert scored.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_quality_edges(spark):
    docs = frame(spark, [(i, f"plain words in a row, number {i}, more of the same") for i in range(20)] + [(90, None), (91, ""), (91, ""), (None, "x")])
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(20)] + [(None, 1, 0), (5, None, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == 24 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (90, 91)} == {next(r.score for r in rows if r.doc_id == 90)}
    model = quality.fit(docs, labels)
    assert model.keep(docs, 0.0).count() == 24 and model.keep(docs, 0.0).columns == docs.columns
    assert quality.score_quality(docs.where("false"), labels).count() == 0
    assert quality.score_quality(docs, labels.where("false")).count() == 24
