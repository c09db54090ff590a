"""Benchmark decontamination by spaced-seed hashing.

A mask selects five of up to ``WINDOW`` neighbouring token positions; the other positions may differ. Each
mask's selected words are hashed at every position of every document and every benchmark text, equal hashes are
joined, and around each hit the two texts are aligned word by word: an aligned window of ``WINDOW`` words with at
least ``AGREE`` equal words is an overlap, so substitutions are tolerated wherever they fall.

Scale: the documents are hashed in one map-only pass; positions are first looked up in a bitmap of the benchmark's
hashes (a fixed ``BITS``-bit array, built by a distributed aggregate, so what is broadcast never grows), and only
the neighbourhood of possible hits is kept. Those small regions, not the texts, go through the join with the
benchmark, which is a shuffle join at any size of the benchmark. Equal benchmark texts are compared once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import picked_hashes, position_constants, word_hashes, word_list

WINDOW, AGREE, BITS = 13, 10, 26
# fixed values: selected positions of the masks. In every window of 13 with up to 3 differing words at least one
# mask fits between them (checked over all patterns in the tests), so no such window is missed.
MASKS = ((0, 1, 2, 4, 5), (0, 2, 9, 10, 11), (0, 1, 2, 3, 5))


def seed_hashes(wh: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(mask number, hashes by start position)."""
    return [(m, picked_hashes(wh, np.array(o), position_constants(len(o), 1000 + m))) for m, o in enumerate(MASKS)]


def overlaps(doc: np.ndarray, item: np.ndarray, diagonal: int, window: int = WINDOW, agree: int = AGREE) -> list[tuple[int, int]]:
    """Spans (first word, end) of ``doc`` that aligned windows of ``item`` cover, item position = doc position -
    diagonal; differing words at a span's borders are left off."""
    lo, hi = max(0, diagonal), min(len(doc), len(item) + diagonal)
    if hi - lo < window:
        return []
    same = doc[lo:hi] == item[lo - diagonal:hi - diagonal]
    total = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(total[window:] - total[:-window] >= agree)
    covered = np.zeros(hi - lo + 1, np.int64)
    np.add.at(covered, good, 1)
    np.add.at(covered, good + window, -1)
    inside = np.cumsum(covered)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    out = []
    for a, b in zip(edge[::2], edge[1::2]):
        m = np.flatnonzero(same[a:b]) + a
        out.append((int(m[0]) + lo, int(m[-1]) + 1 + lo))
    return out


def _seeds(batches):
    schema = pa.schema([("item_id", pa.int64()), ("words", pa.list_(pa.int64())), ("seed", pa.list_(pa.int64()))])
    for batch in batches:
        words, seeds = [], []
        for t in batch.column("text"):
            wh = word_hashes(word_list(t.as_py()))
            words.append(wh.view(np.int64))
            seeds.append(np.unique(np.concatenate([h for _, h in seed_hashes(wh)])).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(words, pa.list_(pa.int64())),
                                          pa.array(seeds, pa.list_(pa.int64()))], schema=schema)


def seed_bitmap(seeds: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bitmap of the seeds' low ``bits`` bits; at most 2^bits / 64 words reach the driver."""
    slot = F.col("seed").bitwiseAND(F.lit((1 << bits) - 1))
    words = (seeds.groupBy(F.shiftright(slot, 6).alias("at"))
             .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(seed & 63 as int))")).alias("word"))).toPandas()
    out = np.zeros((1 << bits) // 64, np.uint64)
    out[words["at"].to_numpy(np.int64)] = words["word"].to_numpy(np.int64).view(np.uint64)
    return out


REGION = "doc_id long, start int, words array<long>, seed array<long>, at array<int>"


def _regions(shared, bits: int, window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("words", pa.list_(pa.int64())),
                        ("seed", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))])

    def run(batches):
        bitmap, low, six = shared.value, np.uint64((1 << bits) - 1), np.uint64(6)
        one, last = np.uint64(1), np.uint64(63)
        for batch in batches:
            rows = [[], [], [], [], []]
            for doc, t in zip(batch.column("doc_id"), batch.column("text")):
                wh = word_hashes(word_list(t.as_py()))
                if len(wh) < window:
                    continue
                at, seed = [], []
                for _, h in seed_hashes(wh):
                    hit = np.flatnonzero((bitmap[(h & low) >> six] >> (h & last)) & one)
                    at.append(hit)
                    seed.append(h[hit])
                at, seed = np.concatenate(at), np.concatenate(seed)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, seed = at[order], seed[order]
                # hits whose neighbourhoods touch form one region
                cut = np.flatnonzero(np.diff(at) > 2 * window) + 1
                for a, s in zip(np.split(at, cut), np.split(seed, cut)):
                    lo, hi = max(0, int(a[0]) - window), min(len(wh), int(a[-1]) + 2 * window)
                    for col, v in zip(rows, (doc.as_py(), lo, wh[lo:hi].view(np.int64), s.view(np.int64), (a - lo).astype(np.int32))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)
    return run


def _verify(window: int, agree: int):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("span_start", pa.int32()), ("span_end", pa.int32())])

    def run(batches):
        for batch in batches:
            rows = [[], [], [], []]
            for r in batch.to_pylist():
                doc, item = np.array(r["words"], np.int64), np.array(r["item_words"], np.int64)
                seeds = item_seeds(item)
                pairs = {int(p) - q for s, p in zip(r["seed"], r["at"]) for q in seeds.get(s, ())}
                for d in pairs:
                    for a, b in overlaps(doc, item, d, window, agree):
                        for col, v in zip(rows, (r["doc_id"], r["item_id"], a + r["start"], b + r["start"])):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)
    return run


def item_seeds(item: np.ndarray) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for _, h in seed_hashes(item.view(np.uint64)):
        for q, s in enumerate(h.view(np.int64).tolist()):
            out.setdefault(s, []).append(q)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, agree: int = AGREE,
                  bits: int = BITS) -> DataFrame:
    """Verified overlaps: doc_id, item_id, span_start, span_end (word positions, end exclusive), distinct.

    docs (doc_id, text, …), benchmark (item_id, text, …). Words are lower-cased (A-Z) runs without white space.
    item_id is the least id of the benchmark rows with that text. Texts of fewer than ``window`` words, null and
    empty ones give nothing; rows without an id are left out; repeated rows give their spans once; extra
    columns are ignored; if either table is empty there are no rows."""
    items = (benchmark.where("item_id is not null and text is not null").groupBy("text")
             .agg(F.min(F.col("item_id").cast("long")).alias("item_id")).select("item_id", "text"))
    items = cut_lineage(items.mapInArrow(_seeds, "item_id long, words array<long>, seed array<long>")
                        .where(F.size("words") >= window))
    seeds = items.select("item_id", F.explode("seed").alias("seed"))
    shared = docs.sparkSession.sparkContext.broadcast(seed_bitmap(seeds, bits))
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    regions = cut_lineage(texts.mapInArrow(_regions(shared, bits, window), REGION).withColumn("region", F.monotonically_increasing_id()))
    pairs = (regions.select("region", F.explode("seed").alias("seed")).distinct().join(seeds, "seed")
             .select("region", "item_id").distinct())
    rows = (pairs.join(regions, "region").join(items.select("item_id", F.col("words").alias("item_words")), "item_id")
            .select("doc_id", "item_id", "start", "words", "seed", "at", "item_words"))
    return rows.mapInArrow(_verify(window, agree), "doc_id long, item_id long, span_start int, span_end int").distinct()


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, **args) -> DataFrame:
    """One row per document with an overlap: doc_id, n_items, n_spans (distinct spans), longest (words of the
    longest), item_ids (ascending)."""
    spans = contamination(docs, benchmark, **args).withColumn("n", F.col("span_end") - F.col("span_start"))
    return spans.groupBy("doc_id").agg(
        F.countDistinct("item_id").alias("n_items"), F.countDistinct("span_start", "span_end").alias("n_spans"),
        F.max("n").cast("long").alias("longest"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **args) -> DataFrame:
    """The documents without an overlap, all columns kept (rows without a doc_id stay)."""
    found = contaminated_documents(docs, benchmark, **args).select("doc_id")
    return docs.join(found, "doc_id", "left_anti")
