"""Licence scan: winnowed template fingerprints pick candidates, banded alignment reports coverage and spans.

Templates and texts are words of letters and digits, lower-cased (A-Z). A template's three-word hashes are winnowed
(the least of every ``WINNOW`` neighbours) and form the inverted index. Every three-word hash of a document is looked
up, so a template that shares one selected fingerprint is found. Hits in the same order in both are chained across
diagonals, up to as many words put in or left out as the template has; a banded local alignment of template and
document (substitutions, insertions and omissions within ``BAND`` words of the chain's diagonals) gives the matched
words, and what a match leaves of the hits is chained again. Matches with enough coverage are reported; of
overlapping ones the best.

Scale: one map-only pass over the texts with a fixed-size bitmap of the index; only the neighbourhoods of hits go on
to a shuffle join with the index, whatever its size.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import picked_hashes, position_constants, word_hashes
from .decontam import seed_bitmap
from .license_templates import TEMPLATES

GRAM, WINNOW, BAND, BITS, COVERAGE, PAD = 3, 3, 6, 22, 0.8, 24
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_SPACES = bytes(b if bytes([b]).isalnum() or b >= 0x80 else 0x20 for b in range(256))
_OFFSETS, _CONSTANTS = np.arange(GRAM), position_constants(GRAM, 31)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().translate(_SPACES).split() if text else []


def grams(wh: np.ndarray) -> np.ndarray:
    return picked_hashes(wh, _OFFSETS, _CONSTANTS)


def winnowed(h: np.ndarray, window: int = WINNOW) -> np.ndarray:
    """Positions of the selected hashes: the last least one of every ``window`` neighbours."""
    if len(h) <= window:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))], np.int64) if len(h) else np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(np.arange(len(view)) + window - 1 - np.argmin(view[:, ::-1], axis=1))


def align(doc: list, item: list, diagonal: int, band: int = BAND) -> tuple[int, int, int] | None:
    """Best local alignment of item and doc with document position - item position within ``band`` of ``diagonal``:
    (matched words, first document word, end). A run of document words put in costs ``BAND`` at most."""
    width = 2 * band + 1
    before = [(0, 0, -1)] * (width + 1)  # score, matches, first document word
    best = (0, 0, -1, -1)
    for i, w in enumerate(item):
        now, left, far = [], (0, 0, -1), (0, 0, -1)  # far: in a long run of words put in
        for k in range(width):
            j = i + diagonal - band + k
            if j < 0 or j >= len(doc):
                left = (0, 0, -1)
                now.append(left)
                continue
            s, m, f = before[k]  # item word to document word
            if doc[j] == w:
                cell = (s + 2, m + 1, f if f >= 0 else j)
            else:
                cell = (s - 1, m, f)
            up = before[k + 1]  # an item word left out
            if up[0] - 1 > cell[0]:
                cell = (up[0] - 1, up[1], up[2])
            if left[0] - 1 > cell[0]:  # a document word put in
                cell = (left[0] - 1, left[1], left[2])
            if left[0] - BAND > far[0]:
                far = (left[0] - BAND, left[1], left[2])
            if far[0] > cell[0]:
                cell = far
            if cell[0] <= 0:
                cell = (0, 0, -1)
            if cell[0] > best[0]:
                best = (cell[0], cell[1], cell[2], j + 1)
            now.append(cell)
            left = cell
        before = [*now, (0, 0, -1)]
    return best[1:] if best[1] else None


def best_chain(hits: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Of hits (document position, item position) in ascending order the chain, ascending in both, that covers most
    words, less the words by which its diagonals differ (``BAND`` at most for each step, ``size`` for all)."""
    state: list[tuple[int, int, int, int]] = []  # score, least and greatest diagonal, hit before
    for j, (p, q) in enumerate(hits):
        d = p - q
        best = (2 * GRAM, d, d, -1)
        for i in range(j - 1, -1, -1):
            a, b = hits[i]
            score, lo, hi, _ = state[i]
            if a >= p or b >= q or max(hi, d) - min(lo, d) > size:
                continue
            score += 2 * min(GRAM, q - b, p - a) - min(abs(d - a + b), BAND)
            if score > best[0]:
                best = (score, min(lo, d), max(hi, d), i)
        state.append(best)
    at, chain = max(range(len(hits)), key=lambda j: (state[j][0], -j)), []
    while at >= 0:
        chain.append(hits[at])
        at = state[at][3]
    return chain[::-1]


def notices(doc: list, item: list, hits: list[tuple[int, int]], coverage: float, band: int) -> list[tuple[int, int, int]]:
    """All alignments (matched words, first document word, end) of item in doc that reach the coverage and do not
    overlap. Hits are taken from the left, as far as one notice can reach."""
    found, hits, least = [], sorted(hits), 0  # no notice begins before ``least``
    size = len(item)
    while hits:
        reach = hits[0][0] + 2 * size
        window = list(itertools.takewhile(lambda h: h[0] < reach, hits))
        chain = best_chain(window, size)
        diagonals = [p - q for p, q in chain]
        lo, hi = min(diagonals), max(diagonals)
        got = align(doc[least:], item, (lo + hi) // 2 - least, band + (hi - lo + 1) // 2)
        if got and got[0] >= coverage * size:
            a, b = got[1] + least, got[2] + least
            found.append((got[0], a, b))
            # what stands before the match may hold a further one, up to its first word
            early = [h for h in window if h[0] + GRAM <= a]
            if early:
                found += [(m, x + least, y + least) for m, x, y in notices(doc[least:a], item, [(p - least, q) for p, q in early], coverage, band)]
            hits, least = [h for h in hits if h[0] >= b], b
        elif chain[0] == hits[0]:
            gone = set(chain)
            hits = [h for h in hits if h not in gone]
        else:  # the window may have cut the chain: what stands before it by itself, then again from its first hit
            early = [h for h in window if h < chain[0]]
            more = notices(doc[least:], item, [(p - least, q) for p, q in early], coverage, band)
            found += [(m, x + least, y + least) for m, x, y in more]
            least += max((y for _, _, y in more), default=0)
            hits = [h for h in hits if h >= chain[0] and h[0] >= least]
    return found


def _index(batches):
    schema = pa.schema([("template", pa.int64()), ("license", pa.string()), ("words", pa.list_(pa.int64())), ("seed", pa.list_(pa.int64())),
                        ("at", pa.list_(pa.int32()))])
    for batch in batches:
        words, seeds, places = [], [], []
        for t in batch.column("text"):
            wh = word_hashes(words_of(t.as_py()))
            h = grams(wh)
            at = winnowed(h)
            words.append(wh.view(np.int64))
            seeds.append(h[at].view(np.int64))
            places.append(at.astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("template"), batch.column("license"), pa.array(words, pa.list_(pa.int64())),
                                          pa.array(seeds, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))], schema=schema)


REGION = "doc_id long, words array<long>, starts array<int>, ends array<int>, seed array<long>, at array<int>"


def _regions(shared, bits: int, pad: int):
    schema = pa.schema([("doc_id", pa.int64()), ("words", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())),
                        ("ends", pa.list_(pa.int32())), ("seed", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))])

    def run(batches):
        bitmap, low = shared.value, np.uint64((1 << bits) - 1)
        for batch in batches:
            rows = [[] for _ in schema]
            for doc, t in zip(batch.column("doc_id"), batch.column("text")):
                text = t.as_py()
                wh = word_hashes(words_of(text))
                h = grams(wh)
                at = np.flatnonzero((bitmap[(h & low) >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1))
                if not len(at):
                    continue
                place = [m.span() for m in _WORD.finditer(text)]
                for a in np.split(at, np.flatnonzero(np.diff(at) > 2 * pad) + 1):
                    lo, hi = max(0, int(a[0]) - pad), min(len(wh), int(a[-1]) + GRAM + pad)
                    for col, v in zip(rows, (doc.as_py(), wh[lo:hi].view(np.int64), [p[0] for p in place[lo:hi]],
                                             [p[1] for p in place[lo:hi]], h[a].view(np.int64), (a - lo).astype(np.int32))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)
    return run


def _verify(coverage: float, band: int):
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("template", pa.int64()), ("coverage", pa.float64()),
                        ("matched", pa.int32()), ("span_start", pa.int32()), ("span_end", pa.int32())])

    def run(batches):
        for batch in batches:
            out = [[] for _ in schema]
            for r in batch.to_pylist():
                doc, hits = r["words"], {}
                for s, p in zip(r["seed"], r["at"]):
                    hits.setdefault(s, []).append(p)
                found = []
                for c in r["candidates"]:
                    item = c["words"]
                    pairs = [(p, q) for s, q in zip(c["seed"], c["at"]) for p in hits.get(s, ())]
                    found += [(-m, -m / len(item), c["template"], c["license"], a, b) for m, a, b in notices(doc, item, pairs, coverage, band)]
                taken: list[tuple[int, int]] = []
                for minus, share, template, name, a, b in sorted(set(found)):
                    if all(b <= x or y <= a for x, y in taken):
                        taken.append((a, b))
                        for col, v in zip(out, (r["doc_id"], name, template, -share, -minus, r["starts"][a], r["ends"][b - 1])):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
    return run


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(TEMPLATES)], "template long, license string, text string")


def license_matches(docs: DataFrame, templates: DataFrame | None = None, coverage: float = COVERAGE, band: int = BAND,
                    bits: int = BITS) -> DataFrame:
    """docs (doc_id, text, …), templates (template, license, text) → doc_id, license, template, coverage (matched
    share of the template's words), matched (words), span_start, span_end (code points, end exclusive), distinct.

    Null and empty texts and templates of fewer than three words give nothing; rows without an id are left out;
    rows that repeat an id give their matches once; extra columns are ignored; empty tables give no rows."""
    spark = docs.sparkSession
    templates = templates if templates is not None else template_table(spark)
    index = cut_lineage(templates.where("text is not null").select("template", "license", "text")
                        .mapInArrow(_index, "template long, license string, words array<long>, seed array<long>, at array<int>")
                        .where(F.size("seed") > 0))
    seeds = index.select("template", F.explode("seed").alias("seed"))
    shared = spark.sparkContext.broadcast(seed_bitmap(seeds, bits))
    longest = index.agg(F.max(F.size("words"))).first()[0] or 0
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    regions = cut_lineage(texts.mapInArrow(_regions(shared, bits, max(PAD, longest + band)), REGION)
                          .withColumn("region", F.monotonically_increasing_id()))
    pairs = regions.select("region", F.explode("seed").alias("seed")).distinct().join(seeds, "seed").select("region", "template").distinct()
    candidates = pairs.join(index, "template").groupBy("region").agg(F.collect_list(F.struct("template", "license", "words", "seed", "at")).alias("candidates"))
    return (regions.join(candidates, "region").drop("region")
            .mapInArrow(_verify(coverage, band), "doc_id long, license string, template long, coverage double, matched int, span_start int, span_end int")
            .distinct())


def licensed_documents(docs: DataFrame, **args) -> DataFrame:
    """One row per document with a match: doc_id, n_matches, licenses (distinct, ascending), spans
    (license:start:end:coverage in hundredths, by start)."""
    m = license_matches(docs, **args)
    one = F.struct("span_start", "span_end", "license", F.floor(100 * F.col("coverage") + 0.5).cast("int").alias("c"))
    got = m.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_matches"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
                                  F.array_sort(F.collect_list(one)).alias("s"))
    text = F.transform("s", lambda x: F.concat_ws(":", x["license"], x["span_start"].cast("string"), x["span_end"].cast("string"), x["c"].cast("string")))
    return got.select("doc_id", "n_matches", "licenses", F.array_join(text, ",").alias("spans"))
