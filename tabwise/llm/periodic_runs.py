"""Periodic run detection (operator 13): maximal stretches of words that repeat with a period, by internal pattern matching.

A run is a stretch of consecutive words of one document with smallest period q (words q apart are identical), at least
max(24, 3 q) words long, that no neighbouring word extends. Every run with q in [2^k, 2^(k+1)) holds a dyadic block (2^k
words from a multiple of 2^k; blocks of 8 words for all q below 8) together with its copy q words further on, because
two periods always hold a whole block. So each block asks for its own occurrences in the neighbouring window of
distances [2^k, 2^(k+1)):

* words become numbers, and positions whose next eight words occur once in their document leave (they start no block
  with a copy). The rest is sorted by prefix doubling into a suffix array of the slice, which never mixes documents;
  the blocks with equal words are one interval of it, for every k;
* a wavelet tree over that array answers range successor (the first occurrence at or after a position, within the
  interval of the block) and range counts;
* one or two occurrences are candidate periods themselves. Three or more form a progression whose difference r is the
  period of the block; then block and copy lie in two stretches of period r (in one, q would not be smallest), and the
  distance of their left or of their right ends is the only possible q;
* each candidate is extended word by word to its maximal stretch (once per stretch); of periods with one stretch the
  smallest is kept.

Work is done slice by slice (about 4 MB of text, one whole document at least), nothing is shuffled. Null and empty
texts have no words and no runs; repeated rows and null ids are answered row by row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, position_constants, slices

LEAST, REPEATS, BLOCK = 24, 3, 8


class WaveletMatrix:
    """Wavelet tree of an array of numbers below ``2 ** bits`` as one plane of prefix counts per bit; queries take arrays."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.planes, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            ones = (values >> b) & 1
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(1 - ones, out=before[1:])
            self.planes.append(before)
            self.zeros.append(int(before[-1]))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def count_below(self, low, high, x):
        """How many entries of [low, high) are less than x."""
        every, found = high - low, np.zeros(len(x), np.int64)
        for k, (before, zeros) in enumerate(zip(self.planes, self.zeros)):
            one = ((x >> (self.bits - 1 - k)) & 1).astype(bool)
            l0, h0 = before[low], before[high]
            found += np.where(one, h0 - l0, 0)
            low, high = np.where(one, low - l0 + zeros, l0), np.where(one, high - h0 + zeros, h0)
        return np.where(x >> self.bits > 0, every, found)

    def smallest(self, low, high, rank):
        """The entry of [low, high) with ``rank`` lesser ones."""
        rank, value = rank.copy(), np.zeros(len(rank), np.int64)
        for k, (before, zeros) in enumerate(zip(self.planes, self.zeros)):
            l0, h0 = before[low], before[high]
            one = rank >= h0 - l0
            rank -= np.where(one, h0 - l0, 0)
            value |= one.astype(np.int64) << (self.bits - 1 - k)
            low, high = np.where(one, low - l0 + zeros, l0), np.where(one, high - h0 + zeros, h0)
        return value

    def successor(self, low, high, x):
        """The least entry of [low, high) that is x or more; -1 without one."""
        out = np.full(len(x), -1, np.int64)
        fits = x < 1 << self.bits
        below = self.count_below(low[fits], high[fits], x[fits])
        some = below < high[fits] - low[fits]
        at = np.flatnonzero(fits)[some]
        out[at] = self.smallest(low[at], high[at], below[some])
        return out


def repeated_blocks(ids: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions whose next eight words occur more than once in their document (by hash: a few others may stay)."""
    n = len(ids) - BLOCK + 1
    if n <= 0:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = doc[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for o, c in enumerate(position_constants(BLOCK, 13)):
            h += ids[o:o + n].astype(np.uint64) * c
        h = mix(h)
    inside = np.arange(n) + BLOCK <= ends[doc[:n]]
    s = np.sort(h[inside])
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.empty(0, np.int64)
    at = np.searchsorted(twice, h)
    return np.flatnonzero(inside & (twice[np.minimum(at, len(twice) - 1)] == h))


def block_intervals(ids, doc, starts, ends, alive):
    """(suffix array over ``alive``, [(k, block positions as indices of alive, low, high)]): prefix doubling from eight
    words on; an order that keeps every class of equal 2^k words together, in which ranks are first indices."""
    index = np.full(len(ids) + 1, -1, np.int64)
    index[alive] = np.arange(len(alive))
    keys = [ids[alive + o] for o in range(BLOCK - 1, -1, -1)] + [doc[alive]]
    order = np.lexsort(keys)
    new = np.zeros(len(alive), bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    levels, k = [], 3
    offset = alive - starts[doc[alive]]
    while True:
        first = np.maximum.accumulate(np.where(new, np.arange(len(alive)), 0))
        rank = np.empty(len(alive), np.int64)
        rank[order] = first
        size = np.bincount(first, minlength=len(alive))
        several = size[rank] > 1
        blocks = np.flatnonzero(several & (offset % (1 << k) == 0) & (alive + (1 << k) <= ends[doc[alive]]))
        if len(blocks):
            levels.append((k, blocks, rank[blocks], rank[blocks] + size[rank[blocks]]))
        if not several.any():
            return order, levels
        # the next 2^k words: a position that left, or beyond the document, is like no other
        after = alive + (1 << k)
        inside = after < ends[doc[alive]]
        follow = np.where(inside, index[np.where(inside, after, 0)], -1)
        nxt = np.where(follow >= 0, rank[np.maximum(follow, 0)], len(alive) + np.arange(len(alive)))
        order = np.lexsort((nxt, rank))
        new[1:] = (rank[order][1:] != rank[order][:-1]) | (nxt[order][1:] != nxt[order][:-1])
        k += 1


def occurrences(ids, doc, starts, ends):
    """For every block with copies in its window: arrays (block position, k, first distance, second or 0, how many)."""
    alive = repeated_blocks(ids, doc, ends)
    if not len(alive):
        return
    order, levels = block_intervals(ids, doc, starts, ends, alive)
    tree = WaveletMatrix(order)
    for k, blocks, low, high in levels:
        windows = [(1 << k, 2 << k)] if k > 3 else [(1, BLOCK), (BLOCK, 2 * BLOCK)]
        for near, far in windows:
            at = alive[blocks]
            first = tree.successor(low, high, np.searchsorted(alive, at + near))
            hit = np.flatnonzero((first >= 0) & (alive[first] < at + far))
            if not len(hit):
                continue
            first, start, lo, hi = alive[first[hit]], at[hit], low[hit], high[hit]
            second = tree.successor(lo, hi, np.searchsorted(alive, first + 1))
            fits = (second >= 0) & (alive[second] < start + far)
            many = tree.count_below(lo, hi, np.searchsorted(alive, start + far)) - tree.count_below(lo, hi, np.searchsorted(alive, first))
            yield from zip(start.tolist(), [near] * len(start), (first - start).tolist(),
                           np.where(fits, alive[second] - start, 0).tolist(), many.tolist())


class Stretches:
    """Maximal stretches with a given period inside one document, each walked once."""

    def __init__(self, words: np.ndarray):
        self.words, self.last = words, {}

    def around(self, p: int, q: int) -> tuple[int, int]:
        """[start, end) of the maximal stretch of period q that holds the words p and p + q, which are equal."""
        s, e = self.last.get(q, (0, 0))
        if not (s <= p and p + q < e):
            s, e = self.last[q] = p - self._same(p, q, -1), p + q + self._same(p, q, 1)
        return s, e

    def _same(self, p: int, q: int, way: int) -> int:
        """How many words match q words on, from p forwards (p among them) or backwards (p not among them)."""
        w, done, step = self.words, 0, 32
        while True:
            if way > 0:
                a, b = w[p + done:p + done + step], w[p + q + done:p + q + done + step]
                a = a[:len(b)]
            else:
                low = max(0, p - done - step)
                a, b = w[low:p - done][::-1], w[low + q:p + q - done][::-1]
            differ = np.flatnonzero(a != b)
            if len(differ):
                return done + int(differ[0])
            done += len(a)
            if len(a) < step:
                return done
            step *= 2


def runs_of(words: np.ndarray, found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a document from the occurrences of its blocks, by start, then period."""
    stretches, runs = Stretches(words), {}
    for p, near, first, second, many in sorted(found):
        if near == 1:
            candidates = [(p, first)]  # the block is no shorter than the period: its next occurrence is one period on
        elif many < 3:
            candidates = [(p, d) for d in (first, second) if d]
        else:
            r = second - first
            a1, b1 = stretches.around(p, r)
            if b1 >= p + first + near:
                continue  # block and copies in one stretch of period r
            a2, b2 = stretches.around(p + first, r)
            candidates = [(max(p, a1), a2 - a1), (max(p, a1), b2 - b1)]
        for at, q in candidates:
            if q > 0 and at + q < len(words) and words[at] == words[at + q]:
                s, e = stretches.around(at, q)
                if e - s >= max(LEAST, REPEATS * q):
                    runs[s, e] = min(q, runs.get((s, e), q))
    return sorted((s, e - s, q) for (s, e), q in runs.items())


def find_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs of every list of words."""
    numbers = defaultdict(count().__next__)
    lengths = np.array([len(t) for t in texts], np.int64)
    ids = np.fromiter((numbers[w] for t in texts for w in t), np.int64, int(lengths.sum()))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    doc = np.repeat(np.arange(len(texts)), lengths)
    by = {}
    for p, *rest in occurrences(ids, doc, starts, ends):
        d = int(doc[p])
        by.setdefault(d, []).append((p - int(starts[d]), *rest))
    return [runs_of(ids[starts[d]:ends[d]], by[d]) if d in by else [] for d in range(len(texts))]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, texts: bool = False) -> DataFrame:
    """Per row: doc_id, runs (start word, length, period, by start, then period) and the sha256 of the collapsed text,
    in which a word is dropped if a run holds it after that run's first period; with ``texts`` that text too."""
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed_sha256", pa.string())] + [("collapsed", pa.string())] * texts)

    def scan(batches):
        for batch in batches:
            for part in slices(batch):
                words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in part.column("text").to_pylist()]
                runs = find_runs(words)
                digests, collapsed = [], []
                for w, found in zip(words, runs):
                    if found:
                        gone = np.zeros(len(w), bool)
                        for s, length, q in found:
                            gone[s + q:s + length] = True
                        w = [w[i] for i in np.flatnonzero(~gone)]
                    joined = b" ".join(w)
                    digests.append(hashlib.sha256(joined).hexdigest())
                    if texts:
                        collapsed.append(joined.decode("utf-8", "surrogatepass"))
                runs = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in found] for found in runs], pa.list_(_RUN))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), runs, pa.array(digests, pa.string())]
                                                 + ([pa.array(collapsed, pa.string())] if texts else []), schema=schema)

    ddl = "doc_id long, runs array<struct<start:long, length:long, period:long>>, collapsed_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, ddl + ", collapsed string" * texts)


def digest(found: DataFrame) -> DataFrame:
    """n_runs, the run of greatest length / period (ties: least start, then period) and the digest of all runs."""
    # lengths times periods stay far below 2^63, so exponents compare as exact products
    better = F.expr("""aggregate(runs, cast(null as struct<start:long, length:long, period:long>),
        (a, r) -> if(a is null or r.length * a.period > a.length * r.period, r, a))""")
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))")
    return found.withColumn("best", better).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), "collapsed_sha256")


def with_made_runs(docs: DataFrame) -> DataFrame:
    """The repeats that the query plants: with h = crc32 of the decimal doc_id and g = h div 10, a text with h % 10 = 0
    and n > 0 words keeps its first a = g % n words and repeats the next p = 1 + (n - a) div (3 + g % 8) of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.expr("filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+', -1), w -> w <> '')")
    chosen = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    chosen = chosen.withColumn("n", F.size("w")).withColumn("a", F.expr("if(n > 0, (h div 10) % n, 0)")) \
        .withColumn("p", F.expr("1 + (n - a) div (3 + (h div 10) % 8)"))
    text = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)])), ' ')")
    return chosen.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))
