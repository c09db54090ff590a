"""Suffix-array dedup (operator 12): bytes covered by 50-byte strings that also start in a document with a smaller id.

Equal strings are found by a suffix order of the collection, built column by column: every round puts one more symbol
of each document in front, inserts the longer suffixes into the Burrows-Wheeler transform of the collection and updates
the common prefixes with the neighbours; transform and prefixes are streams that a round reads and rewrites front to
back. Suffixes with 50 symbols in common stand side by side, so the least document of a group is a minimum over it.

A round costs a pass over the streams, so the collection is first cut into bins of bounded size that can be ordered on
their own:

1. Each 50-byte window has a seed, the least hash among its 24-byte strings; equal windows have equal seeds. Seeds are
   counted, and those of one document only leave (each task sends a seed once, however often it has met it).
2. Neighbouring windows with one seed are a piece (50 to 76 bytes). Pieces with a shared seed are dealt by seed: all
   equal windows meet in one bin. The streams of a bin stay in the memory of its task; before that bins lie in Spark's
   shuffle files, compressed, and are read in sequence. Where nearly all text is shared, its pieces are several times
   the text: the seeds are then parted into a few rounds, one after the other, each over all texts.
3. A seed of very many documents (a passage in a third of them) would be one large bin. Its pieces are merged where
   equal and cut into single windows, which are grouped as they are; what is found goes back to the places of the
   pieces by a join, the frequent ones salted.
4. Each document unites its spans.

The seeds that survive step 1 are held as a Bloom bitmap of fixed size in the second pass over the texts while they fit
it (false hits only add work). Beyond ``bitmap_rows`` seeds, or where the text is so long that they must be more, nothing
is broadcast: step 1 sends with each seed its place in the task's run of documents, the places of shared seeds come
back, and become a bit for each seed of a document, which is joined to its text. The seeds of step 3 are at most 2^20,
as more documents are allowed for one bin where there are more seeds. The shuffle files of a step go when it is written.

Null and empty texts have no bytes; rows with a null doc_id keep all bytes and hold no earlier string; rows of one
doc_id (repeated or not) do not remove from each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import mix, position_constants, slices

WINDOW, SEED, MOST_WINDOWS = 50, 24, 27
BITMAP_BITS, BITMAP_ROWS = 27, 1 << 23
HOT_DOCS, HOT_SEEDS, BIN_BYTES, TASK_BYTES, SALTS = 1 << 14, 1 << 20, 1 << 19, 10 << 20, 64
HELD_SEEDS, HELD_BYTES = 1 << 19, 6 << 20
#: Bytes of text for which one shared seed is expected at least; bytes of pieces for each byte of text up to which one
#: round takes them all (more rounds take as many bytes as the text has).
SEED_BYTES, ROUND_BYTES = 128, 1.5


def seeded_windows(data: np.ndarray, ends: np.ndarray):
    """(first window, number of windows, seed of 48 bits, document) of every stretch of windows with one seed, in texts laid
    end to end; stretches have MOST_WINDOWS windows at most, and no window leaves its text."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64), np.empty(0, np.int64))
    raw = np.concatenate([data, np.zeros(8, np.uint8)]).tobytes()
    eight = np.ndarray((len(data),), "<u8", raw, 0, (1,)).copy()
    count = len(data) - SEED + 1
    with np.errstate(over="ignore"):
        h = np.zeros(count, np.uint64)
        for o, c in zip(range(0, SEED, 8), position_constants(SEED // 8, 12)):
            h += eight[o:o + count] * c
        least = mix(h)
    width, have = WINDOW - SEED + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    # a stretch ends where the seed changes, and at the first and the last window of a text
    new = np.ones(n + 1, bool)
    np.not_equal(least[1:], least[:-1], out=new[1:n])
    new[ends[ends < n]] = True
    new[np.clip(ends - WINDOW + 1, 0, n)] = True
    first = np.flatnonzero(new)
    first, size = first[:-1], np.diff(first)
    doc = np.searchsorted(ends, first, side="right")
    good = first + WINDOW <= ends[doc]
    first, size = first[good], size[good]
    if len(size) and size.max() > MOST_WINDOWS:
        parts = -(-size // MOST_WINDOWS)
        which = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, size = np.repeat(first, parts) + which * MOST_WINDOWS, np.repeat(size, parts) - which * MOST_WINDOWS
        size = np.minimum(size, MOST_WINDOWS)
    return first, size, least[first] >> np.uint64(16), np.searchsorted(ends, first, side="right")


def _parts(batches):
    """Slices of about 256 KB of text; what Arrow holds for a batch goes back to the system before the next is read."""
    for batch in batches:
        yield from slices(batch, limit=1 << 18)
        del batch
        pa.default_memory_pool().release_unused()


def _laid_out(part):
    """(bytes of the non-null texts of an Arrow slice end to end, their ends)."""
    texts = [t or b"" for t in part.column("text").to_pylist()]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])


def _turned(seeds: np.ndarray) -> np.ndarray:
    """48-bit seeds with their halves exchanged (twice is the seed again): a least hash has small high bits, so that buckets
    by high bits would be very uneven; its low bits are not."""
    half = seeds.dtype.type(24)
    return (seeds & seeds.dtype.type((1 << 24) - 1)) << half | seeds >> half


def _seeds(batches, buckets: np.ndarray):
    """Distinct seeds of a task, turned, six bytes each, dealt to buckets by their high bits: those of one document, and
    those of several with the number of documents."""
    held, count = [], 0

    def flush():
        seeds = np.sort(_turned(np.concatenate(held)))
        first = np.flatnonzero(np.concatenate([[True], seeds[1:] != seeds[:-1]]))
        times = np.diff(first, append=len(seeds))
        seeds = seeds[first]
        bucket = (seeds >> np.uint64(16)) * np.uint64(len(buckets)) >> np.uint64(32)
        edge = np.searchsorted(bucket, np.arange(len(buckets) + 1))
        rows = {"bucket": [], "once": [], "often": []}
        for b in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
            part, n = seeds[edge[b]:edge[b + 1]], times[edge[b]:edge[b + 1]]
            rows["bucket"].append(buckets[b])
            rows["once"].append(part[n == 1].view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
            rows["often"].append(np.stack([part[n > 1].astype(np.int64), n[n > 1]]).tobytes())
        held.clear()
        return pa.RecordBatch.from_pydict(rows, schema=pa.schema([("bucket", pa.int32()), ("once", pa.binary()), ("often", pa.binary())]))

    for part in _parts(batches):
        _, _, seed, doc = seeded_windows(*_laid_out(part))
        if len(seed):
            order = np.lexsort((seed, doc))
            seed, doc = seed[order], doc[order]
            held.append(seed[np.concatenate([[True], (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])])])
            count += len(held[-1])
        if count > HELD_SEEDS:
            yield flush()
            count = 0
    if held:
        yield flush()


def _shared(batches):
    """Seeds of whole buckets that several documents hold, with the number of documents."""
    seeds, times = [], []
    for batch in batches:
        for once, often in zip(batch.column("once").to_pylist(), batch.column("often").to_pylist()):
            one = np.zeros((len(once) // 6, 8), np.uint8)
            one[:, :6] = np.frombuffer(once, np.uint8).reshape(-1, 6)
            several = np.frombuffer(often, np.int64).reshape(2, -1)
            seeds += [one.view(np.int64).ravel(), several[0]]
            times += [np.ones(len(one), np.int64), several[1]]
    if seeds:
        seeds, times = np.concatenate(seeds), np.concatenate(times)
        order = np.argsort(seeds)
        seeds = seeds[order]
        first = np.flatnonzero(np.concatenate([[True], seeds[1:] != seeds[:-1]])) if len(seeds) else np.empty(0, np.int64)
        docs = np.add.reduceat(times[order], first) if len(seeds) else times
        several = docs > 1
        yield pa.RecordBatch.from_pydict({"seed": _turned(seeds[first][several]), "docs": docs[several]})


_ASKED = pa.schema([("bucket", pa.int32()), ("run", pa.int64()), ("n", pa.int32()), ("seeds", pa.binary()), ("places", pa.binary()), ("often", pa.binary())])


def _asked(batches, buckets: np.ndarray):
    """The seeds of runs of documents, turned, dealt to buckets by their high bits: those of one document of the run (six bytes)
    with their places among the run's distinct seeds of each document, and those of several with the number of documents.
    A row with ``n`` >= 0 has the run's documents instead: keys, numbers of seeds, places of the seeds of several."""
    from pyspark import TaskContext

    task, held, keys, count = TaskContext.get().partitionId(), [], [], 0

    def flush():
        seeds = _turned(np.concatenate(held))
        order = np.argsort(seeds, kind="stable")
        ordered = seeds[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        times = np.diff(np.flatnonzero(new), append=len(ordered))
        several = np.repeat(times > 1, times)
        once, places = ordered[~several], order[~several].astype(np.uint32)
        often = np.stack([ordered[new][times > 1].astype(np.int64), times[times > 1]], axis=1)
        documents = np.concatenate(keys, axis=1)
        edges = []
        for v in (once, often[:, 0].astype(np.uint64)):
            bucket = (v >> np.uint64(16)) * np.uint64(len(buckets)) >> np.uint64(32)
            edges.append(np.searchsorted(bucket, np.arange(len(buckets) + 1)))
        one, two = edges
        some = np.flatnonzero((one[1:] > one[:-1]) | (two[1:] > two[:-1])).tolist()
        local = order[several].astype(np.uint32).tobytes()
        packed = np.array([len(some), documents.shape[1]]).tobytes() + documents.tobytes() + local
        # the same documents in another order are another run: what was asked and what is answered cannot be mixed up
        run = int.from_bytes(hashlib.blake2b(packed, digest_size=8, salt=task.to_bytes(8, "little"), person=len(runs).to_bytes(8, "little")).digest(), "little", signed=True)
        runs.append(run)
        rows = {"bucket": buckets[[*some, run % len(buckets)]], "run": [run] * (len(some) + 1), "n": [-1] * len(some) + [len(seeds)], "seeds": [], "places": [], "often": []}
        for b in some:
            rows["seeds"].append(once[one[b]:one[b + 1]].view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
            rows["places"].append(places[one[b]:one[b + 1]].tobytes())
            rows["often"].append(often[two[b]:two[b + 1]].tobytes())
        for c, v in (("seeds", b""), ("places", packed), ("often", b"")):
            rows[c].append(v)
        held.clear()
        keys.clear()
        return pa.RecordBatch.from_pydict(rows, schema=_ASKED)

    runs = []
    for part in _parts(batches):
        _, _, seed, doc = seeded_windows(*_laid_out(part))
        if len(seed):
            order = np.lexsort((seed, doc))
            seed, doc = seed[order], doc[order]
            new = np.concatenate([[True], (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1])])
            held.append(seed[new])
            rows, times = np.unique(doc[new], return_counts=True)
            keys.append(np.stack([*(part.column(c).to_numpy(zero_copy_only=False)[rows] for c in ("doc_id", "same")), times]))
            count += len(held[-1])
        if count > HELD_SEEDS:
            yield flush()
            count = 0
    if held:
        yield flush()


def _answered(batches, hot_docs: int):
    """For whole buckets: per run the places of the seeds that other runs hold too, each run's documents as they are, and
    one row (``n`` = -2) with the number of documents of shared seeds and the seeds of over ``hot_docs`` documents."""
    schema = pa.schema([("run", pa.int64()), ("n", pa.int32()), ("packed", pa.binary())])
    runs, seeds, places, often = [], [], [], []
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("run", "n", "seeds", "places", "often"))
        for run, n, six, place, several in zip(*columns):
            if n >= 0:
                yield pa.RecordBatch.from_pydict({"run": [run], "n": [n], "packed": [place]}, schema=schema)
                continue
            one = np.zeros((len(six) // 6, 8), np.uint8)
            one[:, :6] = np.frombuffer(six, np.uint8).reshape(-1, 6)
            runs.append(run)
            seeds.append(one.view(np.int64).ravel())
            places.append(np.frombuffer(place, np.uint32))
            often.append(np.frombuffer(several, np.int64).reshape(-1, 2))
    if not runs:
        return
    sizes = np.array([len(s) for s in seeds])
    seeds, places, often = np.concatenate(seeds), np.concatenate(places), np.concatenate(often)
    both = np.concatenate([seeds, often[:, 0]])
    order = np.argsort(both)
    new = np.concatenate([[True], both[order[1:]] != both[order[:-1]]]) if len(both) else np.empty(0, bool)
    first = np.flatnonzero(new)
    times = np.concatenate([np.ones(len(seeds), np.int64), often[:, 1]])[order]
    docs = np.add.reduceat(times, first) if len(first) else times
    shared = np.empty(len(both), bool)
    shared[order] = np.repeat(docs > 1, np.diff(first, append=len(both)))
    hot = docs > max(hot_docs, 1)
    packed = np.stack([_turned(both[order][first][hot]), docs[hot]], axis=1)
    yield pa.RecordBatch.from_pydict({"run": [docs[docs > 1].sum()], "n": [-2], "packed": [packed.tobytes()]}, schema=schema)
    edges = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    for k in range(0, len(runs), 1000):
        answers = [places[a:b][shared[a:b]].tobytes() for a, b in zip(edges[k:k + 1000], edges[k + 1:k + 1001])]
        yield pa.RecordBatch.from_pydict({"run": runs[k:k + 1000], "n": [-1] * len(answers), "packed": answers}, schema=schema)


def _kept(batches):
    """A bit for every distinct seed of every document, by seed: whether other documents hold it; documents without are left out."""
    known, answers = {}, {}
    for batch in batches:
        for run, n, packed in zip(*(batch.column(c).to_pylist() for c in ("run", "n", "packed"))):
            if n >= 0:
                known[run] = n, packed
            else:
                answers.setdefault(run, []).append(packed)
    for run, (n, packed) in known.items():
        asked, documents = np.frombuffer(packed, np.int64, 2).tolist()
        places = answers.pop(run, [])
        if len(places) != asked:
            raise RuntimeError("documents came in another order when a lost task was repeated")
        doc_id, same, sizes = np.frombuffer(packed, np.int64, 3 * documents, 16).reshape(3, -1)
        bits = np.zeros(n, bool)
        bits[np.frombuffer(b"".join([packed[16 + 24 * documents:], *places]), np.uint32)] = True
        ends = np.cumsum(sizes)
        some = np.flatnonzero(np.add.reduceat(bits, ends - sizes, dtype=np.int64))
        yield pa.RecordBatch.from_pydict({"doc_id": doc_id[some], "same": same[some], "kept": pa.array(
            [np.packbits(bits[a:b]).tobytes() for a, b in zip((ends - sizes)[some].tolist(), ends[some].tolist())], pa.binary())})
    if answers:
        raise RuntimeError("documents came in another order when a lost task was repeated")


class Wanted:
    """Which stretches of a slice are pieces to compare: their seeds are in the bitmap, or a join has put a bit for every
    seed of a text into the column ``kept``; ``hot`` says whether to take the hot seeds or those of a round."""

    def __init__(self, bitmap: bytes | None, hot: np.ndarray, rounds: int = 1, number: int = 0):
        self.bitmap, self.hot, self.rounds, self.number = bitmap, hot, rounds, number

    def of(self, part, seed, doc, hot: bool) -> np.ndarray:
        if self.bitmap is not None:
            bits, good = np.frombuffer(self.bitmap, np.uint8), np.ones(len(seed), bool)
            for at in (seed >> np.uint64(48 - BITMAP_BITS), seed & np.uint64((1 << BITMAP_BITS) - 1)):
                good &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        else:
            kept = part.column("kept").to_pylist()
            order = np.lexsort((seed, doc))
            s, d = seed[order], doc[order]
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
            at = np.cumsum(new) - 1
            at += (8 * np.cumsum([0, *map(len, kept)]))[d] - at[np.searchsorted(d, d)]
            good = np.empty(len(seed), bool)
            good[order] = np.unpackbits(np.frombuffer(b"".join(kept), np.uint8))[at]
        if not hot and self.rounds > 1:
            good &= (seed >> np.uint64(24)) % np.uint64(self.rounds) == self.number
        if len(self.hot):
            is_hot = self.hot[np.minimum(np.searchsorted(self.hot, seed), len(self.hot) - 1)] == seed
            return np.flatnonzero(good & is_hot) if hot else np.flatnonzero(good & ~is_hot)
        return np.flatnonzero(good & (not hot))


def _dealt_pieces(batches, wanted, tasks: np.ndarray):
    """Pieces without hot seeds, dealt by seed: packed arrays of sizes, ids, hashes, starts and the bytes."""
    held, size = [], 0

    def flush():
        seed, lengths, doc_id, same, start = (np.concatenate(c) for c in list(zip(*held))[:-1])
        raw = [p for h in held for p in h[-1]]
        to = (seed % np.uint64(len(tasks))).astype(np.int64)
        order = np.lexsort((seed, to))
        edge = np.searchsorted(to[order], np.arange(len(tasks) + 1))
        rows = {"task": [], "n": [], "packed": []}
        packer = zstandard.ZstdCompressor(level=1)
        for t in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
            o = order[edge[t]:edge[t + 1]]
            rows["task"].append(tasks[t])
            rows["n"].append(len(o))
            rows["packed"].append(packer.compress(b"".join([seed[o].tobytes(), doc_id[o].tobytes(), same[o].tobytes(), start[o].astype(np.int64).tobytes(),
                                                            lengths[o].astype(np.uint8).tobytes(), *[raw[k] for k in o.tolist()]])))
        held.clear()
        return pa.RecordBatch.from_pydict(rows, schema=pa.schema([("task", pa.int32()), ("n", pa.int32()), ("packed", pa.binary())]))

    for part in _parts(batches):
        data, ends = _laid_out(part)
        first, windows, seed, doc = seeded_windows(data, ends)
        good = wanted.of(part, seed, doc, False)
        first, lengths, doc = first[good], windows[good] + WINDOW - 1, doc[good]
        if len(good):
            raw, starts = data.tobytes(), ends - np.diff(ends, prepend=0)
            ids, same = (part.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("doc_id", "same"))
            held.append((seed[good], lengths, ids, same, first - starts[doc], [raw[a:a + n] for a, n in zip(first.tolist(), lengths.tolist())]))
            size += int(lengths.sum())
        if size > HELD_BYTES:
            yield flush()
            size = 0
    if held:
        yield flush()


def _hot_pieces(batches, wanted):
    """Pieces with hot seeds as rows."""
    for part in _parts(batches):
        data, ends = _laid_out(part)
        first, windows, seed, doc = seeded_windows(data, ends)
        good = wanted.of(part, seed, doc, True)
        first, end, doc = first[good], (first + windows)[good] + WINDOW - 1, doc[good]
        raw, starts, rows = data.tobytes(), ends - np.diff(ends, prepend=0), pa.array(doc)
        yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").take(rows), "same": part.column("same").take(rows), "start": first - starts[doc],
                                          "piece": pa.array([raw[a:b] for a, b in zip(first.tolist(), end.tolist())], pa.binary())})


def _least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values[low..high] (ends included) for arrays of ends, from minima of 1, 2, 4, ... values."""
    out = values[high].copy()
    wide = np.flatnonzero(high > low)
    level = np.frexp(high[wide] - low[wide] + 1)[1] - 1
    table, k = values, 0
    while len(wide):
        here = level == k
        w = wide[here]
        out[w] = np.minimum(table[low[w]], table[high[w] - (1 << k) + 1])
        wide, level = wide[~here], level[~here]
        if len(wide):
            table = np.minimum(table[:-(1 << k)], table[1 << k:])
            k += 1
    return out


def collection_order(texts: list[bytes], cap: int = WINDOW):
    """Burrows-Wheeler transform of a collection and its common prefixes (``cap`` at most), built column by column.

    Returns (transform, prefixes, number of end marks 0 in it): symbols are ranks of the bytes from 1, the i-th end
    mark is less than the next and than all symbols. Round 0 inserts the end marks; round j puts the j-th symbol from
    the right in front of the suffix that each text inserted last. A suffix goes where the transform has its symbol:
    behind all suffixes of lesser symbols and as many equal ones as stand before it."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    ends, m = np.cumsum(lengths), len(texts)
    present = np.zeros(256, bool)
    present[data] = True
    symbols = (np.cumsum(present)[data]).astype(np.uint8 if present.sum() < 256 else np.uint16)

    def from_right(which, j):
        """The j-th symbol from the right of the texts ``which``; 0 beyond their start."""
        out = np.zeros(len(which), symbols.dtype)
        fits = lengths[which] >= j
        out[fits] = symbols[ends[which[fits]] - j]
        return out

    bwt = from_right(np.arange(m), 1)
    lcp = np.zeros(m, np.uint8)
    text, place = np.arange(m), np.arange(m)
    owner = np.empty(m + len(data), np.int32)
    for j in range(1, int(lengths.max(initial=0)) + 1):
        active = bwt[place] > 0
        text, place = text[active], place[active]
        order = np.argsort(bwt, kind="stable")
        done = len(bwt) - np.count_nonzero(bwt)
        growing = np.zeros(len(bwt), bool)
        growing[place] = True
        owner[place] = text
        at = np.flatnonzero(growing[order])  # numbers among the symbols in order: where the longer suffixes go
        text = owner[order[at]]
        place = at + (m - done)
        # common prefix with the suffix before: one more than the least between the two equal symbols
        touched = np.stack([at, at + 1], axis=1).ravel()
        fresh = np.ones(len(touched), bool)
        fresh[1:] = touched[1:] != touched[:-1]
        touched = touched[fresh & (touched < len(order))]
        here, before = order[touched], order[touched - 1]
        equal = (bwt[here] == bwt[before]) & (touched > 0)
        shared = np.zeros(len(touched), np.uint8)
        shared[equal] = np.minimum(_least_between(lcp, before[equal] + 1, here[equal]), cap - 1) + 1
        old = np.ones(len(bwt) + len(place), bool)
        old[place] = False
        new_bwt, new_lcp = np.empty(len(old), bwt.dtype), np.empty(len(old), np.uint8)
        new_bwt[old], new_lcp[old] = bwt, lcp
        new_bwt[place] = from_right(text, j + 1)
        new_lcp[touched + (m - done)] = shared
        bwt, lcp = new_bwt, new_lcp
    return bwt, lcp, m


def least_owners(texts: list[bytes], owners: np.ndarray):
    """(text, window, least owner of the equal windows) of all windows, by text and window."""
    bwt, lcp, m = collection_order(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(bwt, kind="stable")
    done = len(bwt) - np.count_nonzero(bwt)
    longer = np.empty(len(bwt), np.int64)
    longer[order] = np.arange(len(bwt)) + (m - done)
    group = np.cumsum(lcp < WINDOW)
    least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max) if len(group) else np.empty(0, np.int64)
    which, place, found = np.arange(m), np.arange(m), []
    for j in range(1, int(lengths.max(initial=0)) + 1):
        keep = lengths[which] >= j
        which, place = which[keep], longer[place[keep]]
        if j >= WINDOW:
            g = group[place]
            np.minimum.at(least, g, owners[which])
            found.append((which, lengths[which] - j, g))
    if not found:
        return (np.empty(0, np.int64),) * 3
    which, window, g = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((window, which))
    return which[order], window[order], least[g[order]]


#: A span is one number: its start, shifted by SPAN_BITS, and its length.
SPAN_BITS = 31
_SPANS_SQL = "doc_id long, same long, span long"


def _bins(batches):
    """Spans found in the pieces of a task, which are ordered in bins of whole seeds."""
    fields, raw, unpacker = [], [], zstandard.ZstdDecompressor()
    for batch in batches:
        for n, packed in zip(batch.column("n").to_pylist(), batch.column("packed").to_pylist()):
            packed = unpacker.decompress(packed)
            longs = np.frombuffer(packed, np.int64, 4 * n).reshape(4, n)
            lengths = np.frombuffer(packed, np.uint8, n, 32 * n)
            at = 33 * n + np.cumsum(lengths, dtype=np.int64) - lengths
            raw += [packed[a:a + k] for a, k in zip(at.tolist(), lengths.tolist())]
            fields.append(longs)
    if not fields:
        return
    seed, doc_id, same, start = np.concatenate(fields, axis=1)
    order = np.argsort(seed, kind="stable")
    seed, doc_id, same, start, raw = seed[order], doc_id[order], same[order], start[order], [raw[k] for k in order.tolist()]
    edges = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1], [True]])).tolist()
    size, low, found = np.cumsum([0, *map(len, raw)]), 0, []
    for k in range(1, len(edges)):
        if k == len(edges) - 1 or size[edges[k + 1]] - size[edges[low]] > BIN_BYTES:
            a, b = edges[low], edges[k]
            low = k
            # equal pieces are one text of the collection, owned by its least document
            numbers = {}
            which = np.fromiter((numbers.setdefault(p, len(numbers)) for p in raw[a:b]), np.int64, b - a)
            owners = np.full(len(numbers), np.iinfo(np.int64).max)
            np.minimum.at(owners, which, doc_id[a:b])
            seeds = np.empty(len(numbers), np.int64)
            seeds[which] = seed[a:b]
            _, at, times = np.unique(seeds, return_inverse=True, return_counts=True)
            several = np.flatnonzero(times[at] > 1)
            texts = list(numbers)
            piece, window, least = least_owners([texts[k] for k in several.tolist()], owners[several])
            new = np.ones(len(piece), bool)
            new[1:] = (piece[1:] != piece[:-1]) | (least[1:] != least[:-1])
            first = np.flatnonzero(new)
            windows, piece, window, least = np.diff(first, append=len(piece)), several[piece[first]], window[first], least[first]
            # the only piece of a seed can share a window with no other text: only its copies count
            alone = np.flatnonzero(times[at] == 1)
            piece, window, least = np.append(piece, alone), np.append(window, np.zeros(len(alone), np.int64)), np.append(least, owners[alone])
            windows = np.append(windows, np.fromiter((len(texts[k]) - WINDOW + 1 for k in alone.tolist()), np.int64, len(alone)))
            order = np.lexsort((window, piece))
            piece, window, least, windows = piece[order], window[order], least[order], windows[order]
            # every place of a piece takes the stretches of its windows that an earlier document holds
            low_piece, high_piece = (np.searchsorted(piece, np.arange(len(numbers)), side) for side in ("left", "right"))
            times = (high_piece - low_piece)[which]
            place = np.repeat(np.arange(a, b), times)
            stretch = np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times) + low_piece[which][place - a]
            good = least[stretch] < doc_id[place]
            place, stretch = place[good], stretch[good]
            s = start[place] + window[stretch]
            found.append((doc_id[place], same[place], s << SPAN_BITS | windows[stretch] + WINDOW - 1))
    doc_id, same, span = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((span, same, doc_id))
    doc_id, same, span = doc_id[order], same[order], span[order]
    differs = np.ones(len(span), bool)  # repeated rows find the same spans
    differs[1:] = (doc_id[1:] != doc_id[:-1]) | (same[1:] != same[:-1]) | (span[1:] != span[:-1])
    columns = [v[differs] for v in (doc_id, same, span)]
    for k in range(0, len(columns[0]), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(v[k:k + 50_000]) for v in columns], names=["doc_id", "same", "span"])


def _removed(batches):
    """Per document the union of its spans taken out of its bytes."""
    for batch in batches:
        out = {"doc_id": batch.column("doc_id"), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for text, spans in zip(batch.column("text"), batch.column("spans")):
            text, kept, at, removed, count = text.as_py() or b"", [], 0, 0, 0
            if spans.is_valid:
                spans = np.sort(spans.values.to_numpy())
                starts = spans >> SPAN_BITS
                ends = np.maximum.accumulate(starts + (spans & (1 << SPAN_BITS) - 1))
                new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
                count = len(new)
                for s, e in zip(starts[new].tolist(), ends[np.append(new[1:], len(ends)) - 1].tolist()):
                    kept.append(text[at:s])
                    removed += e - s
                    at = e
            kept.append(text[at:])
            kept = b"".join(kept)
            for name, value in (("n_bytes", len(text)), ("n_removed", removed), ("n_spans", count), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept", kept)):
                out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
            ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]))


@contextmanager
def short_batches(spark, rows: int = 1000):
    """Arrow batches of few rows for the jobs inside, as whole texts pass to the workers; the setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def freed(spark):
    """Tables written inside by ``cut_lineage`` give back the disk of their shuffles at once, not when the driver happens to
    collect its garbage, and are packed more densely; the settings are put back."""
    names = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _one_for_each(spark, tasks: int) -> np.ndarray:
    """An integer for each of so many partitions that Spark's hash deals to it; numbers from 0 would leave a third of the
    partitions empty and give others several shares."""
    many = 16 * tasks
    while True:
        to = spark.range(many).select(F.col("id").cast("int").alias("key")).groupBy(F.pmod(F.hash("key"), F.lit(tasks)).alias("task")).agg(F.min("key").alias("key"))
        keys = {r.task: r.key for r in to.collect()}
        if len(keys) == tasks:
            return np.array([keys[t] for t in range(tasks)], np.int32)
        many *= 2


def _bitmap(seeds: DataFrame) -> bytes:
    """Two bits of every seed (its high and its low BITMAP_BITS), as bytes; 2 ** BITMAP_BITS bits whatever their number."""
    high, low = F.shiftrightunsigned("seed", 48 - BITMAP_BITS) + 1, F.col("seed").bitwiseAND((1 << BITMAP_BITS) - 1) + 1
    bits = seeds.select(F.explode(F.array(high, low)).alias("bit"))
    rows = bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    out = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for r in rows:
        out[(r.bucket - 1) * 4096:r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def _hot_spans(pieces: DataFrame, size: int) -> DataFrame:
    """Spans of pieces with hot seeds: windows of merged pieces grouped as they are, joined back to the places."""
    pieces = cut_lineage(pieces.distinct().withColumn("content", F.xxhash64("piece")))
    merged = cut_lineage(pieces.groupBy("content", "piece").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("places")))
    windows = F.expr(f"transform(sequence(0, length(piece) - {WINDOW}), i -> substring(piece, i + 1, {WINDOW}))")
    single = merged.select("content", "least", "most", F.posexplode(windows).alias("offset", "window"))
    equal = single.groupBy("window").agg(F.min("least").alias("first"))
    found = single.join(equal, "window").where("first < most").select("content", "offset", "first")
    # a piece with this share of all bytes as places is one of 100,000 at most: salted on both sides
    often = F.broadcast(merged.where(F.col("places") * 100_000 >= size).select("content", F.lit(True).alias("often")).distinct())
    salts = F.when(F.col("often"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    found = found.join(often, "content", "left").withColumn("salt", F.explode(salts)).drop("often")
    salt = F.when(F.col("often"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0).cast("int")
    places = pieces.select("content", "doc_id", "same", "start").join(often, "content", "left").withColumn("salt", salt).drop("often")
    s = F.col("start") + F.col("offset").cast("long")
    return places.join(found, ["content", "salt"]).where("first < doc_id").select("doc_id", "same", (F.shiftleft(s, SPAN_BITS) + WINDOW).alias("span"))


def repeated_spans(docs: DataFrame, bitmap_rows: int = BITMAP_ROWS, hot_docs: int = HOT_DOCS) -> DataFrame:
    """Spans (doc_id, same, spans: an array of them as numbers) to remove; ``docs`` has doc_id, text (binary), same (its hash)."""
    with short_batches(docs.sparkSession), freed(docs.sparkSession):
        return _spans(docs, bitmap_rows, hot_docs)


def _spans(docs: DataFrame, bitmap_rows: int, hot_docs: int) -> DataFrame:
    spark = docs.sparkSession
    known = docs.where("doc_id is not null and text is not null")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    to, bitmap = _one_for_each(spark, tasks), None
    if size <= SEED_BYTES * bitmap_rows:
        dealt = known.select("text").mapInArrow(lambda batches: _seeds(batches, to), "bucket int, once binary, often binary")
        seeds = cut_lineage(dealt.repartition(tasks, "bucket").mapInArrow(_shared, "seed long, docs long"))
        total, places = seeds.agg(F.count(F.lit(1)).alias("seeds"), F.sum("docs").alias("docs")).first()
        if total <= bitmap_rows:
            bitmap = _bitmap(seeds.select("seed"))
    if bitmap is not None:
        hot_docs = max(hot_docs, (places or 0) // HOT_SEEDS)
        hot = [r.seed for r in seeds.where(F.col("docs") > hot_docs).select("seed").collect()]
    else:
        dealt = known.mapInArrow(lambda batches: _asked(batches, to), "bucket int, run long, n int, seeds binary, places binary, often binary")
        answers = cut_lineage(dealt.repartition(tasks, "bucket").mapInArrow(lambda batches: _answered(batches, hot_docs), "run long, n int, packed binary"))
        counts = answers.where("n = -2").select("run", "packed").collect()
        places = sum(r.run for r in counts)
        seeds, docs_of = np.frombuffer(b"".join(r.packed for r in counts), np.int64).reshape(-1, 2).T
        hot = seeds[docs_of > max(hot_docs, places // HOT_SEEDS)]
        kept = answers.where("n > -2").repartition(tasks, "run").mapInArrow(_kept, "doc_id long, same long, kept binary")
        known = cut_lineage(known.join(kept.groupBy("doc_id", "same").agg(F.max("kept").alias("kept")), ["doc_id", "same"]))
    hot = np.sort(np.array(hot, np.uint64))
    wanted = spark.sparkContext.broadcast((bitmap, hot))
    # a piece has 14 windows in the mean
    much = (places or 0) * (WINDOW + 13) / max(size, 1)
    rounds = 1 if much <= ROUND_BYTES else ceil(much)
    spans = []
    for k in range(rounds):
        dealt = known.mapInArrow(lambda batches, k=k: _dealt_pieces(batches, Wanted(*wanted.value, rounds, k), to), "task int, n int, packed binary")
        spans.append(cut_lineage(dealt.repartition(tasks, "task").mapInArrow(_bins, _SPANS_SQL)))
    if len(hot):
        pieces = known.mapInArrow(lambda batches: _hot_pieces(batches, Wanted(*wanted.value)), "doc_id long, same long, start long, piece binary")
        spans.append(cut_lineage(_hot_spans(pieces, size)))
    spans = reduce(DataFrame.unionByName, spans)
    return spans.groupBy("doc_id", "same").agg(F.collect_list("span").alias("spans"))


def remove_repeats(docs: DataFrame, bitmap_rows: int = BITMAP_ROWS, hot_docs: int = HOT_DOCS) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (the remaining bytes)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).withColumn("same", F.xxhash64("text"))
    spans = repeated_spans(docs, bitmap_rows, hot_docs)
    return docs.join(spans, ["doc_id", "same"], "left").select("doc_id", "text", "spans").mapInArrow(
        _removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
