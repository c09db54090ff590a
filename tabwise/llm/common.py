"""Helpers of the training-data operators: table access, words, hashes, a per-process cache."""

from __future__ import annotations

import sys

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(key: tuple, make):
    """``make()``, kept for the worker process under ``key``. Functions of this package are pickled by value, so their
    module globals are new in every task; Python workers are reused, and what hangs on ``sys`` stays. Only the latest
    key is kept, so that idle workers do not hold the models of earlier jobs."""
    cache = sys.__dict__.setdefault("_tabwise_llm_cache", {})
    if key not in cache:
        cache.clear()
        cache[key] = make()
    return cache[key]


def word_list(text: str | None) -> list[bytes]:
    """Lower-case A-Z only, words are runs of characters other than space and \\x09-\\x0D (``bytes`` methods do
    exactly that)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (two multiply-xorshift rounds, vectorised)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * _M1
        h = (h ^ (h >> np.uint64(33))) * _M2
        return h ^ (h >> np.uint64(33))


def position_constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers."""
    base = np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)
    with np.errstate(over="ignore"):
        return mix(base * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def picked_hashes(wh: np.ndarray, offsets: np.ndarray, constants: np.ndarray) -> np.ndarray:
    """For every start position i the hash of the words at i + offsets (the span is ``offsets[-1] + 1``)."""
    n = len(wh) - int(offsets[-1])
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for o, c in zip(offsets, constants):
            h += wh[o:o + n] * c
    return mix(h)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; with fewer words, the whole sequence as one;
    without words, empty."""
    wh = word_hashes(word_list(text))
    if not len(wh):
        return wh
    if len(wh) < width:
        h = picked_hashes(wh, np.arange(len(wh)), position_constants(len(wh), 100 + len(wh)))
    else:
        h = picked_hashes(wh, np.arange(width), position_constants(width, 7))
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def salted(col: str, n: int):
    """A salt 0…n-1 from a hash of a column."""
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")


def slices(batch, column: str = "text", limit: int = 4 << 20):
    """Slices of an Arrow batch with about ``limit`` characters of ``column`` each (one row at least), so that
    what a task makes from a batch stays small however long the texts are."""
    start = chars = 0
    for i, v in enumerate(batch.column(column)):
        n = len(v.as_buffer()) if v.is_valid else 0
        if chars and chars + n > limit:
            yield batch.slice(start, i - start)
            start, chars = i, 0
        chars += n
    if start < batch.num_rows:
        yield batch.slice(start)


class Generations:
    """A bounded cache of two generations: a full young one becomes the old one, and what is used again moves to
    the young one, so frequent entries stay."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def fill(self, keys: set, learn) -> dict:
        """The young generation, holding at least ``keys``; ``learn(missing)`` gives a dict of new entries."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        missing = keys.difference(self.young)
        known = {k: self.old[k] for k in missing if k in self.old}
        self.young.update(known)
        missing = missing.difference(known)
        if missing:
            self.young.update(learn(missing))
        return self.young

    def values(self, keys: list, learn) -> list:
        """The values (not None) of distinct keys, in order; ``learn`` as in ``fill``."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        out = list(map(self.young.get, keys))
        missing = [i for i, v in enumerate(out) if v is None]
        if missing:
            older = [self.old.get(keys[i]) for i in missing]
            new = learn({keys[i] for i, v in zip(missing, older) if v is None})
            for i, v in zip(missing, older):
                out[i] = self.young[keys[i]] = new[keys[i]] if v is None else v
        return out
