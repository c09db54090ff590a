"""Token counts of texts, and TF-IDF scores of texts against a bounded index, in Arrow batches.

Tokens are the runs of ASCII letters and digits of the whole text, in lower case, as in ``functions.token_rows``."""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# letters and digits as they are, A-Z in lower case, every other byte a space
FOLD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 32 for b in range(256))
TEXT_BYTES, CELLS = 2 << 20, 1 << 20


def _pieces(batches):
    """(keys, texts as bytes) of some megabytes of text, one row at least."""
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
        ends = np.cumsum(np.fromiter((len(v.as_buffer()) if v.is_valid else 0 for v in texts), np.int64, len(texts)))
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TEXT_BYTES)))
            yield keys.slice(a, b - a), texts.slice(a, b - a).to_pylist()
            a = b


def _counted(texts: list[bytes | None]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Row, token and count of every distinct token of each text."""
    tokens, counts, sizes = [], [], []
    for text in texts:
        found = Counter(text.translate(FOLD).split()) if text else {}
        tokens += found
        counts += found.values()
        sizes.append(len(found))
    return np.repeat(np.arange(len(texts)), sizes), tokens, np.array(counts, np.float64)


def token_counts(df: DataFrame, key: str, text: str, key_alias: str = "k", token_alias: str = "t") -> DataFrame:
    """(key, token, tf) of each row; rows that share a key are not summed here."""
    def run(batches):
        for keys, texts in _pieces(batches):
            row, tokens, counts = _counted(texts)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(tokens, pa.string()), pa.array(counts.astype(np.int64))],
                                             names=[key_alias, token_alias, "tf"])

    schema = T.StructType([T.StructField(key_alias, df.schema[key].dataType), T.StructField(token_alias, T.StringType()),
                           T.StructField("tf", T.LongType())])
    return df.select(key, F.col(text).cast("string")).mapInArrow(run, schema)


class Index:
    """The right side by tokens: ``idf`` of each token and of unknown ones (last), and postings (item, wn) in the order
    of tokens. Items are numbered in the order of their keys."""

    def __init__(self, rw: DataFrame, idf: DataFrame, default_idf: float):
        known = idf.select("t", "idf").toArrow()
        tokens = known.column("t").cast(pa.binary()).to_pylist()
        self.place = {t: i for i, t in enumerate(tokens)}
        self.idf = np.append(known.column("idf").to_numpy(), default_idf)
        rows = rw.select("r", "t", "wn").orderBy("r").toArrow().combine_chunks()
        keys = pa.concat_arrays(rows.column("r").chunks) if rows.num_rows else pa.array([], rows.schema.field("r").type)
        coded = keys.dictionary_encode()
        self.key_type = rw.schema["r"].dataType
        self.keys, items = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        token = np.fromiter(map(self.place.__getitem__, rows.column("t").cast(pa.binary()).to_pylist()), np.int64, rows.num_rows)
        order = np.argsort(token, kind="stable")
        self.item, self.wn = items[order], rows.column("wn").to_numpy()[order]
        self.start = np.searchsorted(token[order], np.arange(len(tokens) + 2))
        self.size = np.diff(self.start)  # none for unknown tokens

    def scores(self, texts: list[bytes | None], n: int | None):
        """Blocks of (row, item, cosine, rank) for the pairs with a token in common, the ``n`` best of each row or all, ranked
        by the cosine rounded to 9 decimals, then by the item."""
        width = len(self.keys)
        if not width:
            return
        row, tokens, counts = _counted(texts)
        token = np.fromiter(map(self.place.get, tokens, repeat(len(self.place))), np.int64, len(tokens))
        w = counts * self.idf[token]
        norm = np.sqrt(np.bincount(row, w * w, len(texts)))
        known = self.size[token] > 0
        row, token, w = row[known], token[known], w[known]
        w /= norm[row]
        work = np.cumsum(np.maximum(np.bincount(row, self.size[token], len(texts)), width))
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(work, (work[a - 1] if a else 0) + CELLS)))
            lo, hi = np.searchsorted(row, [a, b])
            size = self.size[token[lo:hi]]
            at = np.arange(int(size.sum())) + np.repeat(self.start[token[lo:hi]] - (np.cumsum(size) - size), size)
            cell = np.repeat((row[lo:hi] - a) * width, size) + self.item[at]
            found = np.bincount(cell, np.repeat(w[lo:hi], size) * self.wn[at], (b - a) * width)
            found = found.astype(np.float64, copy=False).reshape(b - a, width)  # bincount of nothing gives integers
            whole = np.floor(found * 1e9 + 0.5)
            hits = found > 0
            if n is not None and n < width:
                hits &= whole >= np.partition(whole, width - n, axis=1)[:, width - n, None]
            r, i = np.nonzero(hits)
            order = np.lexsort((i, -whole[r, i], r))
            r, i = r[order], i[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r) + 1
            if n is not None:
                best = rank <= n
                r, i, rank = r[best], i[best], rank[best]
            yield r + a, i, found[r, i], rank
            a = b


def score_rows(left: DataFrame, lkey: str, ltext: str, index: Index, n: int | None = None) -> DataFrame:
    """(l, r, cosine, rank) of every row against the whole index, which goes to all tasks; keys of ``left`` are taken to
    come once."""
    shared = left.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        index = shared.value
        for keys, texts in _pieces(batches):
            for row, item, cosine, rank in index.scores(texts, n):
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), index.keys.take(pa.array(item)), pa.array(cosine),
                                                  pa.array(rank.astype(np.int32))], names=["l", "r", "cosine", "rank"])

    schema = T.StructType([T.StructField("l", left.schema[lkey].dataType), T.StructField("r", index.key_type),
                           T.StructField("cosine", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    return left.select(lkey, F.col(ltext).cast("string")).mapInArrow(run, schema)
