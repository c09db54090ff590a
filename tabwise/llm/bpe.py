"""Byte-level BPE through a sentencepiece model that is written directly from a rank vocabulary.

``serialise`` turns ranks (bytes → rank) into a sentencepiece BPE model without training: each token's bytes are
mapped to printable characters, the piece's score is its negative rank and its id its rank; normalisation is the
identity. Merging the pair of highest score first is then merging the pair of lowest rank first. Texts are cut
into pre-tokens by the public pattern, each pre-token is mapped and encoded by itself (a bounded per-process cache
holds the ids of frequent ones), and decoding maps pieces back to bytes.

Scale: map-only; the serialised model (about 1 MB, fixed by the vocabulary) is broadcast.
"""

from __future__ import annotations

import base64
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from .common import kept, slices

CACHE_ENTRIES = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def byte_map() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, the next free one from U+0100 else."""
    out, free = [], 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _string(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model (protocol-buffer bytes). Ranks must be 0…n-1; id n is the unknown piece, which
    byte-mapped text with all 256 byte pieces never yields."""
    n, chars = len(ranks), byte_map()
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(n)) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must run from 0 without a gap and hold all single bytes")
    # field numbers of the public format: piece 1, score 2, type 3 (normal 1, unknown 2)
    normal, unknown, bpe = 1, 2, 2
    pieces = [_string(1, "".join(chars[b] for b in t).encode()) + b"\x15" + struct.pack("<f", -float(r)) + _number(3, normal)
              for r, t in enumerate(tokens)]
    pieces.append(_string(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, unknown))
    trainer = _number(3, bpe) + _number(4, n + 1) + _number(40, n) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    identity = _string(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(_string(1, p) for p in pieces) + _string(2, trainer) + _string(3, identity)


class Codec:
    """Encoder and decoder over a serialised model."""

    def __init__(self, model: bytes, pattern: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        chars = byte_map()
        self.to_char = {b: c for b, c in enumerate(chars)}
        back = {c: b for b, c in enumerate(chars)}
        unk = self.sp.unk_id()
        self.pieces = [b"" if i == unk else bytes(back[c] for c in self.sp.id_to_piece(i)) for i in range(self.sp.get_piece_size())]
        self.whole = {p: i for i, p in enumerate(self.pieces) if i != unk}
        self.known: dict[str, bytes] = {}

    def _learn(self, tokens) -> dict[str, bytes]:
        """Packed ids of pre-tokens; a pre-token that is itself a token is that token."""
        tokens = list(tokens)
        raw = [t.encode() for t in tokens]
        merge = [i for i, r in enumerate(raw) if r not in self.whole]
        ids = self.sp.encode([raw[i].decode("latin-1").translate(self.to_char) for i in merge], out_type=int, num_threads=1)
        found = {t: struct.pack("<i", self.whole[r]) for t, r in zip(tokens, raw) if r in self.whole}
        found.update((tokens[i], struct.pack(f"<{len(x)}i", *x)) for i, x in zip(merge, ids))
        return found

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """int32 ids of each text; none for null or empty."""
        cut = [self.split(t) if t else [] for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.known)
        if len(self.known) + len(new) > CACHE_ENTRIES:
            self.known.clear()
            new = set(chain.from_iterable(cut))
        self.known.update(self._learn(new))
        get = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(get, c)), "<i4") for c in cut]
        for t in [t for t in new if len(t) > 64]:  # very long pre-tokens are not kept
            del self.known[t]
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


def _codec(shared, pattern: str) -> Codec:
    return kept(("bpe", hash(shared.value), pattern), lambda: Codec(shared.value, pattern))


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", decode: bool = False) -> DataFrame:
    """docs (id_col, text, …) → id_col, ids array<int>, and with ``decode`` the bytes decoded from those ids.
    One row per input row, repeated rows included; null and empty texts have no ids; a null id stays null; other
    columns are ignored; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(serialise(read_ranks(vocabulary)))
    fields = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))] + [("decoded", pa.binary())] * decode
    schema = pa.schema(fields)

    def run(batches):
        codec = _codec(shared, pattern)
        for batch in batches:
            for part in slices(batch):
                ids = codec.encode_batch(part.column("text").to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                cols = [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))]
                if decode:
                    cols.append(pa.array([codec.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    out = "doc_id long, ids array<int>" + ", decoded binary" * decode
    return (docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", "text").mapInArrow(run, out)
            .withColumnRenamed("doc_id", id_col))


def decode(tokens: DataFrame, vocabulary: str, pattern: str = "", id_col: str = "doc_id") -> DataFrame:
    """tokens (id_col, ids array<int>) → id_col, decoded binary; null ids decode to no bytes."""
    shared = tokens.sparkSession.sparkContext.broadcast(serialise(read_ranks(vocabulary)))
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def run(batches):
        codec = _codec(shared, pattern or ".")
        for batch in batches:
            out = [codec.decode(np.asarray(v.as_py() or [], np.int64)) for v in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], schema=schema)

    return (tokens.selectExpr(f"cast(`{id_col}` as long) as doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")
            .withColumnRenamed("doc_id", id_col))
