"""Token ids of a corpus in binary files: one wavelet matrix per shard.

A wavelet matrix holds a sequence of b-bit symbols as b bit planes: plane l has bit b-1-l of every symbol, in an
order stably partitioned by the planes above it. With rank counts beside each plane, ``access``, ``rank`` (how often
a symbol occurs before a position) and ``select`` (where its k-th occurrence is) take b steps. A file holds the
compressed planes, rank counts, and the ids and token counts of its documents.

Writing: rows are dealt to partitions by ranges of the document id (texts move once, inside Spark), sorted, encoded and written by the task itself; a task closes a file after ``file_tokens`` tokens,
so memory does not depend on the size of a partition or of one id's rows. File names follow from the partition, and
files are moved into place whole, so a task that runs again after a lost executor replaces equal files.
"""

from __future__ import annotations

import json
import math
import os
import re
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut_lineage
from .common import Generations, kept, slices

MAGIC, VERSION, BLOCK = b"WMTOKENS", 1, 512
FILE_TOKENS, SHARD_ROWS, PIECE = 1 << 20, 4096, 4 << 20

# the pre-tokenizer and normaliser for which ``apart`` is known to leave all ids as they are
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
FORM = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SIGNS = bytes(33 <= c < 127 and not chr(c).isalnum() for c in range(256))
LETTERS = np.array([chr(c).isalpha() and c < 128 for c in range(256)])


class WaveletMatrix:
    """bits[l]: plane l as 0/1 bytes; zeros[l]: how many 0s it has."""

    def __init__(self, planes: list[np.ndarray], n: int):
        self.n, self.bits = n, planes
        self.zeros = [n - int(np.count_nonzero(p)) for p in planes]
        self.ranks: list[np.ndarray] | None = None

    @classmethod
    def build(cls, symbols: np.ndarray, width: int) -> WaveletMatrix:
        now, planes = symbols, []
        for l in range(width):
            b = (now & now.dtype.type(1 << (width - 1 - l))) != 0
            planes.append(b)
            now = np.concatenate([now.compress(~b), now.compress(b)])
        return cls(planes, len(symbols))

    def decode(self) -> np.ndarray:
        """All symbols in order: the planes from the last to the first, undoing each partition."""
        kind = np.uint16 if len(self.bits) <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for l in range(len(self.bits) - 1, -1, -1):
            b, z = self.bits[l], self.zeros[l]
            up = np.empty(self.n, kind)
            # places by number: a mask of bits without order costs more than twice as much
            up[np.flatnonzero(~b)] = out[:z]
            up[np.flatnonzero(b)] = out[z:] | kind(1 << (len(self.bits) - 1 - l))
            out = up
        return out

    def _ones(self, l: int, i: int) -> int:
        """1s of plane l before position i: the count of the block, and the rest of it."""
        if self.ranks is None:
            self.ranks = [block_counts(np.packbits(b)) for b in self.bits]
        return int(self.ranks[l][i // BLOCK]) + int(self.bits[l][i // BLOCK * BLOCK:i].sum())

    def access(self, i: int) -> int:
        """The symbol at position i."""
        out = 0
        for l in range(len(self.bits)):
            ones, bit = self._ones(l, i), int(self.bits[l][i])
            out = out << 1 | bit
            i = self.zeros[l] + ones if bit else i - ones
        return out

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        for l in range(len(self.bits)):
            a, b = self._ones(l, lo), self._ones(l, hi)
            lo, hi = (self.zeros[l] + a, self.zeros[l] + b) if symbol >> (len(self.bits) - 1 - l) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a symbol in [lo, hi)."""
        if symbol >> len(self.bits):
            return 0
        a, b = self._range(symbol, lo, self.n if hi is None else hi)
        return b - a

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th occurrence (from 0); -1 if there are fewer."""
        if k < 0 or k >= self.count(symbol):
            return -1
        pos = self._range(symbol, 0, 0)[0] + k
        for l in range(len(self.bits) - 1, -1, -1):
            one = symbol >> (len(self.bits) - 1 - l) & 1
            want = pos - self.zeros[l] if one else pos
            lo, hi = 0, self.n - 1  # the position of the want-th equal bit
            while lo < hi:
                mid = (lo + hi) // 2
                ones = self._ones(l, mid + 1)
                if (ones if one else mid + 1 - ones) > want:
                    hi = mid
                else:
                    lo = mid + 1
            pos = lo
        return pos


def block_counts(packed: np.ndarray) -> np.ndarray:
    """1s before each block of BLOCK bits, from packed bits."""
    size = BLOCK // 8
    whole = np.zeros(-(-len(packed) // size) * size, np.uint8)
    whole[:len(packed)] = packed
    sums = np.bitwise_count(whole.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
    return np.concatenate([[0], np.cumsum(sums)]).astype(np.uint32)


def pack(doc_ids: list[int | None], counts: np.ndarray, tokens: np.ndarray, part: int, number: int) -> bytes:
    """The bytes of one file. Layout: magic, header length, header (JSON), then zstandard frames: document ids,
    token counts, and for each plane its bits and its rank counts; frame lengths are in the header."""
    width = max(1, int(tokens.max()).bit_length() if len(tokens) else 1)
    wm = WaveletMatrix.build(tokens.astype(np.uint16 if width <= 16 else np.uint32), width)
    press = zstandard.ZstdCompressor(level=1).compress
    nulls = [i for i, d in enumerate(doc_ids) if d is None]
    frames = [press(np.array([d or 0 for d in doc_ids], "<i8").tobytes()), press(np.asarray(counts, "<u8").tobytes())]
    for b in wm.bits:
        packed = np.packbits(b)
        frames += [press(packed.tobytes()), press(block_counts(packed).astype("<u4").tobytes())]
    head = json.dumps({"version": VERSION, "part": part, "number": number, "tokens": len(tokens), "documents": len(doc_ids),
                       "width": width, "null_ids": nulls, "frames": [len(f) for f in frames]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *frames])


def unpack(data) -> tuple[dict, list[int | None], np.ndarray, WaveletMatrix]:
    """Header, document ids, token counts and the matrix of a file's bytes."""
    data = memoryview(data)
    if bytes(data[:8]) != MAGIC:
        raise ValueError("not a token file")
    size, = struct.unpack("<I", data[8:12])
    head = json.loads(bytes(data[12:12 + size]))
    at, frames, open_ = 12 + size, [], zstandard.ZstdDecompressor().decompress
    for n in head["frames"]:
        frames.append(open_(data[at:at + n]))
        at += n
    ids = np.frombuffer(frames[0], "<i8").tolist()
    for i in head["null_ids"]:
        ids[i] = None
    planes = [np.unpackbits(np.frombuffer(f, np.uint8), count=head["tokens"]).view(bool) for f in frames[2::2]]
    wm = WaveletMatrix(planes, head["tokens"])
    wm.ranks = [np.frombuffer(f, "<u4") for f in frames[3::2]]
    return head, ids, np.frombuffer(frames[1], "<u8").astype(np.int64), wm


class WordEncoder:
    """Ids of whole texts by the tokenizers library, word by word.

    White space always ends a token of this kind of vocabulary, so a text's ids are its words' ids in order, and
    words repeat: each distinct word is encoded once and kept in a bounded cache. Words of common scripts are cut by
    the tokenizer's own pattern into pieces (one word with other punctuation gives the same pieces), which a copy of
    the tokenizer without normaliser encodes many at once; other words go through the whole tokenizer. A text that holds
    the string of an added token (in any case) is encoded as a whole with the library's own settings, which give that
    token's id."""

    def __init__(self, config: str, limit: int = 250_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        # Spark runs the tasks side by side: threads of the library's own take more CPU time for the same ids
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.config, self.asis = config, None
        self.whole = Tokenizer.from_str(config)
        self.whole.encode_special_tokens = True  # words never hold an added token
        parts = json.loads(config)
        self.added = [t["content"].lower() for t in parts.get("added_tokens") or [] if t["content"]]
        # how they begin, up to the first letter: a quick look that hardly a text passes
        self.marks = {re.match(r"[\W_]*", a).group() for a in self.added}
        self.plain, self.loose = None, False
        suffix = parts["model"].get("end_of_word_suffix")
        split = next((p for p in (parts.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"), None)
        if suffix and split and split["behavior"] == "Removed" and split["invert"]:
            self.plain = Tokenizer.from_str(config)
            self.plain.encode_special_tokens = True
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(),
                                                                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.cut = regex.compile(split["pattern"]["Regex"] + "|\n").findall
            self.loose = split["pattern"]["Regex"] == CUTS and (parts.get("normalizer") or {}).get("normalizers") == FORM
            vocabulary = self.whole.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.words, self.pieces = Generations(limit), Generations(limit)

    def _learn_pieces(self, new: set) -> dict:
        new = list(new)
        out = {}
        for a in range(0, len(new), 4096):
            part = new[a:a + 4096]
            found = self.plain.encode_batch_fast([" ".join(part[i:i + 64]) for i in range(0, len(part), 64)], add_special_tokens=False)
            flat = np.concatenate([np.array(e.ids, "<u4") for e in found])
            last = np.flatnonzero(self.ends[flat]) + 1
            raw = flat.tobytes()
            if len(last) != len(part):
                raise RuntimeError("a piece has no end")
            for p, i, j in zip(part, [0, *last[:-1].tolist()], last.tolist()):
                out[p] = raw[4 * i:4 * j]
        return out

    def _learn_words(self, new: set) -> dict:
        """Words of characters below U+0250, whose lower case does not depend on neighbours, are cut all at once; the
        end of a word is marked by four bytes that no two ids below 2^24 can hold together. Words of letters alone are
        one piece and need no cut."""
        simple = [w for w in new if w.isascii() or max(w) < 0xC9] if self.plain is not None else []
        out = {}
        if simple and self.loose:
            lower = b"\n".join(simple).decode().lower().split("\n")
            letters = {w: p for w, p in zip(simple, lower, strict=True) if p.isalpha()}
            known = self._learn_pieces(set(letters.values()))
            out = {w: known[p] for w, p in letters.items()}
            simple = [w for w in simple if w not in out]
        if simple:
            pieces = self.cut(b"\n".join(simple).decode().lower())
            known = self.pieces.fill(set(pieces).difference("\n"), self._learn_pieces)
            known["\n"] = b"\xff\xff\xff\xff"
            out.update(zip(simple, b"".join(map(known.__getitem__, pieces)).split(b"\xff\xff\xff\xff"), strict=True))
        rest = list(new.difference(out))
        if rest:
            found = self.whole.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)
            out.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(rest, found))
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint32 ids of each text; none for null and empty."""
        odd = set()
        for mark in self.marks:
            odd.update(k for k, t in enumerate(texts) if t and mark in t and any(a in t.lower() for a in self.added))
        whole = pa.array([t if t and k not in odd else "" for k, t in enumerate(texts)], pa.large_string())
        split = pc.ascii_split_whitespace(apart(whole) if self.loose else whole)
        # Arrow finds the distinct words, only these become Python objects; ids are copied by number of the word
        coded = split.values.dictionary_encode()
        which, found = coded.indices.to_numpy(), self.words.values(_as_bytes(coded.dictionary), self._learn_words)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start, ends = np.cumsum(size) - size, np.concatenate([[0], np.cumsum(size[which])])
        flat = np.frombuffer(b"".join(found), "<u4")[np.arange(ends[-1]) + np.repeat(start[which] - ends[:-1], size[which])]
        cuts = ends[split.offsets.to_numpy()].tolist()
        out = [flat[a:b] for a, b in zip(cuts, cuts[1:])]
        if odd and self.asis is None:
            from tokenizers import Tokenizer
            self.asis = Tokenizer.from_str(self.config)
        for k in odd:
            out[k] = np.array(self.asis.encode(texts[k], add_special_tokens=False).ids, "<u4")
        return out


def apart(texts: pa.LargeStringArray) -> pa.LargeStringArray:
    """Texts (none null, not a slice) with A-Z in lower case and a space between a letter (a-z, U+00C0 to U+00FF) and an
    ASCII sign after it, so that fewer distinct words are left. ``CUTS`` always ends a token there, and ``FORM`` puts
    A-Z in lower case anyway. Texts are left as they are if any holds a character of U+0300 to U+037F: only with these
    marks can a capital and its small letter be composed differently."""
    _, ends, data = texts.buffers()
    if data is None or b"\xcc" in (raw := data.to_pybytes()) or b"\xcd" in raw:
        return texts
    raw, ends = raw.lower(), np.frombuffer(ends, np.int64)[:len(texts) + 1]
    old, sign = np.frombuffer(raw, np.uint8), np.frombuffer(raw.translate(SIGNS), bool)
    at = np.flatnonzero(sign[2:]) + 2
    last, lead = old[at - 1], old[at - 2]
    at = at[LETTERS[last] | ((lead == 0xC3) & (last != 0x97) & (last != 0xB7))]  # but for the signs of times and division
    new = np.full(len(old) + len(at), ord(" "), np.uint8)
    stay = np.ones(len(new), bool)
    stay[at + np.arange(len(at))] = False
    new[stay] = old
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends + np.searchsorted(at, ends)), pa.py_buffer(new))


def _as_bytes(strings: pa.LargeStringArray) -> list[bytes]:
    """The bytes of each string (none null), cut from one buffer: several times as fast as ``to_pylist``."""
    _, ends, data = strings.buffers()
    ends = np.frombuffer(ends, np.int64)[strings.offset:strings.offset + len(strings) + 1].tolist()
    data = data.to_pybytes() if data else b""
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def _encoder(config: str) -> WordEncoder:
    return kept(("tokens", hash(config)), lambda: WordEncoder(config))


def _store(folder: str):
    """File system and path of a folder name with or without a scheme."""
    if ":/" in folder:
        return pyarrow.fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if not folder.startswith("file://") else folder)
    return pyarrow.fs.LocalFileSystem(), folder


def _put(folder: str, name: str, data: bytes) -> None:
    """Write a whole file under another name and move it into place."""
    fs, path = _store(folder)
    last, part = f"{path}/{name}", f"{path}/_{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(data)
    try:
        fs.move(part, last)
    except OSError:  # stores that do not replace: an equal file is there already
        if fs.get_file_info(last).type == pyarrow.fs.FileType.NotFound:
            raise
        fs.delete_file(part)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str, shard_rows: int = SHARD_ROWS,
                 file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode docs (doc_id, text, …) and write them to files in ascending doc_id order, ``end_id`` after each
    document. Gives (and has run) the list of files: file, part, number, documents, tokens.

    Null ids come first; rows that repeat an id are all written, ordered by text; null and empty texts are one
    ``end_id``; other columns are ignored; an empty table gives no file."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = max(1, math.ceil(docs.count() / shard_rows))
    dealt = (rows.repartitionByRange(shards, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
             .withColumn("part", F.spark_partition_id()))
    with open(tokenizer, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    fs, path = _store(folder)
    fs.create_dir(path, recursive=True)
    schema = pa.schema([("file", pa.string()), ("part", pa.int32()), ("number", pa.int32()), ("documents", pa.int64()), ("tokens", pa.int64())])

    def run(batches):
        encoder, end = _encoder(shared.value), np.array([end_id], "<u4")
        ids, lengths, held, size, number, part = [], [], [], 0, 0, 0

        def flush():
            nonlocal ids, lengths, held, size, number
            name = f"part-{part:06d}-{number:06d}.wm"
            _put(folder, name, pack(ids, np.array(lengths), np.concatenate(held), part, number))
            row = pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((name, part, number, len(ids), size), schema)], schema=schema)
            ids, lengths, held, size, number = [], [], [], 0, number + 1
            return row

        for batch in batches:
            for piece in slices(batch, limit=PIECE):
                part = piece.column("part")[0].as_py()
                found = encoder.encode(piece.column("text").to_pylist())
                for d, x in zip(piece.column("doc_id").to_pylist(), found):
                    ids.append(d)
                    lengths.append(len(x) + 1)
                    held += [x, end]
                    size += len(x) + 1
                    if size >= file_tokens:
                        yield flush()
        if ids:
            yield flush()

    return cut_lineage(dealt.mapInArrow(run, "file string, part int, number int, documents long, tokens long"))


def read_tokens(files: DataFrame, folder: str, files_per_task: int = 8) -> DataFrame:
    """The documents of the listed files, read back: doc_id, start (tokens before it in the whole corpus),
    n_tokens, ids (bytes, little-endian unsigned 32-bit). Each task opens the files it is given by name; only names
    and offsets are shuffled."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                fs, path = _store(folder)
                with fs.open_input_stream(f"{path}/{name}") as f:
                    _, ids, counts, wm = unpack(f.read())
                raw = wm.decode().astype("<u4", copy=False).tobytes()
                ends = np.cumsum(counts)
                for a in range(0, len(ids), 2000):
                    b = min(len(ids), a + 2000)
                    spans = list(zip((ends[a:b] - counts[a:b]).tolist(), ends[a:b].tolist()))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[a:b], pa.int64()), pa.array([base + s for s, _ in spans], pa.int64()),
                        pa.array(counts[a:b], pa.int64()), pa.array([raw[4 * s:4 * e] for s, e in spans], pa.binary())], schema=schema)

    # one row per written partition meets in one task; files of a partition are summed beside each other
    parts = files.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("part").orderBy("number")
    starts = (files.withColumn("ahead", F.sum("tokens").over(inside) - F.col("tokens")).join(before, "part")
              .select("file", (F.col("before") + F.col("ahead")).alias("base")))
    tasks = max(1, math.ceil(files.count() / files_per_task))
    return starts.repartition(tasks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def corpus_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, **args) -> DataFrame:
    """Write and read back: see ``write_tokens`` and ``read_tokens``. Without a folder a new one under the shared
    checkpoint folder is used."""
    folder = folder or f"{checkpoint_dir(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    files = write_tokens(docs, tokenizer, end_id, folder, **args)
    return read_tokens(files, folder)
