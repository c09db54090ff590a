"""Quality classifier by compression: two zstandard dictionaries, trained on good and on bad labelled texts, and
the normalised difference of the two compressed sizes as the only feature, calibrated to a probability. A text is
compressed whole, in pieces of ``PIECE`` bytes that each start from the dictionary alone; else a long text soon
compresses from its own past and the dictionaries no longer tell.

Fitting uses bounded samples (``per_class`` rows for each dictionary, ``calibration_rows`` for the calibration,
and at most ``max_chars`` characters of each), chosen by a hash of the doc_id; the samples do not overlap. Scoring
is map-only over every whole text; the model (two dictionaries of ``DICTIONARY_BYTES``, two numbers) is sent with
the function.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, slices

DICTIONARY_BYTES, CHUNK, PIECE, LEVEL, SMOOTHING = 64 << 10, 512, 1024, 3, 100


def held_out(id_col="doc_id"):
    """crc32 of the id as text, modulo 5, is 0."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def build_dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; raw content when there is too little text to train on."""
    raw = [t.encode() for t in texts if t]
    parts = [x[i:i + CHUNK] for x in raw for i in range(0, len(x), CHUNK)]
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, parts)) // 4))
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(raw)[:DICTIONARY_BYTES]


def _sizes(content: bytes):
    """A function: bytes that a text takes, compressed piece by piece with the dictionary."""
    shared = zstandard.ZstdCompressionDict(content)
    shared.precompute_compress(level=LEVEL)
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False, write_checksum=False,
                                     write_dict_id=False).compress
    return lambda raw: sum(len(press(raw[i:i + PIECE])) for i in range(0, len(raw), PIECE))


def _difference(bad, good, raw) -> float:
    return (bad(raw) - good(raw)) / (len(raw) + SMOOTHING) if len(raw) else 0.0


def _kept_sizes(bad: bytes, good: bytes):
    return kept(("quality", hash(bad), hash(good)), lambda: (_sizes(bad), _sizes(good)))


@dataclass
class CompressionModel:
    """bad, good: dictionaries; the score is the logistic of ``slope * difference + offset``."""

    bad: bytes
    good: bytes
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, docs: DataFrame) -> DataFrame:
        """docs (doc_id, text, …) → doc_id, difference: (bytes with the bad dictionary - bytes with the good one)
        over (bytes of the text + SMOOTHING). Null and empty texts: 0."""
        bad, good = self.bad, self.good
        schema = pa.schema([("doc_id", pa.int64()), ("difference", pa.float64())])

        def run(batches):
            b, g = _kept_sizes(bad, good)
            for batch in batches:
                for part in slices(batch):
                    out = [_difference(b, g, memoryview(t.as_buffer()) if t.is_valid else b"") for t in part.column("text")]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.float64())], schema=schema)

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, difference double")

    def _probability(self, difference):
        return 1 / (1 + F.exp(-(F.lit(self.slope) * difference + F.lit(self.offset))))

    def score(self, docs: DataFrame, threshold: float = 0.3) -> DataFrame:
        """doc_id, score (0 to 1, higher: good likelier), predicted (1 if score >= threshold). One row per input
        row; empty and null texts score as a difference of 0; an empty table gives no rows."""
        return (self.difference(docs).select("doc_id", self._probability(F.col("difference")).alias("score"))
                .withColumn("predicted", (F.col("score") >= threshold).cast("int")))

    def keep(self, docs: DataFrame, threshold: float = 0.3) -> DataFrame:
        """The rows of docs that score ``threshold`` or more, all columns as they are; nothing is shuffled."""
        sizes = (self.bad, self.good)

        @F.arrow_udf("double")
        def difference(texts: pa.Array) -> pa.Array:
            bad, good = _kept_sizes(*sizes)
            return pa.array([_difference(bad, good, memoryview(t.as_buffer()) if t.is_valid else b"") for t in texts], pa.float64())

        return docs.where(self._probability(difference("text")) >= threshold)


def _platt(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Logistic regression on one feature with smoothed targets (Newton steps on the standardised feature)."""
    if not len(x) or y.min() == y.max():
        return 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, s = float(np.median(x)), float(x.std()) or 1.0
    z, p, n = (x - m) / s, y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (p + 1) / (p + 2), 1 / (n + 2))
    a, b = 1.0, 0.0

    def loss(a, b):
        u = a * z + b
        return float(np.sum(np.logaddexp(0, u) - t * u))
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -500, 500)))
        w = q * (1 - q) + 1e-9
        g = np.array([np.sum((q - t) * z), np.sum(q - t)])
        h = np.array([[np.sum(w * z * z) + 1e-6, np.sum(w * z)], [np.sum(w * z), np.sum(w) + 1e-6]])
        step, f = np.linalg.solve(h, g), 1.0
        while f > 1e-6 and loss(a - f * step[0], b - f * step[1]) > loss(a, b):
            f /= 2
        a, b = a - f * step[0], b - f * step[1]
        if np.abs(step).max() * f < 1e-9:
            break
    return a / s, b - a * m / s


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, calibration_rows: int = 4000,
        max_chars: int = 8_000_000) -> CompressionModel:
    """labels (doc_id, quality 0/1, …). Rows with a null label or id, held-out rows and labels without a document
    are not used; of rows that repeat a doc_id one counts. With one class or none the score is its smoothed share."""
    spark = docs.sparkSession
    known = (labels.where("doc_id is not null and quality in (0, 1)").where(~held_out())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
             .withColumn("h", F.xxhash64("doc_id")))
    part = F.when(F.pmod("h", F.lit(2)) == 0, F.concat(F.lit("dictionary"), F.col("quality"))).otherwise("calibration")
    picks = []
    for name, n in (("dictionary0", per_class), ("dictionary1", per_class), ("calibration", calibration_rows)):
        picks += known.where(part == name).orderBy(F.xxhash64("h"), "doc_id").limit(n).withColumn("part", F.lit(name)).collect()
    chosen = spark.createDataFrame(picks, "doc_id long, quality int, h long, part string")
    # a few thousand rows at most, so the broadcast is bounded; texts that alone take an eighth of the bound stay out of
    # the sample, or one of them would push all later rows over it
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
            .groupBy("doc_id", "quality", "h", "part").agg(F.max("text").alias("text")).where(F.length("text") <= max_chars // 8)
            .withColumn("upto", F.sum(F.length("text")).over(Window.partitionBy("part").orderBy(F.xxhash64("h"), "doc_id")))
            .where(F.col("upto") <= max_chars))
    got = rows.where("text is not null").orderBy("doc_id").toPandas()
    model = CompressionModel(*(build_dictionary(list(got.text[got.part == f"dictionary{q}"])) for q in (0, 1)))
    cal = got[got.part == "calibration"]
    b, g = _sizes(model.bad), _sizes(model.good)
    x = np.array([_difference(b, g, t.encode()) for t in cal.text])
    model.slope, model.offset = _platt(x, cal.quality.to_numpy(float))
    return model


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fit_args) -> DataFrame:
    """Fit on the labels and score every row of docs: doc_id, held_out, score, predicted."""
    scored = fit(docs, labels, **fit_args).score(docs, threshold)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
