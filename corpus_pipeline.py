"""Corpus pipeline: five stages over ``documents``, each a Spark job over all that its predecessor kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.llm import bpe, decontam, minhash, pii, quality
from tabwise.llm.common import table
from tabwise.session import checkpoint_dir, cut_lineage


def _short_batches(spark: SparkSession) -> None:
    """Whole texts pass to the Python workers in Arrow batches of 2,000 rows at most, in this session from here on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= 2000:
        spark.conf.set(name, "2000")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    _short_batches(spark)
    return quality.fit(docs, table(spark, sf_dir, "labels")).keep(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each group stays, the one with the least id; where ids are null or repeat,
    rows are numbered and the first one stays."""
    _short_batches(spark)
    ids = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    key = "doc_id" if ids.isEmpty() else "__row"
    rows = docs if key == "doc_id" else cut_lineage(docs.withColumn("__row", F.monotonically_increasing_id()))
    gone = minhash.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text")).where(~F.col("kept")).select(F.col("doc_id").alias(key))
    return rows.join(gone, key, "left_anti").select(docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: documents that overlap a benchmark text go."""
    _short_batches(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data: spans are replaced in the text, the character count follows."""
    _short_batches(spark)
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ids of every text, with digests of the ids and of the bytes decoded from them."""
    _short_batches(spark)
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", keep_good), ("minhash", keep_one_of_each), ("decontaminate", drop_benchmark), ("pii", sanitise), ("bpe", tokenise)]

# model fitting, MinHash grouping and tokenisation are beyond SQL; tests compare run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written under the shared checkpoint folder and read again.

    Null and empty texts pass the filters that judge them clean and have no tokens (decoded: the empty text); equal rows,
    and rows with null or repeated ids, are judged row by row; other columns pass through; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
