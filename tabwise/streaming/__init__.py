"""Scoring on Structured Streaming sources.

The reference has no streams. What carries over for free: a fitted scorer whose ``score``/``transform`` is a
pure projection (preprocessing fills and codes, scaling, K-Means assignment, ridge prediction, isolation-forest
scoring via ``mapInPandas``) runs unchanged on a streaming DataFrame. Scorers that need whole-table jobs
(kNN and DBSCAN neighbour searches) are batch-only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A file source (new files in ``path`` become new rows); the schema is declared, never inferred."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def score_stream(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a projection-only scorer (e.g. ``kmeans_model.assign_rows``) to a streaming DataFrame."""
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame")
    return scorer(stream)


def write_scores(scored: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append scored rows to a Parquet table; the checkpoint location makes restarts exactly-once."""
    w = scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    w = w.trigger(availableNow=True) if once else w
    return w.start()
