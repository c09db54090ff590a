"""Project catalog operators as batch DataFrame jobs.

The reference applies these to one document per HTTP request; here each is a relational operator over a whole
table (many projects, many patches, many runs at once).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hide_columns(df: DataFrame, columns: tuple[str, ...] = ("password",)) -> DataFrame:
    """Every column but the hidden ones (pruned at the scan by Catalyst)."""
    return df.drop(*[c for c in columns if c in df.columns])


def with_string_id(df: DataFrame, source: str = "_id", target: str = "id") -> DataFrame:
    """Rename the id column and make it text."""
    return df.withColumn(target, F.col(source).cast("string")).drop(source) if source != target else \
        df.withColumn(target, F.col(source).cast("string"))


def visible(df: DataFrame, role: str, starred: str = "starred") -> DataFrame:
    """Admins see every row, other roles only starred ones; a missing flag counts as false.
    The predicate reaches the Parquet scan as a pushed filter."""
    if role == "admin":
        return df
    return df.where(F.col(starred))  # WHERE drops a NULL flag by itself, and the plain column is pushed down


def search(df: DataFrame, term: str | None, column: str = "name") -> DataFrame:
    """P10: case-insensitive literal substring match; an empty term keeps all rows."""
    if not term:
        return df
    return df.where(F.lower(F.col(column)).contains(term.lower()))


def patch(base: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Batch partial update — for each key in ``changes`` non-NULL fields replace the base values; other rows pass
    unchanged, and no base row is repeated. Several changes of one key are merged field by field first: the last
    non-NULL value by ``order`` (ties, and changes without ``order``: the greatest value). Keys of ``changes`` that the
    base lacks, and NULL keys, change nothing."""
    change_cols = [c for c in changes.columns if c not in (key, order) and c in base.columns]
    if not change_cols:
        return base

    def last(c):
        value = F.col(f"`{c}`")
        when = F.struct(F.col(f"`{order}`").alias("o"), value.alias("v")) if order else F.struct(value.alias("v"))
        return F.max(F.when(value.isNotNull(), when))["v"].alias(f"__new_{c}")

    merged = changes.groupBy(key).agg(*[last(c) for c in change_cols])
    joined = base.join(merged, key, "left")
    return joined.select(*[
        (F.coalesce(F.col(f"__new_{c}"), F.col(c)).cast(base.schema[c].dataType).alias(c) if c in change_cols
         else F.col(c)) for c in base.columns])


def split_by(df: DataFrame, column: str, values: list[str]) -> dict[str | None, DataFrame]:
    """One table per value of ``column`` (the column dropped), plus the rows where it is NULL under key
    ``None``. Each output is a filter of the same scan; write them with one pass each."""
    out: dict[str | None, DataFrame] = {v: df.where(F.col(column) == F.lit(v)).drop(column) for v in values}
    out[None] = df.where(F.col(column).isNull())
    return out


def column_order(numeric: list[str], others: list[str]) -> list[str]:
    """R2: numeric columns first, then the rest, without duplicates (schema work, no job)."""
    return list(dict.fromkeys(list(numeric) + list(others)))


RUN_LOG_SCHEMA = T.StructType([
    T.StructField("project", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("status", T.StringType()),
    T.StructField("statement", T.StringType()),
    T.StructField("technique", T.StringType()),
    T.StructField("config", T.MapType(T.StringType(), T.StringType())),
    T.StructField("result", T.StringType()),
])


def log_run(spark, path: str, project: str, technique: str, statement: str = "", config: dict | None = None,
            result: str = "", status: str = "ok") -> None:
    """L1/L2: append one run (with its settings) to the Parquet run log; the reference overwrote it."""
    row = [(project, None, status, statement, technique, {k: str(v) for k, v in (config or {}).items()}, result)]
    df = spark.createDataFrame(row, RUN_LOG_SCHEMA).withColumn("ts", F.current_timestamp())
    df.write.mode("append").parquet(path)


def clear_results(spark, path: str, project: str) -> None:
    """L3: mark the project's results cleared (an appended marker; statement, technique and settings stay)."""
    log_run(spark, path, project, technique="", status="cleared")


def restart_project(spark, path: str, project: str) -> None:
    """L3: a full restart: results and settings are gone from then on (an appended marker; history stays)."""
    log_run(spark, path, project, technique="", status="restarted")


def latest_runs(log: DataFrame, project: str = "project", ts: str = "ts", order: list[str] | None = None,
                result: tuple[str, ...] = ("result",)) -> DataFrame:
    """L1: the latest run per project, as an aggregate (``max_by`` ordered by the time, then ``order``'s
    tie-breakers), so a project with a third of all runs is combined map-side instead of sorted in one task.
    In a log with a ``status``: after a ``cleared`` marker the latest run comes back with its ``result`` columns
    NULL and its settings kept; after a ``restarted`` marker the project has no run until the next one."""
    order = order or [ts]
    rest = [c for c in log.columns if c not in [project] + order]
    row, at = F.struct(*order, *rest), F.struct(*order)
    if "status" not in log.columns:
        best = log.groupBy(project).agg(F.max_by(row, at).alias("__r"))
        return best.select(project, *[F.col(f"__r.{c}").alias(c) for c in order + rest])
    run = F.col("status") != F.lit("cleared")
    best = log.groupBy(project).agg(F.max_by(F.when(run, row), F.when(run, at)).alias("__r"),
                                    F.max_by("status", at).alias("__last"))
    cleared = F.col("__last") == F.lit("cleared")
    return (best.where(F.col("__r").isNotNull() & (F.col("__r.status") != F.lit("restarted")))
            .select(project, *[F.when(~cleared, F.col(f"__r.{c}")).alias(c) if c in result else
                               F.coalesce(F.when(cleared, F.col("__last")), F.col("__r.status")).alias(c) if c == "status"
                               else F.col(f"__r.{c}").alias(c) for c in order + rest]))


def restore_config(log: DataFrame, project: str) -> DataFrame:
    """L2: statement, technique and settings of the project's latest run, whether its results were cleared or not."""
    return latest_runs(log.where(F.col("project") == project)).select("project", "statement", "technique", "config")
