"""Column profile (G1–G6, G20) and the one-row data summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import round_half_up
from .stats import value_counts

PROFILE_SCHEMA = T.StructType([
    T.StructField("position", T.IntegerType()),
    T.StructField("column", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("values", T.ArrayType(T.StringType())),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("mean", T.DoubleType()),
])


def is_text_type(dt) -> bool:
    """Columns profiled as text/categorical: strings, and (our choice) dates/timestamps via their string form."""
    return isinstance(dt, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))


def is_numeric_type(dt) -> bool:
    return isinstance(dt, (T.NumericType, T.BooleanType))


def as_profile_input(df: DataFrame) -> DataFrame:
    """Booleans count as 0/1 numbers, dates and timestamps as text; NaN is treated as missing."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(F.isnan(c), None).otherwise(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def profile(df: DataFrame, max_values: int = 50, digits: int = 3) -> DataFrame:
    """One row per column: numeric → min/max/mean (rounded); text with ≤ ``max_values`` distinct non-missing
    values → ``categorical`` with the sorted values; more → ``text`` with an empty list.

    Two jobs whatever the width: one aggregate for all numeric statistics and distinct estimates, one bounded
    grouped count for the low-cardinality text columns. Results have columns × 50 values at most.
    """
    data = as_profile_input(df)
    fields = data.schema.fields
    numeric = [f.name for f in fields if is_numeric_type(f.dataType)]
    text = [f.name for f in fields if not is_numeric_type(f.dataType)]
    stats = {}
    if numeric:
        aggs = []
        for i, c in enumerate(numeric):
            x = F.col(f"`{c}`").cast("double")
            aggs += [F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"), F.avg(x).alias(f"av{i}")]
        row = data.agg(*aggs).first()
        stats = {c: (row[f"mn{i}"], row[f"mx{i}"], row[f"av{i}"]) for i, c in enumerate(numeric)}
    counts = value_counts(data, text, max_values)
    spark = df.sparkSession
    rows = []
    for pos, f in enumerate(fields):
        if f.name in stats:
            mn, mx, av = stats[f.name]
            rows.append((pos, f.name, "numeric", None, mn, mx, av))
        else:
            vals = counts.get(f.name)
            if vals is None:
                rows.append((pos, f.name, "text", [], None, None, None))
            else:
                rows.append((pos, f.name, "categorical", [v for v, _ in vals], None, None, None))
    out = spark.createDataFrame(rows, PROFILE_SCHEMA)
    return out.select("position", "column", "type", "values",
                      *[round_half_up(c, digits).alias(c) for c in ("min", "max", "mean")])


def missing_report(df: DataFrame, max_missing: float = 0.8) -> DataFrame:
    """G6 + P4: share of missing values per column, and whether the preprocessing drops it (share > limit)."""
    data = as_profile_input(df)
    names = data.columns
    row = data.agg(F.count(F.lit(1)).alias("n"),
                   *[F.count(F.col(f"`{c}`")).alias(f"k{i}") for i, c in enumerate(names)]).first()
    n = row["n"]
    rows = []
    for i, c in enumerate(names):
        share = (n - row[f"k{i}"]) / n if n else 0.0
        rows.append((i, c, int(n - row[f"k{i}"]), float(share), bool(share > max_missing)))
    schema = "position int, column string, n_missing long, missing_share double, dropped boolean"
    return df.sparkSession.createDataFrame(rows, schema)


def is_empty(df: DataFrame) -> bool:
    """Stops at the first row found."""
    return df.isEmpty()


def summary(df: DataFrame, statement: str | None = None, target: str | None = None,
            max_values: int = 50) -> DataFrame:
    """One row — rows, columns, numeric columns, text columns, likely target."""
    from .target import choose_target

    prof = profile(df, max_values).select("column", "type").collect()
    numeric = [r["column"] for r in prof if r["type"] == "numeric"]
    text = [r["column"] for r in prof if r["type"] == "text"]
    tgt = choose_target(df.columns, statement or "", target)
    n = df.count()
    return df.sparkSession.createDataFrame(
        [(n, len(df.columns), len(numeric), len(text), tgt)],
        "n_rows long, n_columns int, n_numeric int, n_text int, target string")
