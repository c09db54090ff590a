"""Column-level helpers. Everything here builds JVM-side Catalyst expressions (no Python UDFs)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c, digits: int = 3) -> Column:
    """Round half up on the binary value: floor(x * 10^d + 0.5) / 10^d.

    Written this way (instead of ``F.round``) so Spark and any SQL engine compute the identical double.
    """
    scale = float(10 ** digits)
    return (F.floor(_c(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).cast("double")


def sql_round(expr: str, digits: int = 3) -> str:
    """The SQL text of :func:`round_half_up`."""
    scale = f"{10 ** digits:.1f}"
    return f"CAST(floor(({expr}) * {scale} + 0.5) / {scale} AS DOUBLE)"


def nan_to_null(c) -> Column:
    """NaN is not NULL in Spark; one NaN poisons avg/max/median, so map it to NULL first."""
    col = _c(c)
    return F.when(F.isnan(col), F.lit(None)).otherwise(col)


def safe_scale(std) -> Column:
    """Zero or missing standard deviation scales by 1 (a constant column standardises to 0)."""
    s = _c(std)
    return F.when(s.isNull() | (s == 0), F.lit(1.0)).otherwise(s)


def squared_distance(a: list, b: list) -> Column:
    """Sum of squared differences between two equally long lists of columns/literals."""
    diffs = [_c(x) - (y if isinstance(y, Column) else F.lit(float(y))) for x, y in zip(a, b)]
    terms = [d * d for d in diffs]
    return reduce(lambda p, q: p + q, terms)


def argmin(values: list) -> Column:
    """0-based index of the smallest column in ``values``; ties go to the lower index."""
    arr = F.array(*values)
    return (F.array_position(arr, F.array_min(arr)) - 1).cast("int")


TOKEN_SPLIT = "[^A-Za-z0-9]+"


def token_rows(df, key: str, text: str, key_alias: str = "k", token_alias: str = "t"):
    """One row per token occurrence: (key, token). The whole text is tokenised (never a prefix); splitting on
    non-ASCII-alphanumerics before lower-casing keeps tokens identical across engines whose Unicode case maps
    differ. Split → explode → filter → lower stays inside whole-stage code generation."""
    raw = df.select(F.col(key).alias(key_alias), F.explode(F.split(F.col(text), TOKEN_SPLIT)).alias("__raw"))
    return raw.where(F.col("__raw") != F.lit("")).select(key_alias, F.lower(F.col("__raw")).alias(token_alias))


def parse_feature_list(text: str | None) -> list[str] | None:
    """A comma list of column names, trimmed, blanks dropped; empty → None (meaning all numeric)."""
    names = [t.strip() for t in (text or "").split(",") if t.strip()]
    return names or None


def statement_fallback(arg, stored) -> Column:
    """the given statement unless blank, else the stored one, else the empty string."""
    return F.coalesce(F.nullif(F.trim(_c(arg)), F.lit("")), _c(stored), F.lit(""))
