"""Shared preprocessing.

Rules: drop columns with more than 80 % missing; fill numeric with the median and categorical with the mode;
label-encode text columns with at most 50 distinct values (sorted order → 0…n-1); drop text columns with more.
Every row is kept. Fitting costs a fixed number of aggregate passes; the fitted state is columns × 50 values,
and ``transform`` is a single projection (no shuffle, whole-stage codegen).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import safe_scale
from .profile import as_profile_input, is_numeric_type
from .stats import exact_medians, mean_std, mode_of, value_counts


@dataclass
class PrepModel:
    key: str | None
    columns: list[str]                      # kept columns, original order (key excluded)
    numeric: list[str]                      # kept numeric columns
    categories: dict[str, list[str]]        # kept categorical column → sorted values (code = index)
    fills: dict[str, object]                # column → median (numeric) or mode (categorical)
    dropped: dict[str, str] = field(default_factory=dict)  # column → reason
    missing_share: dict[str, float] = field(default_factory=dict)

    @property
    def feature_cols(self) -> list[str]:
        """Numeric columns of the cleaned table — encoded categoricals count as numeric."""
        return list(self.columns)

    def column_lists(self, df: DataFrame) -> dict[str, list[str]]:
        """Original columns, cleaned columns, numeric columns of the cleaned table (schema only, no job)."""
        original = [c for c in df.columns if c != self.key]
        return {"all_cols": original, "clean_cols": list(self.columns), "numeric_cols": list(self.columns)}

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Cleaned table: key, then kept columns as doubles (categoricals as codes). Unseen categories in new
        data get the median code (F10); blank numeric fields get the median (F11). A column the input does not
        have at all (e.g. the target when scoring) counts as blank in every row."""
        data = as_profile_input(df)
        present = set(data.columns)
        out = []
        if self.key:
            out.append(F.col(f"`{self.key}`"))
        for k in keep or []:
            if k != self.key:
                out.append(F.col(f"`{k}`"))
        for c in self.columns:
            x = F.col(f"`{c}`") if c in present else F.lit(None).cast("string" if c in self.categories else "double")
            if c in self.categories:
                values = self.categories[c]
                filled = F.coalesce(x.cast("string"), F.lit(self.fills[c]))
                pos = F.array_position(F.array(*[F.lit(v) for v in values]), filled)
                median_code = float(int((len(values) - 1) / 2))
                out.append(F.when(pos > 0, (pos - 1).cast("double")).otherwise(F.lit(median_code)).alias(c))
            else:
                fill = self.fills.get(c)
                xd = x.cast("double")
                out.append((F.coalesce(xd, F.lit(fill)) if fill is not None else xd).alias(c))
        return data.select(*out)

    def filled_list(self, df: DataFrame, cols: list[str] | None = None):
        """array of the column names that were blank in each input row (and got the fill value)."""
        cols = cols or self.columns
        kinds = dict(df.dtypes)

        def blank(c):  # what ``transform`` fills: NULL, NaN, and a column that is not there
            if c not in kinds:
                return F.lit(True)
            x = F.col(f"`{c}`")
            return x.isNull() | F.isnan(x) if kinds[c] in ("float", "double") else x.isNull()
        return F.array_compact(F.array(*[F.when(blank(c), F.lit(c)) for c in cols]))

    def fills_table(self, spark: SparkSession) -> DataFrame:
        rows = []
        for c in self.columns:
            if c in self.categories:
                rows.append((c, "mode", str(self.fills[c]), None))
            else:
                v = self.fills.get(c)
                rows.append((c, "median", None if v is None else repr(float(v)), None if v is None else float(v)))
        return spark.createDataFrame(rows, "column string, kind string, fill string, fill_num double")

    def encodings_table(self, spark: SparkSession) -> DataFrame:
        rows = [(c, v, i) for c, vals in self.categories.items() for i, v in enumerate(vals)]
        return spark.createDataFrame(rows, "column string, value string, code int")


def fit_prep(df: DataFrame, key: str | None = None, max_missing: float = 0.8, max_categories: int = 50,
             exact: bool = True, columns: list[str] | None = None) -> PrepModel:
    data = as_profile_input(df)
    names = [c for c in (columns or data.columns) if c != key]
    types = {f.name: f.dataType for f in data.schema.fields}
    text = [c for c in names if not is_numeric_type(types[c])]
    # pass 1: missing counts for all, distinct estimates for text
    row = data.agg(F.count(F.lit(1)).alias("n"),
                   *[F.count(F.col(f"`{c}`")).alias(f"k{i}") for i, c in enumerate(names)],
                   *[F.approx_count_distinct(F.col(f"`{c}`"), 0.05).alias(f"d{i}") for i, c in enumerate(text)]
                   ).first()
    n = row["n"]
    share = {c: ((n - row[f"k{i}"]) / n if n else 0.0) for i, c in enumerate(names)}
    dropped = {c: "missing" for c in names if share[c] > max_missing}
    kept = [c for c in names if c not in dropped]
    est = {c: row[f"d{i}"] for i, c in enumerate(text) if c in kept}
    # pass 2: bounded value counts of low-cardinality text columns
    counts = value_counts(data, [c for c in text if c in kept], max_categories, estimates=est)
    categories, fills = {}, {}
    for c in text:
        if c not in kept:
            continue
        if counts.get(c) is None:
            dropped[c] = "text"
        else:
            categories[c] = [v for v, _ in counts[c]]
            fills[c] = mode_of(counts[c])
    numeric = [c for c in kept if c not in text]
    # pass 3+: exact medians by bounded selection
    fills.update(exact_medians(data, numeric, approximate=not exact))
    columns = [c for c in kept if c not in dropped]
    return PrepModel(key=key, columns=columns, numeric=numeric, categories=categories, fills=fills,
                     dropped=dropped, missing_share=share)


@dataclass
class Scaler:
    """(x − mean) / population std; a zero std scales by 1. Not Spark ML's StandardScaler, which divides
    by the sample std."""
    means: dict[str, float]
    stds: dict[str, float]

    @property
    def cols(self) -> list[str]:
        return list(self.means)

    def expr(self, c: str, source=None):
        x = (source if source is not None else F.col(f"`{c}`")).cast("double")
        mean = self.means[c] if self.means[c] is not None else 0.0
        std = self.stds[c] if self.stds[c] not in (None, 0.0) else 1.0
        return (F.coalesce(x, F.lit(mean)) - F.lit(mean)) / F.lit(std)

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        keep = [k for k in (keep or []) if k not in self.means]
        return df.select(*[F.col(f"`{k}`") for k in keep], *[self.expr(c).alias(c) for c in self.cols])


def fit_scaler(df: DataFrame, cols: list[str]) -> Scaler:
    ms = mean_std(df, cols)
    return Scaler({c: ms[c][0] for c in cols}, {c: ms[c][1] for c in cols})
