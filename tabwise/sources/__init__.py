"""Sources and sinks (S1–S10): CSV / JSON / delimited text / Parquet readers, missing-token clean-up, keys, writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import nan_to_null

# Text that means "missing" in uploaded files (compared after trimming, case-insensitive).
MISSING_TOKENS = ["", "na", "n/a", "nan", "null", "none", "-", "?"]

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the test set. Filters and projections applied later reach the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    """Delimited text. Every column is read as text, missing tokens become NULL, then each column
    gets the narrowest type all its values cast to (long, double, boolean, else string).

    Spark's own inference keeps ``NA``/``NaN`` as text and so turns a whole numeric column into a string;
    doing the clean-up first and inferring after fixes that. Inference is one aggregate pass.
    """
    raw = spark.read.option("header", header).option("sep", sep).option("inferSchema", False).csv(path)
    return infer_types(normalise_missing(raw))


def read_json(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """JSON lines, or one JSON array per file (``multiline=True``). Missing tokens become NULL and text columns
    are typed again, so ``1, "NA", 3`` is a numeric column."""
    reader = spark.read
    if multiline is None:
        multiline = _looks_like_array(spark, path)
    if multiline:
        reader = reader.option("multiLine", True)
    return infer_types(normalise_missing(reader.json(path)))


def _looks_like_array(spark: SparkSession, path: str) -> bool:
    first = spark.read.text(path).limit(1).collect()
    return bool(first) and first[0][0].lstrip().startswith("[")


def read_any(spark: SparkSession, path: str, **kw) -> DataFrame:
    low = path.lower()
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    if low.endswith(".json"):
        return read_json(spark, path, **kw)
    if low.endswith(".txt") or low.endswith(".tsv"):
        return read_csv(spark, path, sep=kw.get("sep", "\t"))
    return read_csv(spark, path, **kw)


def normalise_missing(df: DataFrame, tokens: list[str] = MISSING_TOKENS) -> DataFrame:
    """Missing tokens in text columns → NULL; NaN in float columns → NULL; booleans → 0/1 ints."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(F.lower(F.trim(c)).isin(tokens), F.lit(None)).otherwise(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = nan_to_null(c)
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def infer_types(df: DataFrame) -> DataFrame:
    """Give each text column the narrowest of long / double / boolean that all its non-NULL values cast to. Only
    ``true`` and ``false`` are booleans: yes/no, y/n and t/f columns stay text.

    One aggregate pass computes, for every column, whether any value fails each cast.
    """
    text_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text_cols:
        return df
    checks = []
    for name in text_cols:
        c = F.trim(F.col(f"`{name}`"))
        for kind in ("bigint", "double", "boolean"):
            bad = (~F.lower(c).isin("true", "false") if kind == "boolean"
                   else c.isNotNull() & F.expr(f"try_cast(trim(`{name}`) AS {kind})").isNull())
            checks.append(F.max(bad.cast("int")).alias(f"{name}\u0001{kind}"))
    flags = df.agg(*checks).first().asDict()
    cols = []
    for f in df.schema.fields:
        name = f.name
        if name not in text_cols:
            cols.append(F.col(f"`{name}`"))
            continue
        chosen = None
        for kind in ("bigint", "double", "boolean"):
            if not flags.get(f"{name}\u0001{kind}"):
                chosen = kind
                break
        if chosen is None:
            cols.append(F.col(f"`{name}`"))
        elif chosen == "boolean":
            cols.append(F.expr(f"try_cast(trim(`{name}`) AS boolean)").cast("int").alias(name))
        else:
            cols.append(F.expr(f"try_cast(trim(`{name}`) AS {chosen})").alias(name))
    return df.select(*cols)


def parse_json_inputs(df: DataFrame, column: str, schema: str | T.StructType, keep: list[str] | None = None):
    """parse one JSON object per row (``{"col": value}``) into typed columns. Returns (parsed, rejected):
    rows whose text is not a JSON object come back in ``rejected`` with their original text instead of
    failing the whole batch; fields missing from an object are NULL (later filled by the fitted model)."""
    keep = keep or []
    st = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    parsed = df.select(*keep, F.col(column), F.from_json(F.col(column), st).alias("__j"))
    ok = F.col("__j").isNotNull() & F.col(column).rlike(r"^\s*\{")
    good = parsed.where(ok).select(*keep, *[F.col(f"__j.`{f.name}`").alias(f.name) for f in st.fields])
    bad = parsed.where(~ok | F.col(column).isNull()).select(*keep, F.col(column))
    return good, bad


def add_key(df: DataFrame, name: str = "row_key") -> DataFrame:
    """Give a keyless table a unique long key. ``monotonically_increasing_id`` is unique and needs no
    shuffle; it is stable for a fixed input split, so write the keyed table out once (``write_table``)
    before using the key across jobs."""
    return df.select(F.monotonically_increasing_id().alias(name), "*")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with a header; many part files, written in parallel."""
    df.write.mode(mode).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Replace (or append) a stored dataset as Parquet."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def manifest(df: DataFrame) -> DataFrame:
    """Dataset manifest — one row per input file with its size and the load time."""
    return (df.select(F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_size").alias("file_size"))
            .groupBy("file_name").agg(F.max("file_size").alias("file_size"), F.count(F.lit(1)).alias("n_rows"))
            .withColumn("loaded_at", F.current_timestamp()))
