"""Model metrics as single aggregates (G14, G15, G18, confusion counts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _c(c):
    return F.col(f"`{c}`") if isinstance(c, str) else c


def regression_metrics(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """R², MAE, RMSE, n in one pass. R² uses the rows' own mean (``var_pop`` is numerically stable)."""
    y, p = _c(label).cast("double"), _c(prediction).cast("double")
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum((y - p) ** 2).alias("sse"), F.avg(F.abs(y - p)).alias("mae"),
               F.var_pop(y).alias("vy"))
    r2 = F.lit(1.0) - F.col("sse") / F.when(F.col("vy") * F.col("n") == 0, None).otherwise(F.col("vy") * F.col("n"))
    wide = r.select(r2.alias("r2"), F.col("mae"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
                    F.col("n").cast("double").alias("n"))
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("r2", "mae", "rmse", "n")
    ])).alias("m")).select("m.metric", "m.value")


def accuracy(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Share of rows whose prediction equals the label."""
    return df.agg(F.avg((_c(label) == _c(prediction)).cast("double")).alias("accuracy"),
                  F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Confusion counts: (label, prediction, count). Map-side combined, output bounded by classes²."""
    return df.groupBy(_c(label).alias("label"), _c(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("count"))


def classification_metrics(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Accuracy plus per-class precision / recall from one confusion pass (bounded by classes²)."""
    conf = confusion(df, label, prediction)
    tot = conf.agg(F.sum("count").alias("n"),
                   F.sum(F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0)).alias("hit"))
    return tot.select(F.lit("accuracy").alias("metric"), (F.col("hit") / F.col("n")).alias("value"))
