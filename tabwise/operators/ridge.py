"""M2 ridge regression on standardised features (+ G15 metrics, P12 sample, O3 contributions, V1 scoring).

Fit = one aggregate pass of centred moments over the training rows (p² ``covar_pop`` sums, combined map-side),
then a p×p solve on the driver: w = (Szz + αI)⁻¹ Szy, b = ȳ − z̄ᵀw — exactly the penalised least squares of
ridge with an unpenalised intercept. Prediction and contributions are plain column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import round_half_up
from .evaluate import regression_metrics
from .prep import PrepModel, Scaler, fit_prep, fit_scaler
from .stats import centered_moments, fold_of


@dataclass
class RidgeModel:
    key: str
    target: str
    features: list[str]
    scaler: Scaler
    coef: np.ndarray
    intercept: float
    prep: PrepModel | None
    test: DataFrame            # scaled test rows: key, features (z), target, prediction
    alpha: float

    def _pred_expr(self):
        terms = [F.col(f"`{f}`") * F.lit(float(w)) for f, w in zip(self.features, self.coef)]
        return reduce(lambda a, b: a + b, terms, F.lit(float(self.intercept)))

    @property
    def coefficients(self) -> DataFrame:
        spark = self.test.sparkSession
        rows = [(f, float(w)) for f, w in zip(self.features, self.coef)] + [("(intercept)", float(self.intercept))]
        return spark.createDataFrame(rows, "feature string, coefficient double")

    @property
    def metrics(self) -> DataFrame:
        return regression_metrics(self.test, self.target, "prediction")

    def sample(self, n: int = 20) -> DataFrame:
        """First ``n`` test rows by key with actual, predicted and absolute error (3 decimals)."""
        return (self.test.orderBy(self.key).limit(n)
                .select(self.key, F.col(f"`{self.target}`").alias("actual"), F.col("prediction").alias("predicted"),
                        round_half_up(F.abs(F.col(f"`{self.target}`") - F.col("prediction")), 3).alias("abs_error")))

    def _scaled(self, df: DataFrame) -> DataFrame:
        data = self.prep.transform(df) if self.prep is not None else df
        return self.scaler.transform(data, keep=[self.key])

    def predict(self, df: DataFrame) -> DataFrame:
        """V1 (value) + F11: a table of inputs in, (key, prediction, missing_filled) out. Blank fields take the
        fitted fill value and are listed in ``missing_filled``. One projection, no join."""
        if self.prep is None:
            return self._scaled(df).select(self.key, self._pred_expr().alias("prediction"))
        marked = df.select("*", self.prep.filled_list(df, self.features).alias("__filled"))
        data = self.prep.transform(marked, keep=["__filled"])
        z = self.scaler.transform(data, keep=[self.key, "__filled"])
        return z.select(self.key, self._pred_expr().alias("prediction"), F.col("__filled").alias("missing_filled"))

    def contributions(self, df: DataFrame, n: int = 5) -> DataFrame:
        """O3: signed coefficient × z per feature, the ``n`` largest by magnitude per row (key, feature,
        contribution, rank). Exploding p features per row is bounded by p; the rank is an array sort, no
        window and no shuffle."""
        z = self._scaled(df)
        items = F.array(*[F.struct(F.abs(F.col(f"`{f}`") * F.lit(float(w))).alias("mag"),
                                   F.lit(f).alias("feature"),
                                   (F.col(f"`{f}`") * F.lit(float(w))).alias("contribution"))
                          for f, w in zip(self.features, self.coef)])
        ranked = F.sort_array(items, asc=False)
        top = F.slice(ranked, 1, n)
        return (z.select(self.key, F.posexplode(top).alias("pos", "c"))
                .select(self.key, "c.feature", "c.contribution", (F.col("pos") + 1).alias("rank")))


def solve_ridge(n: int, means: np.ndarray, cov: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Closed form on centred moments; the last entry of ``means``/``cov`` is the target."""
    p = len(means) - 1
    szz = cov[:p, :p] * n
    szy = cov[:p, p] * n
    w = np.linalg.solve(szz + alpha * np.eye(p), szy) if p else np.zeros(0)
    b = float(means[p] - means[:p] @ w)
    return w, b


def ridge(df: DataFrame, key: str, target: str, features: list[str] | None = None, alpha: float = 1.0,
          folds: int = 5, test_fold: int = 0, split_col: str | None = None, prep: bool = True) -> RidgeModel:
    """Ridge with α (default 1). Rows whose ``pmod(split_col or key, folds) == test_fold`` are held out
    (a grouped split when ``split_col`` is a group key); scaler statistics come from the whole table."""
    pm = None
    data = df
    if prep:
        pm = fit_prep(df, key=key, columns=[c for c in df.columns if c not in (key, split_col)])
        keep = [split_col] if split_col and split_col not in (key, target) else []
        data = pm.transform(df, keep=keep)
    feats = features or [c for c in (pm.columns if pm else df.columns) if c not in (key, target, split_col)]
    missing = [f for f in feats if f not in data.columns]
    if missing:
        raise ValueError(f"unknown feature columns: {missing}")
    scaler = fit_scaler(data, feats)
    keep = [key, target] + ([split_col] if split_col and split_col not in (key, target) else [])
    z = scaler.transform(data, keep=keep)
    fold = fold_of(split_col or key, folds, z)
    train = z.where(fold != F.lit(test_fold)) if folds else z
    test = z.where(fold == F.lit(test_fold)) if folds else z
    n, means, cov = centered_moments(train, feats + [target])
    w, b = solve_ridge(n, means, cov, alpha)
    model = RidgeModel(key=key, target=target, features=feats, scaler=scaler, coef=w, intercept=b,
                       prep=pm, test=test, alpha=alpha)
    model.test = test.withColumn("prediction", model._pred_expr())
    return model
