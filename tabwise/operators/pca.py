"""U3 PCA analysis and U4 PCA reduction (+ G12, G13, O5, S6).

The covariance of the standardised features is one aggregate pass (p² ``covar_pop`` sums); the p×p
eigen-decomposition runs on the driver; projecting rows onto components is a projection of linear
expressions (no vectors, no Python). Sign rule: each component's largest-magnitude loading is positive.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prep import PrepModel, Scaler
from .kmeans import standardized
from .stats import centered_moments


@dataclass
class PCAModel:
    key: str
    features: list[str]
    eigenvalues: np.ndarray
    components: np.ndarray    # rows = components, columns = features
    scaler: Scaler
    prep: PrepModel | None
    data: DataFrame
    n_rows: int
    cov: np.ndarray | None = None   # covariance of the standardised features (the correlation matrix)

    @property
    def covariance(self) -> DataFrame:
        spark = self.data.sparkSession
        rows = [(a, b, float(self.cov[i, j])) for i, a in enumerate(self.features) for j, b in enumerate(self.features)]
        return spark.createDataFrame(rows, "feature_a string, feature_b string, value double")

    @property
    def explained(self) -> np.ndarray:
        tot = float(np.sum(self.eigenvalues))
        return self.eigenvalues / tot if tot > 0 else np.zeros_like(self.eigenvalues)

    @property
    def variance(self) -> DataFrame:
        """G12/G13 scree table: (component, explained_pct, cumulative_pct); the running sum is a window over
        at most p rows."""
        spark = self.data.sparkSession
        rows = [(i + 1, float(v) * 100.0) for i, v in enumerate(self.explained)]
        df = spark.createDataFrame(rows, "component int, explained_pct double")
        w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("cumulative_pct", F.sum("explained_pct").over(w))

    @property
    def loadings(self) -> DataFrame:
        spark = self.data.sparkSession
        rows = [(i + 1, f, float(self.components[i, j])) for i in range(len(self.components))
                for j, f in enumerate(self.features)]
        return spark.createDataFrame(rows, "component int, feature string, loading double")

    def top_features(self, n: int = 3) -> DataFrame:
        """The ``n`` features with the largest |loading| per component."""
        w = Window.partitionBy("component").orderBy(F.desc(F.abs("loading")), "feature")
        return (self.loadings.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n))

    def projection(self, n: int):
        cols = [self.scaler.expr(f) for f in self.features]
        return [reduce(lambda a, b: a + b, [c * F.lit(float(w)) for c, w in zip(cols, self.components[i])])
                .alias(f"PC{i + 1}") for i in range(n)]

    def transform(self, df: DataFrame, n: int, keep: list[str] | None = None) -> DataFrame:
        data = self.prep.transform(df, keep=keep) if self.prep is not None else df
        front = [self.key] + [k for k in (keep or []) if k != self.key]
        return data.select(*front, *self.projection(n))

    def total_variance_pct(self, n: int) -> float:
        return float(np.sum(self.explained[:n]) * 100.0)


def pca(df: DataFrame, key: str, features: list[str] | None = None, prep: bool = True) -> PCAModel:
    pm, data, feats, scaler = standardized(df, key, features, prep)
    z = scaler.transform(data, keep=[])
    n, _means, cov = centered_moments(z, feats)
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1]
    vals = np.clip(vals[order], 0.0, None)
    comps = vecs[:, order].T
    for i in range(len(comps)):
        j = int(np.argmax(np.abs(comps[i])))
        if comps[i, j] < 0:
            comps[i] = -comps[i]
    return PCAModel(key=key, features=feats, eigenvalues=vals, components=comps, scaler=scaler, prep=pm,
                    data=data, n_rows=n, cov=cov)


def pca_reduce(df: DataFrame, key: str, n_components: int, features: list[str] | None = None,
               prep: bool = True, keep: list[str] | None = None):
    """U4: (key, kept columns, PC1…PCn) plus a one-row side table (n_components, total_variance_pct to 2
    decimals). Needs at least 3 numeric columns and 1 ≤ n ≤ min(columns, rows)."""
    model = pca(df, key, features, prep)
    p = len(model.features)
    if p < 3:
        raise ValueError(f"too few numeric columns for a reduction: {p}, three are the least")
    limit = min(p, model.n_rows)
    if n_components < 1 or n_components > limit:
        raise ValueError(f"asked for {n_components} components, possible are 1 to {limit}")
    out = model.transform(df, n_components, keep=keep)
    spark = df.sparkSession
    side = spark.createDataFrame([(n_components, round(model.total_variance_pct(n_components), 2))],
                                 "n_components int, total_variance_pct double")
    return out, side


def export_reduced(reduced: DataFrame, side: DataFrame, base_dir: str, project: str = "project") -> str:
    """Write the reduced table as CSV (header, no index) to ``pca_<n>components_<project>`` with spaces in
    the project name turned into ``_``, plus the one-row side table (component count, total variance to 2
    decimals) next to it. Returns the output path."""
    n = side.first()["n_components"]
    path = f"{base_dir.rstrip('/')}/pca_{n}components_{project.replace(' ', '_')}"
    reduced.write.mode("overwrite").option("header", True).csv(path)
    side.write.mode("overwrite").option("header", True).csv(path + "_summary")
    return path
