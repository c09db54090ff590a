"""U1 K-Means (+ G9 sizes, G10 averages, G16 silhouette, G17 elbow, V2 scoring).

Fitting (``kmeans_fit``) seeds by k-means|| with hashed draws and takes the Lloyd steps of the whole k = 2…8 elbow sweep
together, one pass over the standardised rows a step. Assignment and scoring are projections with the k×d centres as
literals (argmin over an array of squared distances): no shuffle, no Python. ``lloyd`` runs plain Lloyd steps
from given centres with one grouped average per step (k rows reach the driver) — the deterministic path.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import argmin, squared_distance
from .kmeans_fit import fit_rows, fit_sweep
from .prep import PrepModel, Scaler, fit_prep, fit_scaler


def assign_expr(features: list[str], centers: np.ndarray):
    """(cluster index, squared distance to it) for each row, as column expressions."""
    d2 = [squared_distance([F.col(f"`{f}`") for f in features], list(c)) for c in centers]
    return argmin(d2), F.array_min(F.array(*d2))


def distances_expr(features: list[str], centers: np.ndarray):
    """Array of Euclidean distances to every centre (V2)."""
    return F.array(*[F.sqrt(squared_distance([F.col(f"`{f}`") for f in features], list(c))) for c in centers])


def lloyd(z: DataFrame, features: list[str], centers: np.ndarray, iterations: int) -> np.ndarray:
    """Plain Lloyd iterations from the given centres. An empty cluster keeps its previous centre."""
    centers = np.array(centers, dtype=float)
    for _ in range(iterations):
        cl, _d = assign_expr(features, centers)
        rows = (z.select(cl.alias("cluster"), *[F.col(f"`{f}`") for f in features])
                .groupBy("cluster").agg(*[F.avg(f"`{f}`").alias(f) for f in features]).collect())
        new = centers.copy()
        for r in rows:
            new[r["cluster"]] = [r[f] for f in features]
        centers = new
    return centers


def elbow_k(ks: list[int], costs: list[float]) -> int:
    """Elbow = the k whose (k, cost) point lies farthest from the chord joining the first and last points
    (costs scaled to [0, 1] first)."""
    if len(ks) <= 2:
        return ks[0]
    x = np.array(ks, dtype=float)
    y = np.array(costs, dtype=float)
    x = (x - x.min()) / ((x.max() - x.min()) or 1.0)
    y = (y - y.min()) / ((y.max() - y.min()) or 1.0)
    p0, p1 = np.array([x[0], y[0]]), np.array([x[-1], y[-1]])
    d = p1 - p0
    norm = np.hypot(*d) or 1.0
    dist = np.abs(d[0] * (y - p0[1]) - d[1] * (x - p0[0])) / norm
    return int(ks[int(np.argmax(dist))])


@dataclass
class KMeansModel:
    key: str
    features: list[str]
    centers: np.ndarray          # in standardised units
    scaler: Scaler
    prep: PrepModel | None
    data: DataFrame              # cleaned (unscaled) table with key
    elbow_table: DataFrame | None = None
    k_source: str = "given"

    @property
    def k(self) -> int:
        return len(self.centers)

    def _z(self, df: DataFrame, cleaned: bool) -> DataFrame:
        data = df if cleaned or self.prep is None else self.prep.transform(df)
        return data.select("*", *[self.scaler.expr(f).alias(f"__z_{f}") for f in self.features])

    def _assign(self, df: DataFrame, cleaned: bool) -> DataFrame:
        z = self._z(df, cleaned)
        zf = [f"__z_{f}" for f in self.features]
        cl, d2 = assign_expr(zf, self.centers)
        return z.select("*", cl.alias("cluster"), F.sqrt(d2).alias("distance")).drop(*zf)

    @property
    def assign(self) -> DataFrame:
        """(key, cluster, distance to own centre) for every row."""
        return self._assign(self.data, True).select(self.key, "cluster", "distance")

    def assign_rows(self, df: DataFrame) -> DataFrame:
        """(key, cluster, distance) for new raw rows — a pure projection, so it also runs on streams."""
        return self._assign(df, False).select(self.key, "cluster", "distance")

    @property
    def sizes(self) -> DataFrame:
        """(cluster, size)."""
        return self._assign(self.data, True).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))

    @property
    def averages(self) -> DataFrame:
        """(cluster, size, avg_<feature>…) in the cleaned table's own units."""
        a = self._assign(self.data, True)
        return a.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"),
                                        *[F.avg(f"`{f}`").alias(f"avg_{f}") for f in self.features])

    @property
    def inertia(self) -> float:
        a = self._assign(self.data, True)
        return float(a.agg(F.sum(F.col("distance") * F.col("distance"))).first()[0])

    @property
    def silhouette(self) -> float:
        """Spark's ClusteringEvaluator silhouette (squared Euclidean distance, exact and O(n·k))."""
        from pyspark.ml.evaluation import ClusteringEvaluator
        from pyspark.ml.feature import VectorAssembler

        a = self._z(self.data, True)
        zf = [f"__z_{f}" for f in self.features]
        cl, _ = assign_expr(zf, self.centers)
        vec = VectorAssembler(inputCols=zf, outputCol="features").transform(a.select(*zf, cl.alias("prediction")))
        return float(ClusteringEvaluator(featuresCol="features", predictionCol="prediction",
                                         distanceMeasure="squaredEuclidean").evaluate(vec))

    @property
    def centers_table(self) -> DataFrame:
        spark = self.data.sparkSession
        rows = [(i, f, float(v)) for i, c in enumerate(self.centers) for f, v in zip(self.features, c)]
        return spark.createDataFrame(rows, "cluster int, feature string, center double")

    def score(self, df: DataFrame) -> DataFrame:
        """V2: for each input row, the assigned cluster and the distance to every centre
        (key, cluster, distance, assigned, missing_filled). Blank fields take the fitted fill values."""
        z = self._z(df, False)
        zf = [f"__z_{f}" for f in self.features]
        dist = distances_expr(zf, self.centers)
        cl, _ = assign_expr(zf, self.centers)
        out = z.select(self.key, cl.alias("assigned"), F.posexplode(dist).alias("cluster", "distance"))
        filled = (self.prep.filled_list(df, self.features) if self.prep is not None
                  else F.expr("cast(array() as array<string>)"))
        return out.join(df.select(self.key, filled.alias("missing_filled")), self.key)


def standardized(df: DataFrame, key: str, features: list[str] | None, prep: bool):
    pm = fit_prep(df, key=key) if prep else None
    data = pm.transform(df) if pm else df
    feats = features or (pm.columns if pm else [c for c in df.columns if c != key])
    unknown = [f for f in feats if f not in data.columns]
    if unknown:
        raise ValueError(f"unknown feature columns: {unknown}")
    scaler = fit_scaler(data, feats)
    return pm, data, feats, scaler


def kmeans(df: DataFrame, key: str, features: list[str] | None = None, k: int | None = None,
           k_range: tuple[int, int] = (2, 8), seed: int = 42, max_iter: int = 20, prep: bool = True) -> KMeansModel:
    """``k`` clusters, or the k of ``k_range`` at the elbow of the inertias; see ``kmeans_fit`` for the method. Missing
    features stand at their mean; rows with NaN (only without ``prep``) take no part in the fit."""
    pm, data, feats, scaler = standardized(df, key, features, prep)
    rows = fit_rows(scaler.transform(data, keep=[key]), key, feats)
    ks = [k] if k else list(range(k_range[0], k_range[1] + 1))
    fits = fit_sweep(rows, ks, seed, max_iter)
    costs = [fits[kk][1] for kk in ks]
    chosen = k or elbow_k(ks, costs)
    centers = fits[chosen][0]
    spark = df.sparkSession
    elbow = None if k else spark.createDataFrame(
        [(kk, c, kk == chosen) for kk, c in zip(ks, costs)], "k int, inertia double, chosen boolean")
    return KMeansModel(key=key, features=feats, centers=centers, scaler=scaler, prep=pm, data=data,
                       elbow_table=elbow, k_source="given" if k else "elbow")


def kmeans_from(df: DataFrame, key: str, features: list[str], init_centers, iterations: int,
                prep: bool = False) -> KMeansModel:
    """Deterministic K-Means: ``iterations`` Lloyd steps from the given standardised centres."""
    pm, data, feats, scaler = standardized(df, key, features, prep)
    z = scaler.transform(data, keep=[])
    centers = lloyd(z, feats, np.array(init_centers, dtype=float), iterations)
    return KMeansModel(key=key, features=feats, centers=centers, scaler=scaler, prep=pm, data=data)


def first_rows_as_centers(df: DataFrame, key: str, features: list[str], k: int, scaler: Scaler) -> np.ndarray:
    """Standardised feature values of the k rows with the lowest keys (a reproducible start)."""
    rows = (df.orderBy(key).limit(k).select(*[scaler.expr(f).alias(f) for f in features]).collect())
    return np.array([[r[f] for f in features] for r in rows], dtype=float)
