"""U5 isolation forest (+ G18 summary, P14 anomaly rows, O7 top anomalies), as relations.

All chance is drawn from md5 of named things, so a fit can be repeated in any engine that has md5, whatever the layout
of the data. Sampling: tree t takes the ``sample`` rows with the least md5(key:t:seed). A pre-filter on the same digest
keeps a row for a tree with probability ~3·sample/n before the per-tree top-``sample`` (a window whose group limit is
applied before the shuffle), so no tree's group ever holds more than a few hundred rows, whatever the skew.
Building: the samples (trees × sample rows) are shuffled once by tree; each level is a window over (tree, node) that
gives the node's size and the range of every feature, from which each row draws its node's split (feature: md5 of
seed:tree:node:f among those that vary, threshold: md5 of seed:tree:node:v between least and greatest) and its child
(2i where the value is less than the threshold, else 2i + 1). Depth limit ⌈log2 ψ⌉.
Scoring: the node table is bounded (trees × (2ψ − 1) rows), so it is broadcast; ``mapInPandas`` walks all trees level by
level on Arrow batches. score = 2^(−E[h(x)] / c(ψ)), to 6 decimals; flagged when score > ``threshold``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import round_half_up
from ..session import cut_lineage, spread
from .prep import PrepModel, fit_prep

DIGITS = 13  # hexadecimal digits of a draw: 52 bits, which a double holds exactly

def c_factor(n) -> np.ndarray | float:
    """Average path length of an unsuccessful search in a binary search tree of n points."""
    n = np.asarray(n, dtype=float)
    out = np.where(n > 2, 2.0 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2.0 * (n - 1) / np.maximum(n, 1),
                   np.where(n == 2, 1.0, 0.0))
    return out if out.shape else float(out)


def _draw(*names) -> Column:
    """A number in [0, 1) from md5 of the names joined by colons."""
    digest = F.md5(F.concat_ws(":", *[F.col(n).cast("string") if n in ("tree", "node") else F.lit(str(n)) for n in names]))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / F.lit(float(16 ** DIGITS))


def _sampled(data: DataFrame, key: str, feats: list[str], trees: int, psi: int, n: int, seed: int, share: float) -> DataFrame:
    """(tree, x) of the ``psi`` rows of every tree, from the rows that pass a pre-filter of ``share``."""
    k = F.col(f"`{key}`").cast("string")

    def digest(t):
        return F.md5(F.concat_ws(":", k, t.cast("string"), F.lit(str(seed))))

    rows = spread(data).select(k.alias("__key"), F.array(*[F.col(f"`{f}`").cast("double") for f in feats]).alias("x"),
                               F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), digest(t).alias("h"))).alias("all"))
    if share < 1:
        bound = f"{int(share * 16 ** DIGITS):0{DIGITS}x}"
        rows = rows.withColumn("all", F.filter("all", lambda p: F.substring(p["h"], 1, DIGITS) < bound)).where(F.size("all") > 0)
    w = Window.partitionBy("tree").orderBy("h", "__key")
    return rows.select("__key", "x", F.explode("all").alias("p")).select("__key", "x", "p.tree", "p.h") \
        .withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= psi).select("tree", "x")


def grow(sample: DataFrame, n_features: int, limit: int, seed: int) -> DataFrame:
    """sample (tree, x) → nodes (tree, node, depth, size, feature, threshold); leaves have no feature."""
    rows = sample.withColumns({"node": F.lit(1).cast("long"), "open": F.lit(True), "path": F.expr(
        "cast(array() as array<struct<node:long,depth:int,size:long,feature:int,threshold:double>>)")})
    here = Window.partitionBy("tree", "node")
    value = [F.element_at("x", j + 1) for j in range(n_features)]
    ranges = F.array(*[F.struct(F.lit(j).alias("j"), F.min(v).over(here).alias("lo"), F.max(v).over(here).alias("hi")) for j, v in enumerate(value)])
    for depth in range(limit + 1):
        rows = rows.withColumns({"size": F.count(F.lit(1)).over(here), "ranges": ranges})
        rows = rows.withColumn("varies", F.filter("ranges", lambda r: r["hi"] > r["lo"]))
        place = F.floor(_draw(seed, "tree", "node", "f") * F.size("varies")).cast("int") + 1
        splits = F.col("open") & (F.col("size") > 1) & (F.size("varies") > 0) & F.lit(depth < limit)
        rows = rows.withColumn("pick", F.when(splits, F.element_at("varies", place)))
        rows = rows.withColumn("threshold", F.col("pick.lo") + _draw(seed, "tree", "node", "v") * (F.col("pick.hi") - F.col("pick.lo")))
        step = F.struct("node", F.lit(depth).alias("depth"), "size", F.col("pick.j").alias("feature"), "threshold")
        side = F.when(F.element_at("x", F.col("pick.j") + 1) < F.col("threshold"), 0).otherwise(1)
        rows = rows.select("tree", "x", F.when(F.col("pick").isNull(), F.col("node")).otherwise(F.col("node") * 2 + side).alias("node"),
                           F.col("pick").isNotNull().alias("open"),
                           F.when(F.col("open"), F.concat("path", F.array(step))).otherwise(F.col("path")).alias("path"))
    return rows.select("tree", F.explode("path").alias("p")).select("tree", "p.*").distinct()


def _packed(nodes: list) -> tuple:
    """Arrays of one tree for the scorer: feature, threshold, children, size, depth, leaf. A child without rows is a leaf
    of size 0."""
    by = {r["node"]: (r["feature"], r["threshold"], r["size"], r["depth"]) for r in nodes}
    for node, (feature, _, _, depth) in list(by.items()):
        if feature is not None:
            for child in (2 * node, 2 * node + 1):
                by.setdefault(child, (None, None, 0, depth + 1))
    at = {node: i for i, node in enumerate(sorted(by))}
    rows = [(f is None, f or 0, t or 0.0, at.get(2 * n, 0), at.get(2 * n + 1, 0), size, depth) for n, (f, t, size, depth) in sorted(by.items())]
    leaf, feature, threshold, left, right, size, depth = map(np.array, zip(*rows))
    return feature, threshold.astype(float), left, right, size.astype(float), depth.astype(float), leaf


def _scorer(bc, n_features: int, key: str, psi: int):
    def score(batches):
        nodes = bc.value
        cpsi = float(c_factor(psi)) or 1.0
        for pdf in batches:
            if pdf.empty:
                yield pd.DataFrame({key: pdf[key], "anomaly_score": pd.Series(dtype=float)})
                continue
            X = np.stack(pdf["x"].to_numpy()).astype(float)
            total = np.zeros(len(X))
            for feat, thr, left, right, size, depth, leaf in nodes:
                node = np.zeros(len(X), dtype=np.int64)
                while True:
                    active = ~leaf[node]
                    if not active.any():
                        break
                    a = np.flatnonzero(active)
                    f = feat[node[a]]
                    go_left = X[a, f] < thr[node[a]]
                    node[a] = np.where(go_left, left[node[a]], right[node[a]])
                total += depth[node] + c_factor(size[node])
            mean_path = total / len(nodes)
            yield pd.DataFrame({key: pdf[key].to_numpy(), "anomaly_score": np.power(2.0, -mean_path / cpsi)})
    return score


@dataclass
class IsolationForestModel:
    key: str
    features: list[str]
    prep: PrepModel | None
    data: DataFrame
    nodes: list
    psi: int
    threshold: float
    spark_bc: object

    def score(self, df: DataFrame, cleaned: bool = False) -> DataFrame:
        """(key, anomaly_score, is_anomaly) for every row of ``df``."""
        data = df if cleaned or self.prep is None else self.prep.transform(df)
        x = data.select(self.key, F.array(*[F.col(f"`{f}`").cast("double") for f in self.features]).alias("x"))
        if not x.isStreaming:
            x = spread(x)
        key_type = dict(x.dtypes)[self.key]
        out = x.mapInPandas(_scorer(self.spark_bc, len(self.features), self.key, self.psi),
                            f"`{self.key}` {key_type}, anomaly_score double")
        out = out.withColumn("anomaly_score", round_half_up("anomaly_score", 6))
        return out.withColumn("is_anomaly", F.col("anomaly_score") > F.lit(self.threshold))

    @property
    def scores(self) -> DataFrame:
        return self.score(self.data, cleaned=True)

    @property
    def summary(self) -> DataFrame:
        """Anomaly count and %."""
        s = self.scores
        return s.agg(F.sum(F.col("is_anomaly").cast("long")).alias("n_anomalies"),
                     (F.avg(F.col("is_anomaly").cast("double")) * 100).alias("anomaly_pct"),
                     F.count(F.lit(1)).alias("n_rows"))

    def anomalies(self, original: DataFrame, n: int | None = None) -> DataFrame:
        """Flagged rows with their original columns and score, highest score first; ``n`` keeps the
        top n (a top-k, not a sample)."""
        flagged = self.scores.where("is_anomaly").select(self.key, "anomaly_score")
        rows = original.join(flagged, self.key)
        if n is not None:
            rows = rows.orderBy(F.desc("anomaly_score"), self.key).limit(n)
        return rows


def isolation_forest(df: DataFrame, key: str, features: list[str] | None = None, trees: int = 100,
                     sample: int = 256, threshold: float = 0.5, seed: int = 42, prep: bool = True,
                     contamination: float | str = "auto") -> IsolationForestModel:
    """U5. ``contamination="auto"`` flags scores above ``threshold``, the score of a point of average depth; a share
    (0 to 0.5) flags that part of the rows: the threshold is the least training score that no more than this part of
    the rows exceeds, so tied scores stand on one side together."""
    if contamination != "auto" and not 0 < float(contamination) <= 0.5:
        raise ValueError("contamination is 'auto' or a share above 0 and up to 0.5")
    pm = fit_prep(df, key=key) if prep else None
    data = pm.transform(df) if pm else df
    feats = features or (pm.columns if pm else [c for c in df.columns if c != key])
    n = data.count()
    psi = min(sample, n)
    share = min(1.0, (3.0 * sample + 64.0) / max(n, 1))
    samp = cut_lineage(_sampled(data, key, feats, trees, psi, n, seed, share))
    full = samp.groupBy("tree").count().where(F.col("count") == psi).count()
    if share < 1 and full < trees:  # the pre-filter left a tree short of rows
        samp = cut_lineage(_sampled(data, key, feats, trees, psi, n, seed, 1.0))
    by_tree: dict[int, list] = {}
    for r in grow(samp, len(feats), int(math.ceil(math.log2(max(psi, 2)))), seed).collect():
        by_tree.setdefault(r["tree"], []).append(r)
    packed = [_packed(by_tree[t]) for t in sorted(by_tree)]
    bc = df.sparkSession.sparkContext.broadcast(packed)
    model = IsolationForestModel(key=key, features=feats, prep=pm, data=data, nodes=packed, psi=psi,
                                 threshold=threshold, spark_bc=bc)
    if contamination != "auto":
        # scores have 6 decimals, so this table has a million rows at most
        counts = model.scores.groupBy("anomaly_score").agg(F.count(F.lit(1)).alias("c"))
        above = F.coalesce(F.sum("c").over(Window.orderBy(F.desc("anomaly_score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        q = counts.withColumn("above", above).where(F.col("above") <= math.floor(float(contamination) * n)).agg(F.min("anomaly_score")).first()[0]
        model.threshold = float(q) if q is not None else threshold
    return model
