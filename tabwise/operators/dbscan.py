"""U2 DBSCAN (J3 ε-neighbour join, G19, P13, G10, V3, G11).

Neighbours: standardised points get a coarse ε-grid cell on at most two features (those with the most
distinct ⌊z/ε⌋, so the cells split the data best); each point is offered to its neighbouring cells and joined
on the cell, then filtered by the exact distance over *all* features. A point is core when it has at least
``min_pts`` neighbours, itself included. Dense fine cells (side ε/√d, ≥ min_pts points) are handled as one
node each, with exact box-distance bounds instead of point pairs (see ``dbscan``), so a region holding a third
of the rows costs linear work. Core–core links go to ``connected_components``; a cluster id is the 0-based rank
of the component's least core key. A border point joins the lowest-numbered cluster among its core
neighbours; everything else is noise (−1). Intermediate tables are written to the checkpoint folder once and
reused by every later step.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import squared_distance
from ..session import cut_lineage
from .distances import MAX_FEATURES, tree_distance_stats
from .graph import connected_components, dense_index
from .kmeans import standardized
from .prep import PrepModel, Scaler
from .stats import is_integral


def auto_min_pts(n: int) -> int:
    """Our rule when no minPts is given: max(3, min(20, round(ln n)))."""
    return max(3, min(20, int(round(math.log(max(n, 1))))))


@dataclass
class DBSCANModel:
    key: str
    features: list[str]
    eps: float
    min_pts: int
    scaler: Scaler
    prep: PrepModel | None
    data: DataFrame           # cleaned table
    labels: DataFrame         # key, cluster, is_core, n_neighbours
    grid: list[str]

    @property
    def assign(self) -> DataFrame:
        return self.labels

    @property
    def sizes(self) -> DataFrame:
        return self.labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))

    @property
    def summary(self) -> DataFrame:
        """Number of clusters, noise rows, rows."""
        return self.labels.agg(
            F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("n_clusters"),
            F.sum((F.col("cluster") == -1).cast("long")).alias("n_noise"),
            F.count(F.lit(1)).alias("n_rows"))

    @property
    def averages(self) -> DataFrame:
        """G10 per cluster (noise excluded), in cleaned units."""
        j = self.data.join(self.labels.select(self.key, "cluster"), self.key).where(F.col("cluster") >= 0)
        return j.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"),
                                        *[F.avg(f"`{f}`").alias(f"avg_{f}") for f in self.features])

    def outliers(self, original: DataFrame) -> DataFrame:
        """Noise rows in full (original columns), via a semi join on the key."""
        noise = self.labels.where(F.col("cluster") == -1).select(self.key)
        return original.join(noise, self.key, "left_semi")

    def score(self, df: DataFrame, block_rows: int = 16384) -> DataFrame:
        """V3 + G11: for each input row and each cluster, the min and average distance to the cluster's
        members; ``assigned`` = cluster of the nearest member when within ε, else −1. Every input row comes back:
        without any cluster it has one row with NULL cluster and distances, assigned −1.
        Output (key, cluster, min_distance, avg_distance, assigned, missing_filled)."""
        data = self.prep.transform(df) if self.prep is not None else df
        filled = (self.prep.filled_list(df, self.features) if self.prep is not None
                  else F.expr("cast(array() as array<string>)"))
        q = data.select(F.col(self.key).cast("long").alias("key"),
                        F.array(*[self.scaler.expr(f) for f in self.features]).alias("x"))
        members = (self.data.join(self.labels.where(F.col("cluster") >= 0).select(self.key, "cluster"), self.key)
                   .select(F.col(self.key).cast("long").alias("key"),
                           F.array(*[self.scaler.expr(f) for f in self.features]).alias("x"), "cluster"))
        stats = (tree_distance_stats(q, members.select("x", "cluster"), len(self.features)) if 1 <= len(self.features) <= MAX_FEATURES
                 else cluster_distance_stats(q, members, block_rows))
        best = (stats.groupBy("key").agg(F.min(F.struct("min_distance", "cluster")).alias("b"))
                .select("key", F.when(F.col("b.min_distance") <= F.lit(self.eps), F.col("b.cluster"))
                        .otherwise(F.lit(-1)).alias("assigned")))
        inputs = df.select(F.col(self.key).cast("long").alias("key"), filled.alias("missing_filled"))
        return (inputs.join(stats.join(best, "key"), "key", "left")
                .select(F.col("key").alias(self.key), "cluster", "min_distance", "avg_distance",
                        F.coalesce("assigned", F.lit(-1)).alias("assigned"), "missing_filled"))

    def typical(self, scored: DataFrame) -> DataFrame:
        """The scored rows that fell into a cluster, with that cluster's average feature values."""
        own = scored.where((F.col("assigned") >= 0) & (F.col("cluster") == F.col("assigned"))).select(self.key, "assigned")
        return own.join(self.averages.withColumnRenamed("cluster", "assigned"), "assigned")


def _block_stats(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
    cols = {"key": [], "cluster": [], "min_d": [], "sum_d": [], "n": []}
    if q.empty or t.empty:
        return pd.DataFrame(cols)
    qx = np.stack(q["x"].to_numpy()).astype(float)
    tx = np.stack(t["m_x"].to_numpy()).astype(float)
    tc = t["m_cluster"].to_numpy()
    clusters = np.unique(tc)
    out = []
    step = max(1, 2_000_000 // max(1, tx.shape[0] * tx.shape[1]))  # keeps the difference tensor ~16 MB
    for s in range(0, len(qx), step):
        qs = qx[s:s + step]
        d = np.sqrt(((qs[:, None, :] - tx[None, :, :]) ** 2).sum(axis=2))
        for c in clusters:
            m = tc == c
            dc = d[:, m]
            out.append(pd.DataFrame({"key": q["key"].to_numpy()[s:s + step], "cluster": c,
                                     "min_d": dc.min(axis=1), "sum_d": dc.sum(axis=1), "n": int(m.sum())}))
    return pd.concat(out, ignore_index=True)


def cluster_distance_stats(queries: DataFrame, members: DataFrame, block_rows: int = 16384) -> DataFrame:
    """Per (query, cluster): min and mean distance to the cluster's members, for more features than
    ``tree_distance_stats`` takes. Blocks of queries meet blocks of
    members in cogrouped pandas calls that emit one partial row per (query, cluster); partials are then
    combined with min / sum (bounded by queries × clusters)."""
    nq = max(1, math.ceil(queries.count() / block_rows))
    nt = max(1, math.ceil(members.count() / block_rows))
    # block ids are ints on both sides: the cogroup hash-partitions both inputs on them
    q = (queries.withColumn("qb", F.pmod(F.xxhash64("key"), F.lit(nq)).cast("int"))
         .withColumn("tb", F.explode(F.sequence(F.lit(0), F.lit(nt - 1)))))
    t = (members.select(F.pmod(F.xxhash64("key"), F.lit(nt)).cast("int").alias("m_tb"),
                        F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("m_qb"),
                        F.col("x").alias("m_x"), F.col("cluster").alias("m_cluster")))
    part = (q.select("qb", "tb", "key", "x").groupBy("qb", "tb")
            .cogroup(t.groupBy("m_qb", "m_tb"))
            .applyInPandas(_block_stats, "key long, cluster int, min_d double, sum_d double, n long"))
    return part.groupBy("key", "cluster").agg(F.min("min_d").alias("min_distance"),
                                              (F.sum("sum_d") / F.sum("n")).alias("avg_distance"))


def _offsets_range(ndim: int, r: int):
    if ndim == 0:
        return [[]]
    rest = _offsets_range(ndim - 1, r)
    return [[d] + x for d in range(-r, r + 1) for x in rest]


def _shift(df: DataFrame, ngrid: int, r: int, keep: list[str]) -> DataFrame:
    """Offer each row to the coarse cells within ``r`` steps on every grid dimension (a bounded generator,
    (2r+1)^ngrid rows per input row, ngrid <= 2)."""
    offs = _offsets_range(ngrid, r)
    ex = df.select(*keep, *[F.col(f"g{i}") for i in range(ngrid)],
                   F.explode(F.array(*[F.array(*[F.lit(o) for o in off]) for off in offs])).alias("off"))
    return ex.select(*keep, *[(F.col(f"g{i}") + F.col("off")[i]).alias(f"g{i}") for i in range(ngrid)])


def _d2(a: list, b: list):
    return squared_distance([F.col(x) for x in a], [F.col(y) for y in b])


def _point_box(xs: list[str], los: list[str], his: list[str]):
    """(min², max²) squared distance from a point to an axis-aligned box."""
    mn = [F.greatest(F.col(lo) - F.col(x), F.lit(0.0), F.col(x) - F.col(hi)) for x, lo, hi in zip(xs, los, his)]
    mx = [F.greatest(F.col(x) - F.col(lo), F.col(hi) - F.col(x)) for x, lo, hi in zip(xs, los, his)]
    return sum((m * m for m in mn[1:]), mn[0] * mn[0]), sum((m * m for m in mx[1:]), mx[0] * mx[0])


def choose_grid(z: DataFrame, features: list[str], eps: float, max_dims: int = 2) -> list[str]:
    """The ≤ 2 features whose ⌊z/ε⌋ take the most distinct values (one HyperLogLog pass)."""
    row = z.agg(*[F.approx_count_distinct(F.floor(F.col(f) / F.lit(eps))).alias(f"d{i}")
                  for i, f in enumerate(features)]).first()
    ranked = sorted(range(len(features)), key=lambda i: (-row[f"d{i}"], i))
    return [features[i] for i in ranked[:max_dims]]


def dbscan(df: DataFrame, key: str, features: list[str] | None = None, eps: float = 0.5,
           min_pts: int | None = None, prep: bool = True, broadcast_rows: int = 1_000_000) -> DBSCANModel:
    """Exact DBSCAN whose work stays near-linear when a region is very dense.

    Fine cells have side ε/√d on every feature, so any two points of one fine cell are within ε. A fine cell
    with at least ``min_pts`` points is *dense*: all its points are core and connected, so the cell becomes one
    graph node (its least key) and its points never meet each other in a join. Links from a sparse point or a
    dense cell to another dense cell are decided by exact box-distance bounds (all within ε / none within ε);
    only pairs in the ambiguous boundary band are expanded to members. Sparse points are paired through the
    coarse ε-grid with the exact distance filter. ``n_neighbours`` is exact for points of sparse cells and NULL
    for points of dense cells (core by construction, never counted one by one).
    """
    kept: list[DataFrame] = []

    def keep(t: DataFrame) -> DataFrame:
        """Fixed-depth intermediates are reused several times: persist them (memory, then disk; recomputed
        from their short lineage if an executor is lost) and release them once the labels are written."""
        t = t.persist(StorageLevel.MEMORY_AND_DISK)
        kept.append(t)
        return t

    pm, data, feats, scaler = standardized(df, key, features, prep)
    if not is_integral(data, key):
        raise ValueError(f"DBSCAN needs an integral key; {key!r} is {dict(data.dtypes)[key]} (use sources.add_key)")
    d = len(feats)
    xs = [f"x{j}" for j in range(d)]
    z = data.select(F.col(key).alias("k"), *[scaler.expr(f).alias(x) for f, x in zip(feats, xs)])
    mp = min_pts or auto_min_pts(data.count())
    # sparse points meet through up to three features (27 neighbouring cells), so a value pair that many of them
    # share is split by the third; cells meet through the first two (their neighbourhoods are wider)
    gs = choose_grid(z, xs, eps, max_dims=3)
    gx, ns = gs[:2], len(gs)
    ng = len(gx)
    eps2 = F.lit(eps * eps)
    side = eps / math.sqrt(d)
    cell = F.struct(*[F.floor(F.col(x) / F.lit(side)).alias(f"c{j}") for j, x in enumerate(xs)])
    pts = z.select("k", *xs, cell.alias("cell"), *[F.floor(F.col(g) / F.lit(eps)).alias(f"g{i}")
                                                    for i, g in enumerate(gs)])
    lo, hi = [f"lo{j}" for j in range(d)], [f"hi{j}" for j in range(d)]
    cells = pts.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("rep"),
                                    *[F.min(x).alias(a) for x, a in zip(xs, lo)],
                                    *[F.max(x).alias(a) for x, a in zip(xs, hi)])
    dense = keep(cells.where(F.col("n") >= mp)
                        .select("*", *[F.floor(F.col(f"lo{xs.index(g)}") / F.lit(eps)).alias(f"g{i}")
                                       for i, g in enumerate(gx)]))
    small = dense.count() <= broadcast_rows
    mark = dense.select("cell", "rep")
    pts = keep(pts.join(F.broadcast(mark) if small else mark, "cell", "left"))
    S = pts.where(F.col("rep").isNull()).drop("rep")
    D = pts.where(F.col("rep").isNotNull())

    # (i) sparse × sparse through the coarse grid
    a_cols = [F.col("k").alias("p")] + [F.col(x).alias(f"a_{x}") for x in xs]
    left = S.select(*a_cols, *[F.col(f"g{i}") for i in range(ns)])
    right = _shift(S.select(F.col("k").alias("q"), *[F.col(x).alias(f"b_{x}") for x in xs],
                            *[F.col(f"g{i}") for i in range(ns)]), ns, 1, ["q"] + [f"b_{x}" for x in xs])
    ss = (left.join(right, [f"g{i}" for i in range(ns)])
          .where(_d2([f"a_{x}" for x in xs], [f"b_{x}" for x in xs]) <= eps2).select("p", "q"))
    ss = keep(ss)

    # (ii) sparse point × dense cell: box bounds decide; the ambiguous band is expanded to members
    boxes = dense.select("cell", "rep", "n", *lo, *hi, *[F.col(f"g{i}") for i in range(ng)])
    sx = _shift(S.select(*a_cols, *[F.col(f"g{i}") for i in range(ng)]), ng, 2, ["p"] + [f"a_{x}" for x in xs])
    mn2, mx2 = _point_box([f"a_{x}" for x in xs], lo, hi)
    sd = (sx.join(boxes, [f"g{i}" for i in range(ng)]).where(mn2 <= eps2)
          .select("p", "cell", "rep", "n", (mx2 <= eps2).alias("full"), *[f"a_{x}" for x in xs]))
    sd = keep(sd)
    sd_full = sd.where("full").select("p", "rep", F.col("n").alias("cnt"))
    members = D.select("cell", *[F.col(x).alias(f"b_{x}") for x in xs])
    sd_amb = (sd.where(~F.col("full")).join(members, "cell")
              .where(_d2([f"a_{x}" for x in xs], [f"b_{x}" for x in xs]) <= eps2)
              .groupBy("p", "rep").agg(F.count(F.lit(1)).alias("cnt")))
    sdl = keep(sd_full.unionByName(sd_amb))

    # (iii) dense cell × dense cell: box-to-box bounds, boundary members only when ambiguous
    A = boxes.select(*[F.col(c).alias(f"A_{c}") for c in ["cell", "rep", *lo, *hi]],
                     *[F.col(f"g{i}") for i in range(ng)])
    B = _shift(boxes.select(*[F.col(c).alias(f"B_{c}") for c in ["cell", "rep", *lo, *hi]],
                            *[F.col(f"g{i}") for i in range(ng)]), ng, 3,
               [f"B_{c}" for c in ["cell", "rep", *lo, *hi]])
    gap = [F.greatest(F.col(f"B_lo{j}") - F.col(f"A_hi{j}"), F.col(f"A_lo{j}") - F.col(f"B_hi{j}"), F.lit(0.0))
           for j in range(d)]
    span = [F.greatest(F.col(f"B_hi{j}") - F.col(f"A_lo{j}"), F.col(f"A_hi{j}") - F.col(f"B_lo{j}"))
            for j in range(d)]
    bmin2 = sum((g * g for g in gap[1:]), gap[0] * gap[0])
    bmax2 = sum((g * g for g in span[1:]), span[0] * span[0])
    dd = (A.join(B, [f"g{i}" for i in range(ng)]).where((F.col("A_rep") < F.col("B_rep")) & (bmin2 <= eps2))
          .select("*", (bmax2 <= eps2).alias("full")))
    dd = keep(dd.drop(*[f"g{i}" for i in range(ng)]))
    dd_full = dd.where("full").select(F.col("A_rep").alias("src"), F.col("B_rep").alias("dst"))
    amb = dd.where(~F.col("full"))
    mA = (amb.join(D.select(F.col("cell").alias("A_cell"), *[F.col(x).alias(f"a_{x}") for x in xs]), "A_cell")
          .where(_point_box([f"a_{x}" for x in xs], [f"B_{c}" for c in lo], [f"B_{c}" for c in hi])[0] <= eps2)
          .select("A_rep", "B_rep", *[f"a_{x}" for x in xs]))
    mB = (amb.join(D.select(F.col("cell").alias("B_cell"), *[F.col(x).alias(f"b_{x}") for x in xs]), "B_cell")
          .where(_point_box([f"b_{x}" for x in xs], [f"A_{c}" for c in lo], [f"A_{c}" for c in hi])[0] <= eps2)
          .select("A_rep", "B_rep", *[f"b_{x}" for x in xs]))
    dd_amb = (mA.join(mB, ["A_rep", "B_rep"])
              .where(_d2([f"a_{x}" for x in xs], [f"b_{x}" for x in xs]) <= eps2)
              .select(F.col("A_rep").alias("src"), F.col("B_rep").alias("dst")).distinct())

    # core status of sparse points
    counts = (S.select(F.col("k").alias("p"))
              .join(ss.groupBy("p").agg(F.count(F.lit(1)).alias("c1")), "p", "left")
              .join(sdl.groupBy("p").agg(F.sum("cnt").alias("c2")), "p", "left")
              .select("p", (F.coalesce("c1", F.lit(0)) + F.coalesce("c2", F.lit(0))).cast("long")
                      .alias("n_neighbours")))
    counts = keep(counts)
    core_s = counts.where(F.col("n_neighbours") >= mp).select("p")

    # graph: sparse core points + one node per dense cell
    nodes = core_s.select(F.col("p").alias("node")).unionByName(dense.select(F.col("rep").alias("node")))
    e1 = (ss.where(F.col("p") < F.col("q")).join(core_s, "p", "left_semi")
          .join(core_s.withColumnRenamed("p", "q"), "q", "left_semi")
          .select(F.col("p").alias("src"), F.col("q").alias("dst")))
    e2 = sdl.join(core_s, "p", "left_semi").select(F.col("p").alias("src"), F.col("rep").alias("dst"))
    comps = connected_components(nodes, e1.unionByName(e2).unionByName(dd_full).unionByName(dd_amb))
    ids = dense_index(comps, "comp", "cluster")
    node_cl = keep(comps.join(ids, "comp").select("node", F.col("cluster").cast("int")))
    rep_cl = node_cl.join(dense.select(F.col("rep").alias("node")), "node", "left_semi")
    rep_cl = F.broadcast(rep_cl) if small else rep_cl

    # labels: dense points take their cell's cluster; sparse core their own; border the lowest adjacent
    b1 = ss.join(node_cl.withColumnRenamed("node", "q"), "q").select("p", "cluster")
    b2 = sdl.join(rep_cl.withColumnRenamed("node", "rep"), "rep").select("p", "cluster")
    border = (b1.unionByName(b2).join(core_s, "p", "left_anti").groupBy("p").agg(F.min("cluster").alias("bc")))
    sparse_lab = (counts.join(node_cl.withColumnRenamed("node", "p"), "p", "left").join(border, "p", "left")
                  .select(F.col("p").alias(key),
                          F.coalesce(F.col("cluster"), F.col("bc"), F.lit(-1)).cast("int").alias("cluster"),
                          F.col("cluster").isNotNull().alias("is_core"), "n_neighbours"))
    dense_lab = (D.select("k", "rep").join(rep_cl.withColumnRenamed("node", "rep"), "rep")
                 .select(F.col("k").alias(key), F.col("cluster").cast("int"), F.lit(True).alias("is_core"),
                         F.lit(None).cast("long").alias("n_neighbours")))
    labels = cut_lineage(sparse_lab.unionByName(dense_lab))
    for t in kept:
        t.unpersist()
    return DBSCANModel(key=key, features=feats, eps=eps, min_pts=mp, scaler=scaler, prep=pm, data=data,
                       labels=labels, grid=[feats[xs.index(g)] for g in gx])
