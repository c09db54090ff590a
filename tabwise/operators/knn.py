"""M4 k-nearest-neighbour classifier (J2), exact.

Search: queries and training rows are cut into blocks of at most ``block_rows`` (by a hash of the key, so hot
values cannot pile up in one block). Each (query block, training block) pair meets in one cogrouped pandas call
that computes the distance matrix in NumPy and emits only each query's ``k_max`` nearest candidates — never the
pairs themselves. A second, bounded step keeps the global ``k_max`` per query (window with a group limit, so
at most blocks × k_max rows per query are shuffled). Distances use the dot-product form, in single precision, to pick
every candidate at or below the k-th distance to some of the block's rows plus the form's rounding error; these are
re-ranked by the exact difference form, ties → lower key, so the answer does not depend on the order of the rows
however many tie.

Cross-validation (k chosen from ``k_range``) runs every fold in one search: a candidate from the query's own
fold is masked out. All k in the range are then voted from the same ranked lists in one projection
(majority; tie → lowest label).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .kmeans import standardized
from .prep import PrepModel, Scaler
from .stats import fold_of, is_integral

NEIGHBOUR_SCHEMA = "q_key long, t_key long, distance double, t_label double"


def _search_block(k_max: int, fold_mask: bool):
    def run(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame({"q_key": [], "t_key": [], "distance": [], "t_label": []})
        qx = np.stack(q["x"].to_numpy()).astype(float)
        tx = np.stack(t["t_x"].to_numpy()).astype(float)
        qk, tk = q["key"].to_numpy(), t["t_key"].to_numpy()
        tl = t["t_label"].to_numpy(dtype=float)
        qf, tf = q["fold"].to_numpy(), t["t_fold"].to_numpy()
        tn, qn = (tx * tx).sum(axis=1), (qx * qx).sum(axis=1)
        # single precision finds the candidates where no square can overflow it; they are ranked in double precision
        kind = np.float32 if qn.max() + tn.max() < 1e30 else np.float64
        slack = 4 * (qx.shape[1] + 16) * float(np.finfo(kind).eps) * (qn + tn.max())  # roundings of both forms
        wide_t = np.hstack([tx, tn[:, None], np.ones((len(tx), 1))]).astype(kind)
        wide_q = np.hstack([-2.0 * qx, np.ones((len(qx), 1)), qn[:, None]]).astype(kind)
        out_q, out_t, out_d, out_l = [], [], [], []
        for fold in np.unique(qf) if fold_mask else [None]:
            mine = np.arange(len(qk)) if fold is None else np.flatnonzero((qf == fold) | ((qf != qf) & (fold != fold)))
            others = np.arange(len(tk)) if fold is None else np.flatnonzero(tf != fold)
            if not len(others):
                continue
            side = np.ascontiguousarray(wide_t[others].T)
            keep = min(k_max, len(others))
            some = max(keep, min(len(others), 2048))
            for s in range(0, len(mine), 256):
                rows = mine[s:s + 256]
                d2 = wide_q[rows] @ side
                # the k-th distance to some of the rows is no less than that to all
                kth = np.partition(d2[:, :some], keep - 1, axis=1)[:, keep - 1]
                near = d2 <= (kth + slack[rows])[:, None]
                for r, i in enumerate(rows):
                    cand = np.flatnonzero(near[r])
                    cand = others[cand[np.isfinite(d2[r, cand])]]
                    if cand.size == 0:
                        continue
                    diff = tx[cand] - qx[i]
                    exact = np.sqrt((diff * diff).sum(axis=1))
                    order = np.lexsort((tk[cand], exact))[:k_max]
                    sel = cand[order]
                    out_q.append(np.full(sel.size, qk[i]))
                    out_t.append(tk[sel])
                    out_d.append(exact[order])
                    out_l.append(tl[sel])
        if not out_q:
            return pd.DataFrame({"q_key": [], "t_key": [], "distance": [], "t_label": []})
        return pd.DataFrame({"q_key": np.concatenate(out_q).astype("int64"),
                             "t_key": np.concatenate(out_t).astype("int64"),
                             "distance": np.concatenate(out_d), "t_label": np.concatenate(out_l)})
    return run


def neighbours(queries: DataFrame, train: DataFrame, k_max: int, block_rows: int = 16384,
               fold_mask: bool = False) -> DataFrame:
    """Exact k_max nearest neighbours. Both inputs: columns ``key`` (long), ``x`` (array<double>),
    ``fold`` (int; used when ``fold_mask``), and ``label`` (double) on the training side.
    Returns (q_key, rank, t_key, distance, t_label)."""
    nt = train.agg(F.count(F.lit(1))).first()[0]
    counts = (nt if queries is train else queries.agg(F.count(F.lit(1))).first()[0]), nt
    # queries are cut further until every core has a block, so that small inputs do not run in one task
    cores = queries.sparkSession.sparkContext.defaultParallelism
    nq_blocks = max(1, math.ceil(counts[0] / block_rows), min(cores, math.ceil(counts[0] / 256)))
    nt_blocks = max(1, math.ceil(counts[1] / block_rows))
    # block ids are ints on both sides: the cogroup hash-partitions both inputs on them
    q = (queries.withColumn("qb", F.pmod(F.xxhash64("key"), F.lit(nq_blocks)).cast("int"))
         .withColumn("tb", F.explode(F.sequence(F.lit(0), F.lit(nt_blocks - 1)))))
    t = (train.withColumn("tb", F.pmod(F.xxhash64("key"), F.lit(nt_blocks)).cast("int"))
         .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq_blocks - 1)))))
    if "label" not in q.columns:
        q = q.withColumn("label", F.lit(None).cast("double"))
    cand = (q.select("qb", "tb", "key", "x", "fold", "label").groupBy("qb", "tb")
            .cogroup(t.select(F.col("qb").alias("t_qb"), F.col("tb").alias("t_tb"), F.col("key").alias("t_key"),
                              F.col("x").alias("t_x"), F.col("fold").alias("t_fold"),
                              F.col("label").alias("t_label")).groupBy("t_qb", "t_tb"))
            .applyInPandas(_search_block(k_max, fold_mask), NEIGHBOUR_SCHEMA))
    w = Window.partitionBy("q_key").orderBy("distance", "t_key")
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k_max)


def vote_expr(labels_col, k: int):
    """Majority label among the first k entries of an array (ties → lowest label)."""
    s = F.slice(labels_col, 1, k)
    cand = F.array_distinct(s)
    scored = F.transform(cand, lambda lab: F.struct(F.size(F.filter(s, lambda x: x == lab)).alias("c"),
                                                    (-lab).alias("neg")))
    best = F.array_max(scored)
    return -best["neg"]


def vote_table(nb: DataFrame, ks: list[int]) -> DataFrame:
    """(q_key, k, prediction) for every k, from the ranked neighbour table. One grouped collect of at most
    k_max labels per query, then array expressions."""
    lists = nb.groupBy("q_key").agg(F.sort_array(F.collect_list(F.struct("rank", "t_label"))).alias("nb"))
    labels = F.transform(F.col("nb"), lambda s: s["t_label"])
    preds = F.array(*[F.struct(F.lit(k).alias("k"), vote_expr(labels, k).alias("prediction")) for k in ks])
    return lists.select("q_key", F.explode(preds).alias("p")).select("q_key", "p.k", "p.prediction")


@dataclass
class KNNModel:
    key: str
    target: str
    features: list[str]
    k: int
    k_source: str
    k_scores: DataFrame | None
    scaler: Scaler
    prep: PrepModel | None
    train: DataFrame          # key, x, fold, label
    block_rows: int
    cv_predictions: DataFrame | None = None

    @property
    def metrics(self) -> DataFrame:
        spark = self.train.sparkSession
        if self.k_scores is not None:
            acc = self.k_scores.where(F.col("k") == self.k).select("accuracy")
            return acc.select(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")).union(
                spark.createDataFrame([("k", float(self.k))], "metric string, value double"))
        return spark.createDataFrame([("k", float(self.k))], "metric string, value double")

    def predict(self, df: DataFrame) -> DataFrame:
        """V1 (class): (key, prediction, confidence %, probabilities, target_col, missing_filled) for a table of
        inputs, voted by the k nearest training rows. ``probabilities`` holds every class of the training table,
        by label, with its share of the votes in percent; ``missing_filled`` the features that were blank."""
        data = self.prep.transform(df) if self.prep is not None else df
        filled = (self.prep.filled_list(df, self.features) if self.prep is not None
                  else F.expr("cast(array() as array<string>)"))
        q = data.select(F.col(self.key).cast("long").alias("key"),
                        F.array(*[self.scaler.expr(f) for f in self.features]).alias("x"),
                        F.lit(-1).alias("fold"))
        nb = neighbours(q, self.train, self.k, self.block_rows, fold_mask=False)
        votes = vote_table(nb, [self.k]).select("q_key", "prediction")
        lists = nb.groupBy("q_key").agg(F.collect_list("t_label").alias("near"))
        classes = F.lit([r["label"] for r in self.train.select("label").distinct().orderBy("label").collect()])
        share = F.transform(classes, lambda c: F.struct(
            c.alias("label"), (F.size(F.filter("near", lambda x: x == c)) / F.size("near") * 100).alias("percent")))
        inputs = df.select(F.col(self.key).cast("long").alias("q_key"), filled.alias("missing_filled"))
        return (votes.join(lists, "q_key").join(inputs, "q_key").withColumn("probabilities", share)
                .select(F.col("q_key").alias(self.key), F.lit(self.target).alias("target_col"), "prediction",
                        F.array_max(F.transform("probabilities", lambda p: p["percent"])).alias("confidence"),
                        "probabilities", "missing_filled"))


def knn(df: DataFrame, key: str, target: str, features: list[str] | None = None, k: int | None = None,
        k_range: tuple[int, int] = (3, 20), folds: int = 5, prep: bool = True, block_rows: int = 16384) -> KNNModel:
    """Exact kNN classifier on standardised features. ``k`` given → used as is; otherwise the k in
    ``k_range`` with the best cross-validated accuracy (ties → smaller k). Folds are ``pmod(key, folds)``."""
    pm, data, feats, scaler = standardized(df, key, [f for f in (features or []) if f != target] or None, prep)
    feats = [f for f in feats if f != target]
    if not is_integral(data, key):
        raise ValueError(f"kNN needs an integral key; {key!r} is {dict(data.dtypes)[key]} (use sources.add_key)")
    train = data.select(F.col(key).cast("long").alias("key"),
                        F.array(*[scaler.expr(f) for f in feats]).alias("x"),
                        fold_of(key, folds, data).cast("int").alias("fold"),
                        F.col(target).cast("double").alias("label"))
    ks = list(range(k_range[0], k_range[1] + 1)) if not k else [k]
    k_max = max(ks)
    # the ranked lists (n × k_max rows) feed the k choice, the k-score table and the CV predictions
    nb = cut_lineage(neighbours(train, train, k_max, block_rows, fold_mask=True))
    votes = vote_table(nb, ks)
    truth = train.select(F.col("key").alias("q_key"), F.col("label"))
    scored = votes.join(truth, "q_key")
    k_scores = scored.groupBy("k").agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))
                                       .alias("accuracy"))
    if k:
        chosen, source = k, "given"
    else:
        rows = k_scores.collect()  # one row per k in the range
        best = max(rows, key=lambda r: (r["accuracy"], -r["k"]))
        chosen, source = int(best["k"]), "cross-validation"
    return KNNModel(key=key, target=target, features=feats, k=chosen, k_source=source, k_scores=k_scores,
                    scaler=scaler, prep=pm, train=train, block_rows=block_rows, cv_predictions=scored)
