"""Exact CART. Every level tries all thresholds of all features in all open nodes at once.

A level is a few aggregates: rows are counted per (node, feature, value, class), class counts are summed up along the
values, and the boundary with the least weighted Gini impurity wins (ties: the earlier feature, then the lower
threshold). The sums run in two steps, inside slices of the values and over the slices, so no task holds all values of
a feature. What leaves the executors is one split per open node, at most 2^depth rows; rows follow their split by a
broadcast of that table. Pure nodes and nodes without two different values become leaves.

Rows without a target are not used; NULL and NaN features stand below all numbers. A tie of classes goes to the first.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, spread
from .stats import value_counts

SLICES, MAX_DEPTH, MAX_CLASSES = 64, 20, 50
_SPLIT = "node long, f int, threshold double"


def _feature_array(features: list[str]) -> Column:
    low = F.lit(float("-inf"))
    return F.array(*[F.when(F.isnan(c), low).otherwise(F.coalesce(c, low)) for c in (F.col(f"`{f}`").cast("double") for f in features)])


def _squares(counts: list[Column]) -> Column:
    """Sum of the squared counts over their sum; both sides of a split add up to what the best split makes greatest."""
    return reduce(lambda a, b: a + b, [c * c for c in counts]) / reduce(lambda a, b: a + b, counts)


@dataclass
class CartModel:
    """``nodes``: node (root 1, children 2i and 2i+1), depth, n, counts (by class), prediction, f, feature, threshold."""

    key: str
    target: str
    features: list[str]
    classes: list[str]
    depth_limit: int
    nodes: DataFrame

    @property
    def shape(self) -> DataFrame:
        """One row: depth and leaves of the tree."""
        return self.nodes.agg(F.max("depth").alias("depth"), F.count(F.when(F.col("feature").isNull(), 1)).alias("leaves"))

    @property
    def importances(self) -> DataFrame:
        """O2: (feature, importance, rank): impurity taken away by the splits on a feature, as a share of all."""
        weight = F.aggregate("counts", F.lit(0.0), lambda a, c: a + c * c) / F.col("n")
        at = self.nodes.select("node", "feature", weight.alias("w"))
        child = at.select(F.floor(F.col("node") / 2).cast("long").alias("node"), F.col("w").alias("cw")).groupBy("node").agg(F.sum("cw").alias("cw"))
        gain = at.where("feature is not null").join(child, "node").groupBy("feature").agg(F.sum(F.col("cw") - F.col("w")).alias("gain"))
        every = self.nodes.sparkSession.createDataFrame([(f,) for f in self.features], "feature string").join(gain, "feature", "left")
        whole = F.sum("gain").over(Window.partitionBy())
        share = F.coalesce(F.col("gain") / whole, F.lit(0.0)).alias("importance")
        return every.select("feature", share).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))

    def leaves_of(self, df: DataFrame) -> DataFrame:
        """``df`` with the node of its leaf as ``node``; the splits, at most 2^depth rows, are broadcast level by level."""
        splits = F.broadcast(self.nodes.where("f is not null").select(F.col("node").alias("__n"), F.col("f").alias("__f"), "threshold"))
        out = df.withColumns({"node": F.lit(1).cast("long"), "__x": _feature_array(self.features)})
        for _ in range(self.depth_limit):
            out = out.join(splits, F.col("node") == F.col("__n"), "left").withColumn("node", _child()).drop("__n", "__f", "threshold")
        return out.drop("__x")

    def predict(self, df: DataFrame) -> DataFrame:
        """V1: key, prediction (class), confidence (its share of the leaf in percent), probabilities (class → percent)."""
        n = F.col("n")
        percent = F.map_from_arrays(F.array(*[F.lit(c) for c in self.classes]), F.transform("counts", lambda c: c / n * 100))
        leaf = F.broadcast(self.nodes.select("node", "prediction", (F.array_max("counts") / n * 100).alias("confidence"), percent.alias("probabilities")))
        return self.leaves_of(df).join(leaf, "node").select(self.key, "prediction", "confidence", "probabilities")


def _child() -> Column:
    right = F.element_at("__x", F.col("__f") + 1) > F.col("threshold")
    return F.when(F.col("__f").isNull(), F.col("node")).otherwise(F.col("node") * 2 + F.when(right, 1).otherwise(0))


def _best_splits(cells: DataFrame, cuts: list[list[float]], k: int, min_leaf: int) -> DataFrame:
    """cells (node, f, v, c0…): (node, f, threshold) of the best split of every node that has one."""
    names = [f"c{i}" for i in range(k)]
    lists = F.array(*[F.array(*[F.lit(float(c)) for c in cut]) for cut in cuts])
    part = cells.withColumn("s", F.size(F.filter(F.element_at(lists, F.col("f") + 1), lambda c: c < F.col("v"))))
    blocks = part.groupBy("node", "f", "s").agg(F.min("v").alias("first"), *[F.sum(c).alias(c) for c in names])
    along = Window.partitionBy("node", "f").orderBy("s")
    blocks = blocks.select("node", "f", "s", F.lead("first").over(along).alias("next_first"),
                           *[F.coalesce(F.sum(c).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"b{c}") for c in names],
                           *[F.sum(c).over(Window.partitionBy("node", "f")).alias(f"t{c}") for c in names])
    inside = Window.partitionBy("node", "f", "s").orderBy("v")
    part = part.select("node", "f", "s", "v", F.lead("v").over(inside).alias("next_v"),
                       *[F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(f"l{c}") for c in names])
    both = part.join(blocks, ["node", "f", "s"])
    after = F.coalesce("next_v", "next_first")
    left = [(F.col(f"l{c}") + F.col(f"b{c}")).cast("double") for c in names]
    right = [F.col(f"t{c}").cast("double") - lc for c, lc in zip(names, left)]
    n_left, n_right = reduce(lambda a, b: a + b, left), reduce(lambda a, b: a + b, right)
    impure = reduce(lambda a, b: a + b, [(F.col(f"t{c}") > 0).cast("int") for c in names]) > 1
    split = both.where(after.isNotNull() & impure & (n_left >= min_leaf) & (n_right >= min_leaf)).select(
        "node", "f", ((F.col("v") + after) / 2).alias("threshold"), (_squares(left) + _squares(right)).alias("score"))
    order = F.struct((-F.col("score")).alias("s"), "f", "threshold")
    return split.groupBy("node").agg(F.min(order).alias("b")).select("node", "b.f", "b.threshold")


def cart(df: DataFrame, key: str, target: str, features: list[str], depth: int = 6, min_leaf: int = 1) -> CartModel:
    """Fit a tree of at most ``depth`` levels of splits (up to 20) on all rows of ``df`` that have a target."""
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must lie in 0..{MAX_DEPTH}")
    spark = df.sparkSession
    known = df.where(F.col(f"`{target}`").isNotNull()).withColumn("__y", F.col(f"`{target}`").cast("string"))
    counts = value_counts(known.select("__y"), ["__y"], MAX_CLASSES).get("__y")
    if counts is None:
        raise ValueError(f"'{target}' has more than {MAX_CLASSES} values")
    classes = sorted(v for v, _ in counts)
    k = max(1, len(classes))
    y = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("__y")).cast("int") - 1 if classes else F.lit(0)
    rows = cut_lineage(spread(known.select(_feature_array(features).alias("__x"), y.alias("y"))).withColumn("node", F.lit(1).cast("long")))
    grid = [i / SLICES for i in range(1, SLICES)]
    quantiles = rows.agg(*[F.percentile_approx(F.element_at("__x", j + 1), grid, 1000) for j in range(len(features))]).first()
    cuts = [sorted(set(q or [])) for q in quantiles]
    names = [f"c{i}" for i in range(k)]
    of_class = [F.count(F.when(F.col("y") == i, 1)).alias(c) for i, c in enumerate(names)]
    found = []
    for level in range(depth + 1):
        totals = rows.groupBy("node").agg(*of_class)
        splits: list = []
        if level < depth:
            cells = rows.select("node", "y", F.posexplode("__x").alias("f", "v")).groupBy("node", "f", "v").agg(*of_class)
            splits = _best_splits(cells, cuts, k, min_leaf).collect()  # one row per open node
        by_node = {r.node: (r.f, r.threshold) for r in splits}
        for r in totals.collect():
            f, threshold = by_node.get(r["node"], (None, None))
            c = [r[n] for n in names]
            found.append((r["node"], level, sum(c), c, classes[c.index(max(c))] if classes else None, f, features[f] if f is not None else None, threshold))
        if not splits:
            break
        table = F.broadcast(spark.createDataFrame([tuple(r) for r in splits], _SPLIT).withColumnsRenamed({"node": "__n", "f": "__f"}))
        # rows of leaves stay behind
        rows = cut_lineage(rows.join(table, F.col("node") == F.col("__n")).withColumn("node", _child()).select("__x", "y", "node"))
    nodes = spark.createDataFrame(found, "node long, depth int, n long, counts array<long>, prediction string, f int, feature string, threshold double")
    return CartModel(key, target, features, classes, depth, nodes)
