"""M1, O2, V1: random forest with hashed bags, grown level by level for all trees at once.

All chance comes from md5 of named things, so a fit is the same on any layout of the rows and can be repeated in SQL. Row r
counts Poisson(1) times in tree t (32 bits of md5(key:t div 4:seed) against the distribution function); a node of a tree
tries the ``tries`` features with the least md5(seed:tree:node:feature), by default the square root of their number. Features
are cut at up to ``bins`` − 1 values, the quantiles of a bounded sample (``CUT_ROWS`` rows of least md5(key:cuts:seed)); the
sample serves the cuts alone, all rows are counted.

A level is one pass and one shuffle: tasks walk their rows down the trees so far (bit-packed bins and bags, written once),
count (tree, node, feature, bin, class) in NumPy and hand on partial counts whenever they exceed ``CELLS``; running sums
along the bins then give the boundary with the least weighted Gini impurity of every node (ties: the earlier feature, then
the lower cut). One row per node, at most trees · 2^depth, reaches the driver and goes back to the tasks by broadcast.

Rows without a target are not used in a fit; NULL and NaN features stand below all numbers; rows with equal keys have equal
bags, a NULL key counts as empty text. A tie of classes goes to the first.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, spread
from .cart import MAX_CLASSES, _feature_array, _squares
from .stats import value_counts

CUT_ROWS, CELLS, MAX_DEPTH, MAX_BINS = 4096, 1_000_000, 14, 255


def poisson_steps() -> list[int]:
    """A 32-bit draw counts as many times as it reaches one of these: 2^32 · P(X ≤ i) for Poisson(1)."""
    steps, p, total = [], math.exp(-1), 0.0
    for i in range(1, 13):
        total += p
        steps.append(int(total * 2 ** 32))
        p /= i
    return steps


def _id(key: str) -> Column:
    return F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))


def _cuts(rows: DataFrame, p: int, bins: int, seed: int) -> list[list[float]]:
    order = F.struct(F.md5(F.concat_ws(":", "id", F.lit("cuts"), F.lit(str(seed)))).alias("h"), "id", "x")
    sample = rows.select(order.alias("o")).orderBy("o").limit(CUT_ROWS).select("o.x").collect()
    n, out = len(sample), []
    for j in range(p):
        v = sorted(r["x"][j] for r in sample)
        out.append(sorted({v[math.ceil(n * b / bins) - 1] for b in range(1, bins) if n}))
    return out


def _pack(rows: DataFrame, cuts: list[list[float]], trees: int, seed: int) -> DataFrame:
    """(y, bins: a byte per feature, bag: a byte per tree)."""
    groups = -(-trees // 4)
    h = F.unhex(F.concat(*[F.md5(F.concat_ws(":", "id", F.lit(str(g)), F.lit(str(seed)))) for g in range(groups)]))
    steps, p = np.array(poisson_steps()), len(cuts)

    def pack(batches):
        for b in batches:
            n = b.num_rows
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, p)
            code = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]).astype(np.uint8)
            u = np.frombuffer(b"".join(b.column("h").to_pylist()), dtype=">u4").reshape(n, -1)[:, :trees]
            bag = np.searchsorted(steps, u.astype(np.int64), side="right").astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([r.tobytes() for r in code], pa.binary()),
                                              pa.array([r.tobytes() for r in bag], pa.binary())], ["y", "bins", "bag"])
    return rows.select("x", "y", h.alias("h")).mapInArrow(pack, "y int, bins binary, bag binary")


def _walk(code: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Node of every row in one tree; ``feature`` and ``cut`` by node, feature −1 where it does not split."""
    node = np.ones(len(code), dtype=np.int64)
    at = np.arange(len(code))
    for _ in range(levels):
        f = feature[node]
        node = np.where(f < 0, node, 2 * node + (code[at, np.maximum(f, 0)] > cut[node]))
    return node


def _counts(packed: DataFrame, splits, tries: np.ndarray, level: int, k: int) -> DataFrame:
    """(tree, node, f, bin, y, n) of the nodes on ``level``; ``tries`` (trees, 2^level, p) tells which features count."""
    trees, width, p = tries.shape

    def merged(parts):
        code, n = np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts])
        code, at = np.unique(code, return_inverse=True)
        return code, np.bincount(at, weights=n, minlength=len(code))

    def out(part):
        return pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1].astype(np.int64))], ["code", "n"])

    def count(batches):
        feature, cut, allowed = splits.value
        parts, held = [], 0
        for b in batches:
            for start in range(0, b.num_rows, 4096):
                piece = b.slice(start, 4096)
                m = piece.num_rows
                code = np.frombuffer(b"".join(piece.column("bins").to_pylist()), np.uint8).reshape(m, p).astype(np.int64)
                bag = np.frombuffer(b"".join(piece.column("bag").to_pylist()), np.uint8).reshape(m, trees)
                y = piece.column("y").to_numpy()
                for t in range(trees):
                    q = _walk(code, feature[t], cut[t], level) - width
                    use = (q >= 0) & (bag[:, t] > 0)
                    for f in range(p):
                        r = np.flatnonzero(use & allowed[t, np.maximum(q, 0), f])
                        if len(r):
                            cell = ((((t * width + q[r]) * p + f) * (MAX_BINS + 1) + code[r, f]) * k + y[r])
                            parts.append(merged([(cell, bag[r, t].astype(float))]))
                            held += len(parts[-1][0])
                if held > CELLS:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                    if held > CELLS // 2:  # what follows adds partial counts up
                        yield out(parts[0])
                        parts, held = [], 0
        if parts:
            yield out(merged(parts))
    b = MAX_BINS + 1
    return packed.mapInArrow(count, "code long, n long").selectExpr(
        f"code div {k * b * p * width}L as tree", f"pmod(code div {k * b * p}L, {width}L) + {width}L as node",
        f"cast(pmod(code div {k * b}L, {p}L) as int) as f", f"cast(pmod(code div {k}L, {b}L) as int) as bin", f"cast(pmod(code, {k}L) as int) as y", "n")


def _level(cells: DataFrame, k: int) -> list:
    """Per (tree, node): class counts t0…, and f, bin of the best split where there is one."""
    names = [f"c{i}" for i in range(k)]
    cells = cells.groupBy("tree", "node", "f", "bin").agg(*[F.coalesce(F.sum(F.when(F.col("y") == i, F.col("n"))), F.lit(0)).alias(c) for i, c in enumerate(names)])
    whole = Window.partitionBy("tree", "node", "f")
    along = whole.orderBy("bin")
    sides = cells.select("tree", "node", "f", "bin", F.lead("bin").over(along).alias("more"),
                         *[F.sum(c).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("double").alias(f"l{c}") for c in names],
                         *[F.sum(c).over(whole).alias(f"t{c}") for c in names])
    left = [F.col(f"l{c}") for c in names]
    right = [F.col(f"t{c}").cast("double") - F.col(f"l{c}") for c in names]
    impure = reduce(lambda a, b: a + b, [(F.col(f"t{c}") > 0).cast("int") for c in names]) > 1
    found = F.when(F.col("more").isNotNull() & impure, F.struct((-(_squares(left) + _squares(right))).alias("s"), "f", "bin"))
    return sides.groupBy("tree", "node").agg(F.min(found).alias("b"), *[F.max(f"t{c}").alias(c) for c in names]).collect()


def _tried(trees: int, level: int, p: int, tries: int, seed: int) -> np.ndarray:
    """Features that the nodes of a level may split on."""
    out = np.zeros((trees, 2 ** level, p), dtype=bool)
    for t in range(trees):
        for q in range(2 ** level):
            out[t, q, sorted(range(p), key=lambda f: (hashlib.md5(f"{seed}:{t}:{2 ** level + q}:{f}".encode()).hexdigest(), f))[:tries]] = True
    return out


@dataclass
class BaggedForest:
    """``nodes``: rows (tree, node, depth, n, counts, f, bin); node 1 is the root, its children are 2i and 2i + 1."""

    key: str
    target: str
    features: list[str]
    classes: list[str]
    cuts: list[list[float]]
    trees: int
    depth: int
    nodes: list
    spark: object

    @property
    def node_table(self) -> DataFrame:
        """(tree, node, depth, n, counts, feature, threshold); a row goes to 2i + 1 where its value is above the threshold."""
        rows = [(t, i, d, n, c, None if f is None else self.features[f], None if f is None else self.cuts[f][b]) for t, i, d, n, c, f, b in self.nodes]
        return self.spark.createDataFrame(rows, "tree int, node long, depth int, n long, counts array<long>, feature string, threshold double")

    @property
    def importances(self) -> DataFrame:
        """O2: (feature, importance, rank): each tree's impurity taken away as shares, averaged over the trees that split."""
        weight = {(t, i): sum(float(v) * v for v in c) / n for t, i, _, n, c, _, _ in self.nodes}
        gain = np.zeros((self.trees, len(self.features)))
        for t, i, _, _, _, f, _ in self.nodes:
            if f is not None:
                gain[t, f] += weight[t, 2 * i] + weight[t, 2 * i + 1] - weight[t, i]
        whole = gain.sum(axis=1, keepdims=True)
        share = (gain / np.where(whole > 0, whole, 1))[whole[:, 0] > 0]
        mean = share.mean(axis=0) if len(share) else np.zeros(len(self.features))
        ranked = sorted(zip(self.features, mean.tolist()), key=lambda r: (-r[1], r[0]))
        return self.spark.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(ranked)], "feature string, importance double, rank int")

    def predict(self, df: DataFrame) -> DataFrame:
        """V1: key, prediction (class), confidence and probabilities (class → percent): mean of the leaves' class shares."""
        heap, k = 2 ** (self.depth + 1), max(1, len(self.classes))
        feature, cut, share = np.full((self.trees, heap), -1), np.zeros((self.trees, heap), int), np.zeros((self.trees, heap, k))
        for t, i, _, n, c, f, b in self.nodes:
            share[t, i] = np.array(c) / n
            if f is not None:
                feature[t, i], cut[t, i] = f, b
        packed = self.spark.sparkContext.broadcast((feature, cut, share))
        cuts, classes, trees, depth = self.cuts, self.classes, self.trees, self.depth
        voters = max(1, sum(n[1] == 1 for n in self.nodes))  # on a few rows a bag can be empty

        def score(batches):
            feature, cut, share = packed.value
            for b in batches:
                x = b.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(cuts))
                code = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
                p = np.zeros((b.num_rows, k))
                for t in range(trees):
                    p += share[t, _walk(code, feature[t], cut[t], depth)]
                p = np.round(p / voters * 100, 9)  # sums of equal shares in another order must tie
                best = p.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("__k"), pa.array([classes[i] for i in best], pa.string()), pa.array(p[np.arange(len(p)), best]),
                                                  pa.array(p.tolist(), pa.list_(pa.float64()))], ["__k", "prediction", "confidence", "p"])
        kind = df.schema[self.key].dataType.simpleString()
        out = df.select(F.col(f"`{self.key}`").alias("__k"), _feature_array(self.features).alias("__x")).mapInArrow(
            score, f"__k {kind}, prediction string, confidence double, p array<double>")
        names = F.array(*[F.lit(c) for c in classes])
        return out.select(F.col("__k").alias(self.key), "prediction", "confidence", F.map_from_arrays(names, "p").alias("probabilities"))


def bagged_forest(df: DataFrame, key: str, target: str, features: list[str], trees: int = 100, depth: int = 10, bins: int = 32,
                  tries: int | None = None, seed: int = 42) -> BaggedForest:
    """Fit ``trees`` trees of at most ``depth`` levels of splits (up to 14) on all rows of ``df`` that have a target."""
    if not 0 <= depth <= MAX_DEPTH or not 2 <= bins <= MAX_BINS or trees < 1:
        raise ValueError(f"depth must lie in 0..{MAX_DEPTH}, bins in 2..{MAX_BINS}, trees above 0")
    spark, p = df.sparkSession, len(features)
    known = df.where(F.col(f"`{target}`").isNotNull()).withColumn("__y", F.col(f"`{target}`").cast("string"))
    counts = value_counts(known.select("__y"), ["__y"], MAX_CLASSES).get("__y")
    if counts is None:
        raise ValueError(f"'{target}' has more than {MAX_CLASSES} values")
    if not counts:
        raise ValueError("no row with a target to fit on")
    classes = sorted(v for v, _ in counts)
    k = len(classes)
    y = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("__y")).cast("int") - 1
    rows = spread(known.select(_id(key).alias("id"), _feature_array(features).alias("x"), y.alias("y")))
    cuts = _cuts(rows, p, bins, seed)
    packed = cut_lineage(_pack(rows, cuts, trees, seed))
    tries = tries or max(1, math.isqrt(p))
    heap = 2 ** (depth + 1)
    feature, cut = np.full((trees, heap), -1), np.zeros((trees, heap), int)
    nodes: list = []
    for level in range(depth + 1):
        allowed = _tried(trees, level, p, tries, seed)
        shared = spark.sparkContext.broadcast((feature, cut, allowed))
        found = _level(_counts(packed, shared, allowed, level, k), k)
        for r in found:
            c = [r[f"c{i}"] for i in range(k)]
            f, b = (r["b"]["f"], r["b"]["bin"]) if r["b"] is not None and level < depth else (None, None)
            nodes.append((r["tree"], r["node"], level, sum(c), c, f, b))
            if f is not None:
                feature[r["tree"], r["node"]], cut[r["tree"], r["node"]] = f, b
        shared.unpersist()
        if not any(n[2] == level and n[5] is not None for n in nodes):
            break
    return BaggedForest(key, target, features, classes, cuts, trees, depth, nodes, spark)
