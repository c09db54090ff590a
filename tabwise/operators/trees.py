"""M1 random forest and M3 decision tree (+ G14 accuracy / CV score, O2 importances, V1 class scoring).

Trees split binned features (``max_bins``) by Gini gain, as Spark ML's do: cut points from a bounded sample (``CUT_ROWS``
rows of least hash of the key), bags of Poisson(1) counts, ⌈√p⌉ features tried at a node of a forest, sibling leaves of
one class merged. The sample serves the cuts alone; every row is counted.

Rows that share all bins, the class and the fold cannot be told apart by such a tree, so a fit counts them once: one pass
turns the table into cells (bins, class, fold, n), never more than the rows. n draws of Poisson(1) add up to one of Poisson(n),
so the bag of a cell has the distribution of the bags of its rows. Draws follow from the seed, the tree and the cell's bucket
(a hash), not from the layout. All trees of all folds grow level by level in one pass over the cells: tasks count
(node, feature, bin, class) in NumPy, partial counts meet by tree and block of nodes, and one row per split node reaches
the driver. The held-out fit and the CV fit of the same fold are one fit.

The class labels are mapped to 0…c-1 from the target's sorted distinct values (at most ``max_classes``, a bounded map).
Rows without a target take no part in a fit; NULL and NaN features stand above all numbers.

``best_split`` is the exact CART root split on one feature (Gini), built from grouped counts and distributed
prefix sums — the deterministic check of the split criterion.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .graph import dense_index
from .prep import PrepModel, fit_prep
from .stats import fold_of, value_counts

CUT_ROWS, BUCKET_CELLS, TASK_CELLS, BLOCK_NODES = 10_000, 8192, 131_072, 256


class GrownTree:
    """Nodes in arrays: ``feature`` (−1: leaf), ``cut`` (bins up to it go left), ``left`` (the right child follows it),
    ``counts`` by class, ``gain``."""

    def __init__(self, k: int):
        self.feature, self.cut, self.left = np.array([-1], np.int16), np.array([0], np.int16), np.array([0])
        self.counts, self.gain = np.zeros((1, k)), np.zeros(1)

    def split(self, at: np.ndarray, f, cut, left, right, gain) -> np.ndarray:
        """Split nodes ``at``; returns the new nodes."""
        if not len(at):
            return np.array([], np.int64)
        first = len(self.feature) + 2 * np.arange(len(at))
        self.feature[at], self.cut[at], self.left[at], self.gain[at] = f, cut, first, gain
        m = 2 * len(at)
        self.feature = np.concatenate([self.feature, np.full(m, -1, np.int16)])
        self.cut, self.left = np.concatenate([self.cut, np.zeros(m, np.int16)]), np.concatenate([self.left, np.zeros(m, np.int64)])
        self.gain = np.concatenate([self.gain, np.zeros(m)])
        self.counts = np.concatenate([self.counts, np.stack([left, right], axis=1).reshape(m, -1)])
        return np.arange(first[0], first[0] + m)

    def merged(self) -> GrownTree:
        """Sibling leaves of one class become one leaf."""
        best = self.counts.argmax(axis=1)
        for i in range(len(self.feature) - 1, -1, -1):  # children stand behind their parents
            a = self.left[i]
            if self.feature[i] >= 0 and self.feature[a] < 0 and self.feature[a + 1] < 0 and best[a] == best[a + 1]:
                self.feature[i] = -1
        return self

    def inner(self) -> list[int]:
        """Split nodes that are still reached from the root."""
        out, todo = [], [0]
        while todo:
            i = todo.pop()
            if self.feature[i] >= 0:
                out.append(i)
                todo += [int(self.left[i]), int(self.left[i]) + 1]
        return out

    def depth(self, i: int = 0) -> int:
        level, deep = [i], -1
        while level:
            deep += 1
            level = [c for j in level if self.feature[j] >= 0 for c in (int(self.left[j]), int(self.left[j]) + 1)]
        return deep


def _walk(code: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Node in which each row of ``code`` ends."""
    node = np.zeros(len(code), np.int64)
    at = np.arange(len(code)) if feature[0] >= 0 else np.array([], np.int64)
    while len(at):
        now = node[at]
        now = left[now] + (code[at, feature[now]] > cut[now])
        node[at] = now
        at = at[feature[now] >= 0]
    return node


def _votes(code: np.ndarray, trees: list) -> np.ndarray:
    """Mean of the leaves' class shares; ``trees`` holds (feature, cut, left, shares)."""
    out = np.zeros((len(code), trees[0][3].shape[1]))
    for feature, cut, left, share in trees:
        out += share[_walk(code, feature, cut, left)]
    return out / len(trees)


def _coded(x, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins of a column of feature arrays; a NULL stands with NaN above all cuts."""
    v = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), len(cuts))
    return np.column_stack([np.searchsorted(c, v[:, j], side="left") for j, c in enumerate(cuts)]).astype(np.uint8)


def feature_cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins`` − 1 cuts: midpoints between all distinct values, or between those nearest to equal shares."""
    v, n = np.unique(values[np.isfinite(values)], return_counts=True)
    mid = (v[:-1] + v[1:]) / 2
    if len(mid) <= bins - 1:
        return mid
    stride = len(values) / bins
    upto, want, out = np.cumsum(n), stride, []
    for i in range(1, len(v)):
        if abs(upto[i - 1] - want) < abs(upto[i] - want):
            out.append(mid[i - 1])
            want += stride
    return np.array(out[:bins - 1])


@dataclass
class TreeModel:
    kind: str
    key: str
    target: str
    features: list[str]
    classes: list[str]
    trees: list[GrownTree]
    cuts: list[np.ndarray]
    prep: PrepModel | None
    held_out: DataFrame       # key, x, label of the test fold
    accuracy: float | None    # on the test fold
    cv_scores: list[float]

    @property
    def metrics(self) -> DataFrame:
        spark = self.held_out.sparkSession
        rows = [("accuracy", self.accuracy)]
        if self.cv_scores:
            rows.append(("cv_score", float(sum(self.cv_scores) / len(self.cv_scores))))
        if self.kind == "tree":
            rows += [("depth", float(self.depth)), ("leaves", float(self.leaves))]
        else:
            rows.append(("trees", float(len(self.trees))))
        return spark.createDataFrame(rows, "metric string, value double")

    @property
    def leaves(self) -> int:
        return len(self.trees[0].inner()) + 1

    @property
    def depth(self) -> int:
        return self.trees[0].depth()

    @property
    def rules(self) -> str:
        """M3: the splits as text, with column names, category values and class names."""
        kinds = self.prep.categories if self.prep is not None else {}
        t = self.trees[0]

        def split(f, sign, cut):
            if f not in kinds:
                return f"{f} {sign} {cut!r}"
            side = [v for code, v in enumerate(kinds[f]) if (code <= cut) == (sign == "<=")]
            return f"{f} in {{{', '.join(map(str, side))}}}"

        lines, todo = [], [(0, 2, None)]
        while todo:
            i, pad, text = todo.pop()
            if text is not None:
                lines.append(text)
            if i is None:
                continue
            if t.feature[i] < 0:
                lines.append(" " * pad + f"Predict: {self.classes[int(t.counts[i].argmax())]}")
                continue
            f, cut, a = self.features[t.feature[i]], float(self.cuts[t.feature[i]][t.cut[i]]), int(t.left[i])
            lines.append(" " * pad + f"If ({split(f, '<=', cut)})")
            todo += [(a + 1, pad + 1, " " * pad + f"Else ({split(f, '>', cut)})"), (a, pad + 1, None)]
        n = 2 * self.leaves - 1
        return "\n".join([f"Tree: depth={self.depth}, numNodes={n}, numClasses={len(self.classes)}, numFeatures={len(self.features)}",
                          *lines, ""])

    @property
    def importances(self) -> DataFrame:
        """O2: (feature, importance), importances sum to 1, ranked descending."""
        spark = self.held_out.sparkSession
        imp = np.zeros(len(self.features))
        for t in self.trees:
            own = np.zeros(len(imp))
            for i in t.inner():
                own[t.feature[i]] += t.gain[i] * t.counts[i].sum()
            imp += own / own.sum() if own.sum() > 0 else 0
        rows = [(f, float(v)) for f, v in zip(self.features, imp / imp.sum() if imp.sum() > 0 else imp)]
        df = spark.createDataFrame(rows, "feature string, importance double")
        return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))

    def _scored(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` and the class shares ``p`` of the rows of ``df`` (with their features as array ``x``)."""
        packed = df.sparkSession.sparkContext.broadcast(_packed(self.trees))
        cuts = self.cuts

        def score(batches):
            for b in batches:
                p = _votes(_coded(b.column("x"), cuts), packed.value)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(list(p), pa.list_(pa.float64()))], [*keep, "p"])
        schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
        return df.select(*keep, "x").mapInArrow(score, f"{schema}, p array<double>")

    @property
    def test_pred(self) -> DataFrame:
        """(key, label, prediction) of the held-out rows."""
        best = F.array_position("p", F.array_max("p")) - 1
        return self._scored(self.held_out, [self.key, "label"]).select(self.key, "label", best.cast("double").alias("prediction"))

    def predict(self, df: DataFrame) -> DataFrame:
        """V1 (class): one row per input: key, target_col, prediction, confidence %, probabilities (every class
        with its share in %), missing_filled (the features that were blank)."""
        data = self.prep.transform(df) if self.prep is not None else df
        out = self._scored(data.select(self.key, _features(self.features)), [self.key])
        probs = F.col("p")
        classes = F.array(*[F.lit(c) for c in self.classes])
        filled = (self.prep.filled_list(df, self.features) if self.prep is not None
                  else F.expr("cast(array() as array<string>)"))
        scored = out.select(self.key, F.lit(self.target).alias("target_col"),
                            F.element_at(classes, F.array_position("p", F.array_max("p")).cast("int")).alias("prediction"),
                            (F.array_max(probs) * 100).alias("confidence"),
                            F.arrays_zip(classes.alias("class"), F.transform(probs, lambda p: p * 100)
                                         .alias("probability")).alias("probabilities"))
        return scored.join(df.select(self.key, filled.alias("missing_filled")), self.key)


def _packed(trees: list[GrownTree]) -> list:
    return [(t.feature, t.cut, t.left, t.counts / np.maximum(t.counts.sum(axis=1, keepdims=True), 1)) for t in trees]


def _features(features: list[str]):
    return F.array(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(float("nan"))) for f in features]).alias("x")


def _label_map(df: DataFrame, target: str, max_classes: int) -> list[str]:
    counts = value_counts(df.select(F.col(target).cast("string").alias(target)), [target], max_classes)[target]
    if counts is None:
        raise ValueError(f"target {target!r} has more than {max_classes} classes")
    return [v for v, _ in counts]


def count_cells(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """Rows (x, label, fold) as counted cells, written as one row per bucket: bucket, bins, y, fold, n (bytes)."""
    def code(batches):
        for b in batches:
            c = _coded(b.column("x"), cuts)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in c], pa.binary()), b.column("y"), b.column("fold")],
                                             ["bins", "y", "fold"])

    named = rows.where("label is not null and fold is not null").select("x", F.col("label").cast("int").alias("y"), F.col("fold").cast("int"))
    cells = cut_lineage(named.mapInArrow(code, "bins binary, y int, fold int").groupBy("bins", "y", "fold").agg(F.count(F.lit(1)).alias("n")))
    buckets = max(1, math.ceil(cells.count() / BUCKET_CELLS))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("bins", "ascending"), ("y", "ascending"), ("fold", "ascending")])
        return pa.table({"bucket": t.column("bucket")[:1], "bins": [b"".join(t.column("bins").to_pylist())],
                         **{c: [t.column(c).to_numpy().astype(np.int64).tobytes()] for c in ("y", "fold", "n")}})

    bucket = F.pmod(F.xxhash64("bins", "y", "fold"), F.lit(buckets)).cast("int").alias("bucket")
    blobs = cells.select(bucket, "bins", "y", "fold", "n").groupBy("bucket").applyInArrow(
        pack, "bucket int, bins binary, y binary, fold binary, n binary")
    tasks = min(buckets, max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(buckets * BUCKET_CELLS / TASK_CELLS)))
    return cut_lineage(blobs.repartition(tasks, "bucket"))


def _unpack(batches, p: int) -> list:
    """(bucket, bins, y, fold, n) of each bucket."""
    out = []
    for b in batches:
        for r in b.to_pylist():
            y, fold, n = (np.frombuffer(r[c], np.int64) for c in ("y", "fold", "n"))
            out.append((r["bucket"], np.frombuffer(r["bins"], np.uint8).reshape(-1, p), y, fold, n))
    return out


def _gini(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    out = np.ones(total.shape)
    for c in range(counts.shape[-1]):
        share = counts[..., c] / np.maximum(total, 1)
        out = out - share * share
    return out


def best_bins(hist: np.ndarray):
    """hist (nodes, tries, bins, classes) → per node: gain, place of the feature among the tries, bin, left counts, all counts."""
    along = hist.cumsum(axis=2)
    whole = along[:, :, -1:, :]
    rest = whole - along
    nl, nr = along.sum(axis=3), rest.sum(axis=3)
    n = (nl + nr)[:, :, -1:]
    gain = _gini(whole, n) - nl / np.maximum(n, 1) * _gini(along, nl) - nr / np.maximum(n, 1) * _gini(rest, nr)
    gain = np.where((nl > 0) & (nr > 0), gain, -1.0).reshape(len(hist), -1)
    best = gain.argmax(axis=1)
    at = np.arange(len(hist))
    j, b = best // hist.shape[2], best % hist.shape[2]
    return gain[at, best], j, b, along[at, j, b], whole[at, j, 0]


def grow(cells: DataFrame, p: int, k: int, bins: int, trees: int, depth: int, left_out: list[int], bag: bool, tries: int,
         seed: int) -> list[list[GrownTree]]:
    """For every fold of ``left_out``, ``trees`` trees grown on the cells of the other folds."""
    sc = cells.sparkSession.sparkContext
    made = [GrownTree(k) for _ in range(len(left_out) * trees)]  # by fold, then tree
    front = {g: np.array([0]) for g in range(len(made))}
    for level in range(max(depth, 1)):
        tried = {}
        for g, nodes in front.items():
            rng = np.random.default_rng([seed, g % trees, level])
            tried[g] = np.sort(rng.random((len(nodes), p)).argsort(axis=1)[:, :tries], axis=1)
        shared = sc.broadcast(({g: (made[g].feature, made[g].cut, made[g].left, nodes, tried[g]) for g, nodes in front.items()}))

        def count(batches, shared=shared):
            now = shared.value
            parts = _unpack(batches, p)
            if not parts:
                return
            code = np.concatenate([b for _, b, _, _, _ in parts]).astype(np.int64)
            y, fold, n = (np.concatenate([x[i] for x in parts]) for i in (2, 3, 4))
            for t in range(trees):
                mine = [g for g in range(t, len(left_out) * trees, trees) if g in now]
                if not mine:
                    continue
                w = np.concatenate([np.random.default_rng([seed, t, x[0]]).poisson(x[4]) for x in parts]) if bag else n
                for g in mine:
                    feature, cut, left, nodes, tried = now[g]
                    rows = np.flatnonzero((w > 0) & (fold != left_out[g // trees]))
                    slot = np.full(len(feature), -1)
                    slot[nodes] = np.arange(len(nodes))
                    s = slot[_walk(code[rows], feature, cut, left)]
                    rows, s = rows[s >= 0], s[s >= 0]
                    if not len(rows):
                        continue
                    at = np.concatenate([((s * tries + j) * bins + code[rows, tried[s, j]]) * k + y[rows] for j in range(tries)])
                    size = BLOCK_NODES * tries * bins * k
                    some, where = np.unique(at, return_inverse=True) if len(nodes) * tries * bins * k > 4 * len(at) else (None, at)
                    total = np.bincount(where, weights=np.tile(w[rows], tries))
                    if some is None:
                        some = np.flatnonzero(total)
                        total = total[some]
                    block = some // size
                    ends = np.flatnonzero(np.diff(block, append=-1)) + 1
                    for a, e in zip([0, *ends[:-1].tolist()], ends.tolist()):
                        yield pa.RecordBatch.from_pydict({
                            "g": pa.array([g], pa.int32()), "block": pa.array([block[a]], pa.int32()),
                            "at": pa.array([(some[a:e] - block[a] * size).astype(np.int64).tobytes()], pa.binary()),
                            "n": pa.array([total[a:e].astype(np.int64).tobytes()], pa.binary())})

        def choose(t: pa.Table) -> pa.Table:
            hist = np.zeros(BLOCK_NODES * tries * bins * k, np.int64)
            for at, n in zip(t.column("at").to_pylist(), t.column("n").to_pylist()):
                hist[np.frombuffer(at, np.int64)] += np.frombuffer(n, np.int64)
            hist = hist.reshape(BLOCK_NODES, tries, bins, k)
            at = np.flatnonzero(hist[:, 0].any(axis=(1, 2)))
            gain, j, b, left, whole = best_bins(hist[at].astype(float))
            g, block = t.column("g")[0].as_py(), t.column("block")[0].as_py()
            return pa.table({"g": pa.array([g] * len(at), pa.int32()), "slot": block * BLOCK_NODES + at, "j": j, "bin": b, "gain": gain,
                             "l": pa.array(list(left), pa.list_(pa.float64())), "c": pa.array(list(whole), pa.list_(pa.float64()))})

        found = cells.mapInArrow(count, "g int, block int, at binary, n binary").groupBy("g", "block").applyInArrow(
            choose, "g int, slot long, j long, bin long, gain double, l array<double>, c array<double>").toArrow()
        shared.unpersist()
        got = {c: found.column(c).to_numpy() for c in ("g", "slot", "j", "bin", "gain")}
        lists = [np.array(found.column(c).to_pylist(), float).reshape(-1, k) for c in ("l", "c")]
        following = {}
        for g, nodes in front.items():
            r = np.flatnonzero(got["g"] == g)
            r = r[np.argsort(got["slot"][r])]
            tree, at = made[g], nodes[got["slot"][r]]
            tree.counts[at] = lists[1][r]
            if depth < 1:
                continue
            r, at = r[got["gain"][r] > 0], at[got["gain"][r] > 0]
            f = tried[g][got["slot"][r], got["j"][r]]
            new = tree.split(at, f, got["bin"][r], lists[0][r], lists[1][r] - lists[0][r], got["gain"][r])
            new = new[(tree.counts[new] > 0).sum(axis=1) > 1]
            if len(new):
                following[g] = new
        front = following
        if not front:
            break
    return [[t.merged() for t in made[i * trees:(i + 1) * trees]] for i in range(len(left_out))]


def cell_accuracy(cells: DataFrame, p: int, models: dict[int, list[GrownTree]]) -> dict[int, float]:
    """Share of the rows of each fold whose class the fold's model gives."""
    packed = cells.sparkSession.sparkContext.broadcast({f: _packed(m) for f, m in models.items()})

    def score(batches):
        for _, code, y, fold, n in _unpack(batches, p):
            for f, trees in packed.value.items():
                r = np.flatnonzero(fold == f)
                if len(r):
                    right = _votes(code[r].astype(np.int64), trees).argmax(axis=1) == y[r]
                    yield pa.RecordBatch.from_pydict({"fold": pa.array([f], pa.int32()), "good": [int(n[r][right].sum())], "n": [int(n[r].sum())]})
    got = cells.mapInArrow(score, "fold int, good long, n long").groupBy("fold").agg((F.sum("good") / F.sum("n")).alias("a")).collect()
    packed.unpersist()
    return {r["fold"]: r["a"] for r in got}


def _classifier(kind: str, df: DataFrame, key: str, target: str, features: list[str] | None, depth: int,
                trees: int, seed: int, folds: int, test_fold: int, cv: bool, max_bins: int, max_classes: int,
                prep: bool, split_col: str | None) -> TreeModel:
    if not 2 <= max_bins <= 256:
        raise ValueError("max_bins must lie in 2..256")
    pm = fit_prep(df, key=key, columns=[c for c in df.columns if c not in (key, split_col)]) if prep else None
    keep = [split_col] if split_col and split_col != key else []
    data = pm.transform(df, keep=keep) if pm else df
    feats = features or [c for c in (pm.columns if pm else df.columns) if c not in (key, target, split_col)]
    classes = _label_map(df, target, max_classes)
    if not classes:
        raise ValueError("no row with a target to fit on")
    if pm is not None and target in pm.categories:
        # the cleaned target holds codes; map codes back to the raw class text for labelling
        raw = F.element_at(F.array(*[F.lit(v) for v in pm.categories[target]]), F.col(target).cast("int") + 1)
    else:
        raw = F.col(target).cast("string")
    label = (F.array_position(F.array(*[F.lit(c) for c in classes]), raw) - 1).cast("double")
    fold_col = fold_of(split_col or key, folds, data).alias("fold")
    base = data.select(F.col(f"`{key}`"), label.alias("label"), fold_col, _features(feats))
    p, bag = len(feats), kind == "forest"
    sample = (base.where((F.col("fold") != F.lit(test_fold)) & F.col("label").isNotNull())
              .select(F.xxhash64(key, F.lit(seed)).alias("h"), "x").orderBy("h", "x").limit(CUT_ROWS).select("x").toArrow())
    if not sample.num_rows:
        raise ValueError("no row to fit on outside the test fold")
    x = sample.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
    cuts = [feature_cuts(x[:, j], max_bins) for j in range(p)]
    cells = count_cells(base, cuts)
    left_out = sorted({test_fold, *(range(folds) if cv and folds > 1 else [])})
    tries = math.ceil(math.sqrt(p)) if bag and trees > 1 else p
    grown = dict(zip(left_out, grow(cells, p, len(classes), max_bins, trees, depth, left_out, bag, tries, seed)))
    right = cell_accuracy(cells, p, grown)
    scores = [right.get(f, 0.0) for f in range(folds)] if cv and folds > 1 else []
    return TreeModel(kind=kind, key=key, target=target, features=feats, classes=classes, trees=grown[test_fold], cuts=cuts,
                     prep=pm, held_out=base.where(F.col("fold") == F.lit(test_fold)), accuracy=right.get(test_fold), cv_scores=scores)


def tree(df: DataFrame, key: str, target: str, features: list[str] | None = None, depth: int = 6,
         folds: int = 5, test_fold: int = 0, cv: bool = True, max_bins: int = 64, max_classes: int = 50,
         seed: int = 42, prep: bool = True, split_col: str | None = None) -> TreeModel:
    """M3: CART-style decision tree; depth 0/None means the default 6."""
    return _classifier("tree", df, key, target, features, depth or 6, 1, seed, folds, test_fold, cv, max_bins,
                       max_classes, prep, split_col)


def forest(df: DataFrame, key: str, target: str, features: list[str] | None = None, trees: int = 100,
           depth: int = 10, folds: int = 5, test_fold: int = 0, cv: bool = True, max_bins: int = 64,
           max_classes: int = 50, seed: int = 42, prep: bool = True, split_col: str | None = None) -> TreeModel:
    """M1: random forest of ``trees`` trees (mean of their class shares)."""
    return _classifier("forest", df, key, target, features, depth, trees, seed, folds, test_fold, cv, max_bins,
                       max_classes, prep, split_col)


def prefix_sums(df: DataFrame, order_col: str, cols: list[str]) -> DataFrame:
    """Running sums of ``cols`` in ascending ``order_col`` (values distinct), without a single-partition
    window: range-partition and write the rows with their partition number once (totals and running sums then
    come from the same split), total each partition (one row per partition to the driver), then add the
    partition's offset to a running sum inside the partition."""
    parts = cut_lineage(df.repartitionByRange(order_col).withColumn("__pid", F.spark_partition_id()))
    totals = sorted(parts.groupBy("__pid").agg(*[F.sum(c).alias(c) for c in cols]).collect(),
                    key=lambda r: r["__pid"])
    run = {c: 0 for c in cols}
    offs = []
    for r in totals:
        offs.append((r["__pid"], *[run[c] for c in cols]))
        for c in cols:
            run[c] += r[c] or 0
    spark = df.sparkSession
    schema = "__pid int, " + ", ".join(f"__o_{c} long" for c in cols)
    off = spark.createDataFrame(offs or [(0, *[0] * len(cols))], schema)
    w = Window.partitionBy("__pid").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    return (parts.join(F.broadcast(off), "__pid")
            .select("*", *[(F.col(f"__o_{c}") + F.sum(c).over(w)).alias(f"cum_{c}") for c in cols])
            .drop("__pid", *[f"__o_{c}" for c in cols]))


def best_split(df: DataFrame, feature: str, label: str) -> DataFrame:
    """Exact CART root split of a binary 0/1 label on one feature: the threshold (midpoint between adjacent
    distinct values) with the lowest weighted Gini impurity; ties → lowest threshold.
    Returns one row (feature, threshold, gini, n_left, n_right)."""
    x = F.col(feature).cast("double")
    y = F.col(label).cast("int")
    per_value = df.groupBy(x.alias("v")).agg(F.sum((y == 0).cast("long")).alias("c0"),
                                             F.sum((y == 1).cast("long")).alias("c1"))
    tot = per_value.agg(F.sum("c0").alias("t0"), F.sum("c1").alias("t1")).first()
    t0, t1 = int(tot["t0"] or 0), int(tot["t1"] or 0)
    cum = prefix_sums(per_value, "v", ["c0", "c1"])
    # the next distinct value comes from the dense 0…n-1 index of the values (i joins i + 1)
    idx = dense_index(per_value, "v", "i")
    cur = cum.join(idx, "v")
    following = idx.select((F.col("i") - 1).alias("i"), F.col("v").alias("nv"))
    cand = cur.join(following, "i")
    n = float(t0 + t1)
    l0, l1 = F.col("cum_c0"), F.col("cum_c1")
    nl = l0 + l1
    nr = F.lit(t0 + t1) - nl
    r0, r1 = F.lit(t0) - l0, F.lit(t1) - l1
    gl = 1 - (l0 / nl) ** 2 - (l1 / nl) ** 2
    gr = 1 - (r0 / nr) ** 2 - (r1 / nr) ** 2
    g = (nl / n) * gl + (nr / n) * gr
    scored = cand.select(F.lit(feature).alias("feature"), ((F.col("v") + F.col("nv")) / 2).alias("threshold"),
                         g.alias("gini"), nl.alias("n_left"), nr.alias("n_right"))
    best = scored.agg(F.min(F.struct("gini", "threshold", "feature", "n_left", "n_right")).alias("b"))
    return best.select("b.feature", "b.threshold", "b.gini", "b.n_left", "b.n_right")
