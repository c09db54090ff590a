"""Least and mean distance from each query to the members of each cluster, without all pairs.

Members are dealt to compact chunks by k-d cuts (from a bounded sample, for the layout alone; equal points are counted
once) and each chunk's members of a cluster become a k-d tree. A node keeps the weights of its points on a grid of Chebyshev nodes
(16 a feature, one where the node has no extent): for queries at least 1.5 times its longest side away, the distances to
the grid, so weighted, add up to those of its points. There the distance is analytic in each feature with its next
singularity outside the ellipse of parameter 3 + √10, so 16 nodes leave a relative error near 1e-13, that of adding up the
pairs. Nodes that are nearer are opened, leaves are counted point by point. Least distances are exact: nodes are left out only
where their box is farther than a member is known to be.

Blocks of near-by queries meet chunks in cogrouped calls that hand on one row per (query, cluster). A query's work is
a few hundred grid nodes or points per chunk and level instead of every member.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

NODES, FAR, LEAF, MAX_FEATURES = 16, 3.0, 512, 3
CHUNK_POINTS, GROUP_QUERIES, BLOCK_QUERIES, SAMPLE = 200_000, 50_000, 256, 20_000
_THETA = (np.arange(NODES) + 0.5) * np.pi / NODES
_BACK = np.cos(np.arange(NODES)[:, None] * _THETA) * np.where(np.arange(NODES) == 0, 1, 2)[:, None] / NODES


def _shares(u: np.ndarray) -> np.ndarray:
    """Lagrange polynomials of the Chebyshev nodes at u in [−1, 1]."""
    return np.cos(np.arccos(np.clip(u, -1, 1))[:, None] * np.arange(NODES)) @ _BACK


def _grid(lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    return [(a + b) / 2 + (b - a) / 2 * np.cos(_THETA) if b > a else np.array([a]) for a, b in zip(lo, hi)]


def grid_weights(x: np.ndarray, w: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Weights of points on the grid of their box, features in order."""
    out = w[:, None].astype(float)
    last = None
    for j in range(x.shape[1]):
        s = _shares((x[:, j] - (lo[j] + hi[j]) / 2) / ((hi[j] - lo[j]) / 2)) if hi[j] > lo[j] else np.ones((len(x), 1))
        if j == x.shape[1] - 1:
            last = s
        else:
            out = (out[:, :, None] * s[:, None, :]).reshape(len(x), -1)
    return (out.T @ last).ravel()


def _far(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Distances of queries to the grid of a box."""
    r2 = np.zeros((len(q), 1))
    for j, t in enumerate(_grid(lo, hi)):
        r2 = (r2[:, :, None] + ((q[:, j, None] - t) ** 2)[:, None, :]).reshape(len(q), -1)
    return np.sqrt(r2)


def _near(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    r2 = (q[:, 0, None] - x[:, 0]) ** 2
    for j in range(1, q.shape[1]):
        r2 += (q[:, j, None] - x[:, j]) ** 2
    return np.sqrt(r2)


def _gap(alo, ahi, blo, bhi) -> float:
    """No more than the least distance of two boxes."""
    g = np.maximum(0, np.maximum(alo - bhi, blo - ahi))
    return math.sqrt(float(g @ g)) * (1 - 1e-12)


def split_points(x: np.ndarray, leaf: int):
    """k-d tree: order of the points, and nodes (start, end, left child or −1); the right child follows the left one."""
    order, nodes, todo = np.arange(len(x)), [[0, len(x), -1]], [0]
    while todo:
        i = todo.pop()
        a, b, _ = nodes[i]
        part = x[order[a:b]]
        extent = part.max(axis=0) - part.min(axis=0)
        if b - a <= leaf or not extent.any():
            continue
        mid = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, extent.argmax()], mid)]
        nodes[i][2] = len(nodes)
        todo += [len(nodes), len(nodes) + 1]
        nodes += [[a, a + mid, -1], [a + mid, b, -1]]
    return order, np.array(nodes)


def _cuts(sample: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Axis and value of each node of a complete tree of cuts with at least ``parts`` leaves."""
    deep = max(0, math.ceil(math.log2(max(1, parts))))
    axis, value, at = np.zeros(2 ** deep, int), np.zeros(2 ** deep), {1: sample}
    for i in range(1, 2 ** deep):
        s = at.pop(i)
        if len(s):
            axis[i] = np.ptp(s, axis=0).argmax()
            value[i] = np.median(s[:, axis[i]])
        right = s[:, axis[i]] > value[i]
        at[2 * i], at[2 * i + 1] = s[~right], s[right]
    return axis, value, deep


def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), d)


def _dealt(df: DataFrame, d: int, parts: int, name: str) -> DataFrame:
    """``df`` with the number of its compact part; rows with a NULL or NaN go to part 0."""
    whole = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))
    s = df.where(whole).select("x").orderBy(F.xxhash64("x"), "x").limit(max(SAMPLE, 64 * parts)).toArrow()
    sample = _matrix(s.column("x").combine_chunks(), d) if s.num_rows else np.zeros((0, d))
    axis, value, deep = _cuts(sample, parts)

    def deal(batches):
        for b in batches:
            x, node = _matrix(b.column("x"), d), np.ones(b.num_rows, np.int64)
            at = np.arange(b.num_rows)
            for _ in range(deep):
                node = 2 * node + (x[at, axis[node]] > value[node])
            node = np.where(np.isfinite(x).all(axis=1), node - 2 ** deep, 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(node.astype(np.int32))], [*b.schema.names, name])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(deal, f"{schema}, {name} int")


def _tree(x: np.ndarray, w: np.ndarray) -> dict:
    """A chunk's members of one cluster as bytes: points in order, weights, nodes, boxes, weights on grids."""
    order, nodes = split_points(x, LEAF)
    x, w = x[order], w[order]
    lo = np.array([x[a:b].min(axis=0) for a, b, _ in nodes])
    hi = np.array([x[a:b].max(axis=0) for a, b, _ in nodes])
    grids, at = [], [0]
    for (a, b, _), u, v in zip(nodes, lo, hi):
        size = NODES ** int((v > u).sum())
        if b - a > size:
            grids.append(grid_weights(x[a:b], w[a:b], u, v))
        at.append(at[-1] + (size if b - a > size else 0))
    return {"x": x.tobytes(), "w": w.astype(np.int64).tobytes(), "nodes": nodes.astype(np.int64).tobytes(), "lo": lo.tobytes(), "hi": hi.tobytes(),
            "at": np.array(at).tobytes(), "grid": np.concatenate([*grids, np.zeros(0)]).tobytes()}


class _Opened:
    def __init__(self, r: dict, d: int):
        f = lambda c, k=np.float64: np.frombuffer(r[c], k)
        self.x, self.w, self.nodes = f("x").reshape(-1, d), f("w", np.int64).astype(float), f("nodes", np.int64).reshape(-1, 3)
        self.lo, self.hi, self.at, self.grid = f("lo").reshape(-1, d), f("hi").reshape(-1, d), f("at", np.int64), f("grid")

    def answer(self, q: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
        """Sum of distances, and least distance where it is at most ``most`` (else more, or infinite)."""
        qlo, qhi = q.min(axis=0), q.max(axis=0)
        total, least, todo, later = np.zeros(len(q)), np.full(len(q), np.inf), [0], []
        while todo:
            i = todo.pop()
            a, b, left = self.nodes[i]
            gap = _gap(qlo, qhi, self.lo[i], self.hi[i])
            if self.at[i + 1] > self.at[i] and gap >= FAR * (self.hi[i] - self.lo[i]).max() / 2:
                total += _far(q, self.lo[i], self.hi[i]) @ self.grid[self.at[i]:self.at[i + 1]]
                later.append((gap, i))
            elif left < 0:
                r = _near(q, self.x[a:b])
                total += r @ self.w[a:b]
                least = np.minimum(least, r.min(axis=1))
            else:
                todo += [left, left + 1]
        later.sort(reverse=True)
        while later:
            gap, i = later.pop()
            if gap > min(most, float(least.max())):
                continue
            a, b, left = self.nodes[i]
            if left < 0:
                least = np.minimum(least, _near(q, self.x[a:b]).min(axis=1))
            else:
                later += [(_gap(qlo, qhi, self.lo[c], self.hi[c]), c) for c in (left, left + 1)]
                later.sort(reverse=True)
        return total, least


def tree_distance_stats(queries: DataFrame, members: DataFrame, d: int) -> DataFrame:
    """Per (key, cluster): min_distance and avg_distance. queries: key, x; members: x, cluster; ``d`` features, at most three.
    NaN where the query or a member of the cluster has a missing feature."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    points = cut_lineage(members.groupBy("x", "cluster").agg(F.count(F.lit(1)).alias("w")))
    chunks = max(1, min(cores, math.ceil(points.count() / 4096)), math.ceil(points.count() / CHUNK_POINTS))

    def build(t: pa.Table) -> pa.Table:
        x, w, cluster = _matrix(t.column("x").combine_chunks(), d), t.column("w").to_numpy(), t.column("cluster").to_numpy()
        good, rows = np.isfinite(x).all(axis=1), []
        for c in np.unique(cluster):
            mine = np.flatnonzero(good & (cluster == c))
            lost = int(w[~good & (cluster == c)].sum())
            tree = _tree(x[mine], w[mine]) if len(mine) else dict.fromkeys(("x", "w", "nodes", "lo", "hi", "at", "grid"), b"")
            # a few boxes that hold members each, for bounds
            some = np.zeros((0, 2 * d))
            if len(mine):
                o = _Opened(tree, d)
                level = [0]
                for _ in range(4):
                    level = [k for i in level for k in ((o.nodes[i, 2], o.nodes[i, 2] + 1) if o.nodes[i, 2] >= 0 else (i,))]
                some = np.hstack([o.lo[level], o.hi[level]])
            rows.append({"chunk": t.column("chunk")[0].as_py(), "cluster": int(c), "n": int(w[mine].sum()) + lost, "lost": lost,
                         "boxes": some.ravel().tolist(), **tree})
        return pa.Table.from_pylist(rows, pa.schema([("chunk", pa.int32()), ("cluster", pa.int32()), ("n", pa.int64()), ("lost", pa.int64()),
                                                     ("boxes", pa.list_(pa.float64())), *[(k, pa.binary()) for k in kinds]]))

    kinds = ("x", "w", "nodes", "lo", "hi", "at", "grid")
    trees = cut_lineage(_dealt(points, d, chunks, "chunk").groupBy("chunk").applyInArrow(
        build, "chunk int, cluster int, n long, lost long, boxes array<double>, " + ", ".join(f"{k} binary" for k in kinds)))
    # sixteen boxes for a chunk and cluster
    bounds: dict[int, list] = {}
    for r in trees.select("cluster", "boxes").toLocalIterator():
        bounds.setdefault(r["cluster"], []).append(np.array(r["boxes"], float).reshape(-1, 2, d))
    shared = queries.sparkSession.sparkContext.broadcast({c: np.concatenate(b) for c, b in bounds.items()})
    numbers = [r["chunk"] for r in trees.select("chunk").distinct().collect()]

    def meet(q: pa.Table, t: pa.Table) -> pa.Table:
        out = {"key": [], "cluster": [], "min_d": [], "sum_d": [], "n": []}

        def add(key, c, least, total, n):
            for name, v in zip(out, (key, np.full(len(key), c, np.int32), least, total, np.full(len(key), n, np.int64))):
                out[name].append(v)
        if q.num_rows and t.num_rows:
            x, key = _matrix(q.column("x").combine_chunks(), d), q.column("key").to_numpy()
            good = np.isfinite(x).all(axis=1)
            lost, key, x = key[~good], key[good], x[good]
            order, nodes = split_points(x, BLOCK_QUERIES) if len(x) else ([], [])
            blocks = [order[s:min(b, s + BLOCK_QUERIES)] for a, b, left in nodes if left < 0 for s in range(a, b, BLOCK_QUERIES)]
            for r in t.to_pylist():
                c, n = r["cluster"], r["n"]
                if len(lost):
                    nan = np.full(len(lost), np.nan)
                    add(lost, c, nan, nan, n)
                opened = _Opened(r, d) if n > r["lost"] else None
                for rows in blocks:
                    least, total = np.full(len(rows), np.inf), np.zeros(len(rows))
                    if opened is not None:
                        p, boxes = x[rows], shared.value[c]
                        reach = np.maximum(p.max(axis=0) - boxes[:, 0], boxes[:, 1] - p.min(axis=0))
                        total, least = opened.answer(p, math.sqrt(float((reach * reach).sum(axis=1).min())) * (1 + 1e-12))
                    add(key[rows], c, least, total + (np.nan if r["lost"] else 0), n)
        empty = {"key": np.int64, "cluster": np.int32, "n": np.int64}
        return pa.table({k: np.concatenate([np.zeros(0, empty.get(k, float)), *v]).astype(empty.get(k, float)) for k, v in out.items()})

    groups = max(1, math.ceil(queries.count() / GROUP_QUERIES))
    left = _dealt(queries.select("key", "x"), d, groups, "g").withColumn("chunk", F.explode(F.lit(numbers or [0]).cast("array<int>")))
    gs = F.explode(F.sequence(F.lit(0), F.lit(2 ** max(0, math.ceil(math.log2(groups))) - 1))).alias("t_g")
    right = trees.drop("boxes").withColumnRenamed("chunk", "t_chunk").select("*", gs)
    part = left.groupBy("g", "chunk").cogroup(right.groupBy("t_g", "t_chunk")).applyInArrow(
        meet, "key long, cluster int, min_d double, sum_d double, n long")
    mean = F.sum("sum_d") / F.sum("n")
    return (part.groupBy("key", "cluster").agg(F.min("min_d").alias("m"), mean.alias("avg_distance"))
            .select("key", "cluster", F.when(F.isnan("avg_distance"), F.lit(float("nan"))).otherwise(F.col("m")).alias("min_distance"), "avg_distance"))
