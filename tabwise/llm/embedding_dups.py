"""Near-duplicate embeddings by exact cosine, compared in PCA-ordered tiles.

Unit vectors are rotated to principal axes (fitted on a bounded sample; any rotation gives the same result, a good
one only stops earlier) and cut into tiles along the first axis. Two tiles are compared unless the boxes of their
leading coordinates already bound the cosine below the threshold. Inside a pair of tiles the dot products of the
leading dimensions are accumulated first; the product of the two suffix norms bounds what the rest can add, and
pairs that cannot reach the threshold stop there. What remains is decided by the cosine of the given vectors.

Equal vectors are compared once. A pair of tiles returns link counts and a spanning forest of its links, not the
links themselves, so a group of m near copies gives m rows per pair of tiles, never m².

Scale: the work is that of all pairs of tiles that the bounds cannot part (quadratic when nothing parts them, as
any exact method on such data), in equal tasks of a tile squared (``TILE_VALUES`` numbers a tile); a row is shipped once per pair of its tile.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import cut_lineage

THRESHOLD, TILE_VALUES, SAMPLE_VALUES, LEAD = 0.9, 1 << 19, 2_000_000, 8
SLACK, ROUGH = 1e-9, 1e-4  # rounding of double sums, and of single-precision ones


def unit_rows(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # neither overflow nor underflow
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def matrix(column, d: int) -> np.ndarray:
    """n × d doubles of an Arrow list column without nulls."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0) if flat.num_chunks else pa.array([], pa.list_(pa.float64()))
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)


def links(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, block: int = 512):
    """Pairs (i, j) with cosine >= threshold, in blocks of rows of a. a, b: unit rows; axes: rotation, leading
    axis first."""
    ra, rb = a @ axes, b @ axes
    d = a.shape[1]
    steps = sorted({max(1, d // 4), max(1, d // 2)} - {d})

    def suffix(r, k):
        return np.sqrt(np.maximum(0.0, (r[:, k:] ** 2).sum(axis=1)))

    def first(r, k):  # the suffix norm as one more dimension: the product is partial sum plus bound
        return np.column_stack([r[:, :k], suffix(r, k)]).astype(np.float32)
    k = steps[0] if steps else d
    fa, fb = first(ra, k), np.ascontiguousarray(first(rb, k).T)
    for lo in range(0, len(a), block):
        x = ra[lo:lo + block]
        i, j = np.nonzero(fa[lo:lo + block] @ fb >= threshold - ROUGH)
        for at in range(0, len(i), 1 << 18):
            p, q = i[at:at + (1 << 18)], j[at:at + (1 << 18)]
            for nxt in steps[1:]:
                dot = np.einsum("nk,nk->n", x[p, :nxt], rb[q, :nxt])
                go = dot + suffix(x, nxt)[p] * suffix(rb, nxt)[q] >= threshold - SLACK
                p, q = p[go], q[go]
            ok = np.einsum("nk,nk->n", a[lo + p], b[q]) >= threshold
            yield lo + p[ok], q[ok]


def _roots(n: int, i: np.ndarray, j: np.ndarray, lab: np.ndarray) -> np.ndarray:
    """Add links to a labelling of n nodes by their least index."""
    while True:
        low = np.minimum(lab[i], lab[j])
        old = lab.copy()
        np.minimum.at(lab, lab[i], low)
        np.minimum.at(lab, lab[j], low)
        while True:
            nxt = lab[lab]
            if np.array_equal(nxt, lab):
                break
            lab = nxt
        if np.array_equal(old, lab):
            return lab


def _compare(axes: np.ndarray, d: int, threshold: float):
    schema = pa.schema([("vec_id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        same = key[0].as_py() == key[1].as_py()
        if not len(left) or not len(right):
            return schema.empty_table()
        ids = [t.column("vec_id").to_numpy() for t in (left, right)]
        many = [t.column("copies").to_numpy() for t in (left, right)]
        a = unit_rows(matrix(left.column("embedding"), d))
        if same:
            order = np.argsort(ids[0], kind="stable")
            a, ids, many = a[order], [ids[0][order]] * 2, [many[0][order]] * 2
            b, shift = a, 0
        else:
            b, shift = unit_rows(matrix(right.column("embedding"), d)), len(a)
        total = len(a) + (0 if same else len(b))
        every = ids[0] if same else np.concatenate(ids)
        rank = np.argsort(np.argsort(every, kind="stable"), kind="stable")  # labels compare as ids do
        count, lab = np.zeros(total, np.int64), np.arange(total)
        for i, j in links(a, b, axes, threshold):
            if same:
                up = i < j
                i, j = i[up], j[up]
            np.add.at(count, i, many[1][j])
            np.add.at(count, j + shift, many[0][i])
            if len(i):
                lab = _roots(total, rank[i], rank[j + shift], lab)
        hit = np.flatnonzero(count)
        back = np.empty(total, np.int64)
        back[rank] = every
        return pa.table([every[hit], count[hit], back[lab[rank[hit]]]], schema=schema)
    return run


def _place(axes: np.ndarray, d: int, lead: int, cuts: list[float] | None):
    """Leading coordinates, suffix norm, and with cuts the tile of each vector."""
    def run(batches):
        for batch in batches:
            r = unit_rows(matrix(batch.column("embedding"), d)) @ axes if batch.num_rows else np.empty((0, d))
            rest = np.sqrt(np.maximum(0.0, (r[:, lead:] ** 2).sum(axis=1)))
            cols = {"vec_id": batch.column("vec_id"), "copies": batch.column("copies"), "embedding": batch.column("embedding"),
                    "lead": pa.array(list(r[:, :lead]), pa.list_(pa.float64())), "rest": pa.array(rest),
                    "tile": pa.array(np.searchsorted(cuts or [], r[:, 0], side="right").astype(np.int32))}
            yield pa.RecordBatch.from_pydict(cols)
    return run


def principal_axes(vectors: DataFrame, d: int, sample_values: int) -> np.ndarray:
    """Axes of a sample of at most ``sample_values / d`` vectors, chosen by a hash of the id; leading axis first."""
    rows = max(d, sample_values // d)
    got = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).select("embedding").toPandas()
    u = unit_rows(np.array(got["embedding"].tolist(), np.float64).reshape(-1, d))
    w, e = np.linalg.eigh(u.T @ u)
    return np.ascontiguousarray(e[:, np.argsort(-w)])


def _one_length(vectors: DataFrame, d: int, n: int, threshold: float, tile_rows: int | None, sample_values: int) -> DataFrame:
    axes, lead = principal_axes(vectors, d, sample_values), min(LEAD, d)
    tile_rows = tile_rows or max(256, TILE_VALUES // d)
    kind = vectors.schema["embedding"].dataType.simpleString()
    out = f"vec_id long, copies long, embedding {kind}, lead array<double>, rest double, tile int"
    tiles, cuts = math.ceil(n / tile_rows), None
    if tiles > 1:
        first = vectors.mapInArrow(_place(axes, d, lead, None), out).select(F.col("lead")[0].alias("x"))
        cuts = sorted(set(first.agg(F.percentile_approx("x", [i / tiles for i in range(1, tiles)], 20 * tiles)).first()[0]))
    placed = cut_lineage(vectors.mapInArrow(_place(axes, d, lead, cuts), out))
    bounds = [f(F.col("lead")[k]).alias(f"{name}{k}") for k in range(lead) for name, f in (("lo", F.min), ("hi", F.max))]
    box = cut_lineage(placed.groupBy("tile").agg(F.max("rest").alias("rest"), *bounds))
    last = len(cuts or [])
    a = box.select(F.explode(F.sequence(F.col("tile"), F.lit(last))).alias("b"), F.struct("*").alias("p"))
    b = box.select(F.col("tile").alias("b"), F.struct("*").alias("q"))
    most = F.col("p.rest") * F.col("q.rest")
    for k in range(lead):
        most = most + F.greatest(*[F.col(f"p.{s}{k}") * F.col(f"q.{t}{k}") for s in ("lo", "hi") for t in ("lo", "hi")])
    pairs = cut_lineage(a.join(b, "b").where(most >= threshold - SLACK).select(F.col("p.tile").alias("a"), "b"))
    row = placed.select("tile", "vec_id", "copies", "embedding")
    left = row.join(pairs, F.col("tile") == F.col("a")).drop("tile")
    right = row.join(pairs.where("a <> b"), F.col("tile") == F.col("b")).drop("tile")
    # a tile with itself needs one side only; the other holds a row to keep the groups in step
    one = pairs.where("a = b").select(F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("copies"),
                                      F.expr(f"cast(array() as {kind})").alias("embedding"), "a", "b")
    right = right.unionByName(one)
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of their own beside left's
    return cut_lineage(left.groupBy("a", "b").cogroup(right.groupBy("a", "b"))
                       .applyInArrow(_compare(axes, d, threshold), "vec_id long, links long, root long"))


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tile_rows: int | None = None,
                           sample_values: int = SAMPLE_VALUES) -> DataFrame:
    """vectors (vec_id, embedding array<float or double>, …) → one row per distinct vec_id: vec_id, n_links (other
    vectors with cosine >= threshold), component_id (least vec_id reachable by links, itself included), kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do vectors of
    different lengths. Rows without an id are left out; of rows that repeat an id the least vector counts; extra
    columns are ignored; an empty table gives no rows."""
    rows = (vectors.where("vec_id is not null").groupBy(F.col("vec_id").cast("long").alias("vec_id"))
            .agg(F.min("embedding").alias("embedding")))
    x = F.col("embedding")
    fit = (F.coalesce(F.size(x), F.lit(0)) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = cut_lineage(rows.select("vec_id", F.when(fit, x).alias("embedding")))
    classes = cut_lineage(rows.where("embedding is not null").groupBy("embedding")
                          .agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")))
    lengths = classes.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
    found = None
    for r in sorted(lengths, key=lambda r: r["d"]):  # few distinct lengths
        own = classes.where(F.size("embedding") == r["d"]).select("vec_id", "copies", "embedding")
        part = _one_length(own, r["d"], r["n"], threshold, tile_rows, sample_values)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    comps = connected_components(classes.select(F.col("vec_id").alias("node")), found.select(F.col("vec_id").alias("src"), F.col("root").alias("dst")))
    linked = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    per = (classes.select("embedding", F.col("vec_id").alias("class_id"), "copies")
           .join(comps.withColumnRenamed("node", "class_id"), "class_id")
           .join(linked.withColumnRenamed("vec_id", "class_id"), "class_id", "left")
           .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "comp"))
    return (rows.join(per, "embedding", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("comp", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id") == F.col("component_id")))
