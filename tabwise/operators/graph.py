"""Distributed graph helpers: connected components and a dense 0…n-1 numbering.

``connected_components``: graph contraction by union-find on bounded edge groups (see the function). Labels and
the shrinking edge list are written to the shared checkpoint folder each round, so lineage stays short and a
lost executor only repeats one round.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _priority(ids: np.ndarray, salt: int) -> np.ndarray:
    """A fresh pseudo-random order of the node ids for each round (one round of a multiply-xorshift mix)."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt * 2654435761 + 1)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _union_find(salt: int):
    """Components of one group's edges: the root of a node is the group's member with the least priority
    (vectorised min-label propagation with full pointer jumping over ranks)."""
    def run(edges: pa.Table) -> pa.Table:
        src, dst = edges.column("src").to_numpy(), edges.column("dst").to_numpy()
        nodes = np.unique(np.concatenate([src, dst]))
        pri = _priority(nodes, salt)
        order = np.lexsort((nodes, pri))
        rank = np.empty(len(nodes), np.int64)
        rank[order] = np.arange(len(nodes))
        s, d = rank[np.searchsorted(nodes, src)], rank[np.searchsorted(nodes, dst)]
        lab = np.arange(len(nodes))
        while True:
            old = lab.copy()
            low = np.minimum(lab[s], lab[d])
            np.minimum.at(lab, s, low)
            np.minimum.at(lab, d, low)
            while True:  # pointer jumping until every label is a root
                nxt = lab[lab]
                if np.array_equal(nxt, lab):
                    break
                lab = nxt
            if np.array_equal(lab, old):
                break
        roots = order[lab]  # by rank; back to ids
        return pa.table({"node": nodes[order], "root": nodes[roots], "pri": pri[roots].view(np.int64)})
    return run


def connected_components(nodes: DataFrame, edges: DataFrame, group_edges: int = 200_000) -> DataFrame:
    """nodes: (node long); edges: (src long, dst long), any direction. Returns (node, comp), comp = least node id
    of the component; nodes without an edge are their own component.

    Each round contracts the graph: edges are split into groups of about ``group_edges`` by a hash of the whole
    edge (so a hub node's edges spread over many groups), each group runs a NumPy union-find, every node takes
    the root of least priority any group gave it (a combinable aggregate), and the edge list is relabelled and
    deduplicated. Priorities are drawn anew each round, so chains whose ids run in order shrink as fast as any
    other graph. The loop ends only when no edge is left; the node of greatest priority always gets a lower
    root, so each round loses nodes, and a round that loses no edge end raises. Label maps and edge lists are
    written to the checkpoint folder every round."""
    e = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    cur = cut_lineage(e.where(F.col("src") != F.col("dst")).distinct())
    linked, salt, left = None, 0, None
    while True:
        m = cur.count()
        if m == 0:
            break
        if left is not None and m > left:
            raise RuntimeError(f"contraction grew from {left} to {m} edges")
        left, salt = m, salt + 1
        groups = max(1, math.ceil(m / group_edges))
        local = (cur.withColumn("__g", F.pmod(F.xxhash64("src", "dst", F.lit(salt)), F.lit(groups)).cast("int"))
                 .groupBy("__g").applyInArrow(_union_find(salt), "node long, root long, pri long"))
        # unsigned order of the priority = signed order with the top bit flipped
        unsigned = F.col("pri").bitwiseXOR(F.lit(-(1 << 63)))
        new = cut_lineage(local.groupBy("node").agg(F.min(F.struct(unsigned.alias("p"), "root")).alias("m"))
                          .select("node", F.col("m.root").alias("root")))
        if linked is None:
            linked = new.withColumnRenamed("root", "label")
        else:
            linked = cut_lineage(linked.join(new.withColumnRenamed("node", "label"), "label", "left")
                                 .select("node", F.coalesce("root", "label").alias("label")))
        if groups == 1:  # one group has seen every edge: its roots are the components
            break
        cur = cut_lineage(cur.join(new.select(F.col("node").alias("src"), F.col("root").alias("rs")), "src")
                          .join(new.select(F.col("node").alias("dst"), F.col("root").alias("rd")), "dst")
                          .where(F.col("rs") != F.col("rd"))
                          .select(F.least("rs", "rd").alias("src"), F.greatest("rs", "rd").alias("dst")).distinct())
    every = nodes.select(F.col("node").cast("long").alias("node")).distinct()
    if linked is None:
        return every.select("node", F.col("node").alias("comp"))
    least = linked.groupBy("label").agg(F.min("node").alias("comp"))
    named = linked.join(least, "label").select("node", "comp")
    return every.join(named, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def dense_index(df: DataFrame, col: str, out: str = "index") -> DataFrame:
    """Distinct values of ``col`` with their 0-based position in ascending order, without a single-partition
    window: range-partition, write the rows with their partition number once (so offsets and positions come from
    the same split), count rows per partition (one small row per partition reaches the driver), then offset +
    position within the partition."""
    vals = cut_lineage(df.select(col).distinct().repartitionByRange(col)
                       .withColumn("__pid", F.spark_partition_id()))
    counts = sorted((r["__pid"], r["n"]) for r in vals.groupBy("__pid").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, run = {}, 0
    for pid, n in counts:
        offsets[pid] = run
        run += n
    spark = df.sparkSession
    off = spark.createDataFrame([(p, o) for p, o in offsets.items()] or [(0, 0)], "__pid int, __off long")
    w = Window.partitionBy("__pid").orderBy(col)
    return (vals.join(F.broadcast(off), "__pid")
            .select(col, (F.col("__off") + F.row_number().over(w) - 1).alias(out)))
