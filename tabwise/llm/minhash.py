"""Near-duplicate documents by MinHash: one-permutation hashing with optimal densification, banded buckets,
star-shaped candidate edges, links confirmed on full shingle sets, connected components.

1. One pass over the texts computes each document's set of distinct five-word shingles and, from a single hash
   per shingle, ``bands * rows`` bins (the least hash of each bin). An empty bin takes the value of the first
   filled bin on its own pseudo-random probe sequence (optimal densification), so short documents get full
   signatures too. Texts with the same set collapse to a class: the least doc_id represents it.
2. Each band of a representative is one bucket key. Inside a bucket every member is linked to the least member
   only (a star), so a bucket of m members gives m - 1 candidate edges, never m².
3. Candidates are confirmed by exact Jaccard on the full sets, recomputed from the two whole texts.
4. Confirmed links are contracted to components. A bucket whose members are still in different components may
   hide a link between two members of which neither links to its centre: a second round draws a star around
   another centre there, and for the buckets that are still mixed an exact prefix-filter join (rarest shingles
   first, positional bound) finds every remaining link between members of different components.

Scale: nothing but counts reaches the driver; the band exchange holds one small row per document and band; buckets
are only ever aggregated and joined, never gathered; texts are shuffled once, to keep those that share a bucket with another
class; the pair checks are joins (hot centres are salted).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import cut_lineage
from .common import mix, shingle_set

BANDS, ROWS, THRESHOLD, WIDTH = 40, 5, 75, 5


def signature(h: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash of sorted distinct hashes with optimal densification."""
    where = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)  # the high half picks the bin, in order
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    sig = np.zeros(bins, np.uint64)
    filled = np.zeros(bins, bool)
    at = where[first].astype(np.int64)
    sig[at], filled[at] = h[first], True
    empty = np.flatnonzero(~filled)
    out, probe = sig.copy(), 1
    while len(empty):  # the probe sequence of a bin does not depend on the document
        with np.errstate(over="ignore"):
            to = (mix(empty.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(probe))
                  % np.uint64(bins)).astype(np.int64)
        ok = filled[to]
        out[empty[ok]] = sig[to[ok]]
        empty, probe = empty[~ok], probe + 1
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = sig.reshape(bands, -1)
    with np.errstate(over="ignore"):
        h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
        for j in range(rows.shape[1]):
            h = mix(h ^ rows[:, j]) * np.uint64(0x9FB21C651E98DF25)
    return h.view(np.int64)


def _signatures(bands: int, rows: int, width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()),
                        ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            n, a, b, keys = [], [], [], []
            for text in batch.column("text"):
                h = shingle_set(text.as_py(), width)
                n.append(len(h))
                if not len(h):
                    a.append(None), b.append(None), keys.append([])
                    continue
                with np.errstate(over="ignore"):
                    a.append(int(h.sum(dtype=np.uint64).view(np.int64)))
                    b.append(int(mix(h).sum(dtype=np.uint64).view(np.int64)))
                keys.append(band_keys(signature(h, bands * rows), bands))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(a, pa.int64()),
                                              pa.array(b, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)
    return run


SIGNATURE_SCHEMA = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def _confirm(threshold: int, width: int):
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("linked", pa.bool_())])

    def run(batches):
        centre, known = None, None  # rows of one centre arrive together
        for batch in batches:
            src, dst, out = batch.column("src").to_pylist(), batch.column("dst").to_pylist(), []
            for i, (c, a, b) in enumerate(zip(src, batch.column("a"), batch.column("b"))):
                if c != centre:
                    centre, known = c, shingle_set(a.as_py(), width)
                other = shingle_set(b.as_py(), width)
                both = len(np.intersect1d(known, other, assume_unique=True))
                out.append(100 * both >= threshold * (len(known) + len(other) - both))
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()),
                                              pa.array(out, pa.bool_())], schema=schema)
    return run


def confirm_edges(edges: DataFrame, texts: DataFrame, threshold: int = THRESHOLD, width: int = WIDTH,
                  per_salt: int = 500) -> DataFrame:
    """edges (src, dst) with each edge's exact decision ``linked``. A centre with many edges is copied once per
    ``per_salt`` of them and its edges are dealt over the copies, so no task gets a hot centre whole."""
    ends = texts.select("doc_id", "text").join(
        edges.select(F.explode(F.array("src", "dst")).alias("doc_id")).distinct(), "doc_id", "left_semi")
    hot = (edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
           .select("src", F.ceil(F.col("n") / F.lit(per_salt)).cast("int").alias("salts")))
    side = edges.join(hot, "src").select("src", "dst", F.pmod(F.xxhash64("dst"), F.col("salts")).cast("int").alias("salt"))
    centres = (hot.join(ends.withColumnRenamed("doc_id", "src"), "src")
               .select("src", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("text").alias("a")))
    rows = (side.join(ends.select(F.col("doc_id").alias("dst"), F.col("text").alias("b")), "dst")
            .join(centres, ["src", "salt"]).select("src", "dst", "a", "b"))
    return rows.mapInArrow(_confirm(threshold, width), "src long, dst long, linked boolean")


def _sets(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("comp", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            rows = [shingle_set(t.as_py(), width).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("comp"),
                                              pa.array(rows, pa.list_(pa.int64()))], schema=schema)
    return run


def cross_candidates(texts: DataFrame, label: DataFrame, threshold: int = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """Every pair (src < dst) of documents in different components of ``label`` (doc_id, comp) whose Jaccard can
    reach the threshold: prefix filter with the rarest shingles first and the positional bound. A shingle's
    largest component never meets itself, so a large group of copies costs nothing here."""
    docs = texts.join(label, "doc_id").select("doc_id", "comp", "text")
    sets = cut_lineage(docs.mapInArrow(_sets(width), "doc_id long, comp long, shingles array<long>"))
    rows = sets.select("doc_id", "comp", F.size("shingles").alias("n"), F.explode("shingles").alias("t"))
    per = rows.groupBy("t", "comp").agg(F.count(F.lit(1)).alias("c"))
    stat = per.groupBy("t").agg(F.sum("c").alias("f"), F.max_by("comp", F.struct("c", "comp")).alias("dom"),
                                (F.count(F.lit(1)) > 1).alias("mixed"))
    spot = F.row_number().over(Window.partitionBy("doc_id").orderBy("f", "t"))
    t = F.lit(threshold)
    prefix = (rows.join(stat, "t").withColumn("pos", spot)  # 1-based; overlap needs ceil(t·n/100) of a set's n
              .where((F.col("pos") <= F.col("n") - F.ceil(t * F.col("n") / 100) + 1) & F.col("mixed"))
              .select("doc_id", "comp", "n", "t", "dom", "pos"))
    prefix = cut_lineage(prefix)
    x = prefix.where("comp <> dom").select(*[F.col(c).alias(f"x_{c}") for c in ("doc_id", "comp", "n", "pos")], "t", "dom")
    y = prefix.select(*[F.col(c).alias(f"y_{c}") for c in ("doc_id", "comp", "n", "pos")], "t")
    most = 1 + F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos"))
    fits = ((100 * F.col("x_n") >= t * F.col("y_n")) & (100 * F.col("y_n") >= t * F.col("x_n"))
            & (most * (100 + t) >= t * (F.col("x_n") + F.col("y_n"))))
    once = (F.col("y_comp") == F.col("dom")) | (F.col("x_doc_id") < F.col("y_doc_id"))
    return (x.join(y, "t").where((F.col("x_comp") != F.col("y_comp")) & once & fits)
            .select(F.least("x_doc_id", "y_doc_id").alias("src"), F.greatest("x_doc_id", "y_doc_id").alias("dst"))
            .distinct())


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, threshold: int = THRESHOLD,
                    width: int = WIDTH, stars: int = 2) -> DataFrame:
    """docs (doc_id, text, …) → one row per distinct doc_id: doc_id, n_shingles, component_id (least doc_id
    reachable by links, itself included), kept (doc_id = component_id), class_id (least doc_id with the same
    set). ``threshold`` is in hundredths; ``stars`` star rounds come before the exact join over what is left.

    Null and empty texts and texts without words have n_shingles 0 and stand alone. Texts with the same set
    form one class and link at once. Rows without a doc_id cannot be named and are left out; of rows that
    repeat a doc_id the least text counts. Other columns are ignored. An empty table gives no rows."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    sig = cut_lineage(texts.mapInArrow(_signatures(bands, rows, width), SIGNATURE_SCHEMA))
    if sig.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        texts = cut_lineage(texts.groupBy("doc_id").agg(F.min("text").alias("text")))
        sig = cut_lineage(texts.mapInArrow(_signatures(bands, rows, width), SIGNATURE_SCHEMA))
    classes = sig.where("n_shingles > 0").groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("class_id"))
    member = cut_lineage(sig.drop("bands").join(classes, ["n_shingles", "set_a", "set_b"], "left")
                         .select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id")))
    reps = member.where("n_shingles > 0 and doc_id = class_id").select("doc_id")
    # buckets with two members or more, and the texts of their members. Whatever is taken over a bucket is a
    # combinable aggregate, written and joined back, so that a hot bucket's rows can be dealt to many tasks
    rowsof = sig.join(reps, "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("bucket"))
    shared = cut_lineage(rowsof.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"))
    buckets = cut_lineage(rowsof.join(shared, "bucket").select("doc_id", "bucket"))
    texts = cut_lineage(texts.join(buckets.select("doc_id").distinct(), "doc_id", "left_semi"))
    nodes = texts.select(F.col("doc_id").alias("node"))

    def star(mine: DataFrame, salt: int) -> DataFrame:
        """Around the least member of each bucket at first, around a pseudo-random one later."""
        order = F.struct((F.xxhash64("doc_id", F.lit(salt)) if salt else F.lit(0)).cast("long").alias("o"), "doc_id", "comp")
        centre = cut_lineage(mine.groupBy("bucket").agg(F.min(order).alias("c")))
        return (mine.join(centre, "bucket").where(F.col("c.comp") != F.col("comp"))
                .select(F.least("c.doc_id", "doc_id").alias("src"), F.greatest("c.doc_id", "doc_id").alias("dst"))
                .distinct())

    links, tested, label = None, None, texts.select("doc_id", F.col("doc_id").alias("comp"))
    for step in range(stars + 1):
        if step < stars:
            pairs = star(cut_lineage(buckets.join(label, "doc_id")), step)
        else:
            pairs = cross_candidates(texts, label.join(buckets.select("doc_id").distinct(), "doc_id", "left_semi"),
                                     threshold, width)
        if tested is not None:
            pairs = pairs.join(tested, ["src", "dst"], "left_anti")
        done = cut_lineage(confirm_edges(cut_lineage(pairs), texts, threshold, width))
        tested = done.select("src", "dst") if tested is None else tested.unionByName(done.select("src", "dst"))
        new = done.where("linked").select("src", "dst")
        if not new.limit(1).count():
            continue
        links = new if links is None else links.unionByName(new)
        label = cut_lineage(connected_components(nodes, links).select(F.col("node").alias("doc_id"), "comp"))
        if step < stars:  # buckets whose members all share a component have nothing left to find
            mixed = cut_lineage(buckets.join(label, "doc_id").groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                                .where("lo < hi").select("bucket"))
            buckets = cut_lineage(buckets.join(mixed, "bucket"))
    return (member.join(label.withColumnRenamed("doc_id", "class_id"), "class_id", "left")
            .withColumn("component_id", F.coalesce("comp", "class_id"))
            .select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"),
                    "class_id"))
