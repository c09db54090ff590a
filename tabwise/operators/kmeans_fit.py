"""U1 fitting: k-means|| seeding and Lloyd steps for every k of a sweep at once.

Seeding: the first candidate is the row with the least md5(key:start:seed). In each of ``rounds`` rounds a row joins the
candidates where u · cost < ``oversample`` · d², with d² its squared distance to the candidates so far, cost the sum of d²
over all rows and u drawn from md5(key:round:seed). About ``oversample`` rows join a round, however many rows there are.
The candidates are weighted by the rows nearest to them and reduced on the driver: the heaviest first, then again and again
the one with the greatest weight · d² to those taken. The order serves every k: the first k of it are its start.

Lloyd steps: one pass over the rows sums, for every k that still moves, the rows of each cluster (NumPy on Arrow batches,
one set of sums a partition), then a grouped aggregate adds up the partitions; clusters × (d + 2) sums reach the driver. Centres and candidates go into the tasks with
the function; they are (2 + … + 8) · d numbers for the default sweep. An empty cluster keeps its centre.

Nothing depends on the layout of the rows but the order of floating sums. Rows with a NULL or NaN feature are not used;
rows with a NULL key draw by their values; ties go to the earlier candidate (round, then key as text) or cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, spread

DIGITS = 13  # hexadecimal digits of a draw: 52 bits, which a double holds exactly
STILL = 1e-12  # a centre that moves by no more has the same rows as before


def fit_rows(z: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(id, x) of the rows a fit uses, spread over the cores and written once."""
    values = [F.col(f"`{f}`").cast("double") for f in features]
    x = F.array(*values)
    used = z.select(F.col(f"`{key}`").cast("string").alias("id"), x.alias("x")).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    return cut_lineage(spread(used.select(F.coalesce("id", F.xxhash64("x").cast("string")).alias("id"), "x")))


def _digest(*names) -> Column:
    return F.md5(F.concat_ws(":", F.col("id"), *[F.lit(str(n)) for n in names]))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _nearest(rows: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre (the first one on ties) and squared distance to it."""
    best, at = np.full(len(rows), np.inf), np.zeros(len(rows), dtype=np.int64)
    for j, c in enumerate(centers):
        diff = rows - c
        d2 = np.einsum("ij,ij->i", diff, diff)
        closer = d2 < best
        best[closer], at[closer] = d2[closer], j
    return at, best


def _with_distance(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    """(id, x, d2), d2 the squared distance to the nearest centre."""
    d = centers.shape[1]

    def measure(batches):
        for b in batches:
            _, d2 = _nearest(_matrix(b, d), centers)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(d2)], ["id", "x", "d2"])
    return rows.mapInArrow(measure, "id string, x array<double>, d2 double")


def candidates(rows: DataFrame, oversample: float, rounds: int, seed: int) -> np.ndarray:
    """Candidates of k-means||, in the order in which they joined."""
    first = rows.select(F.struct(_digest("start", seed).alias("h"), "id", "x").alias("r")).agg(F.min("r.h"), F.min("r").alias("r")).first()["r"]
    if first is None:
        raise ValueError("no row without missing features to fit on")
    found = np.array([first["x"]])
    for r in range(rounds):
        cost = float(sum(c for _, c, _ in _sums(rows, {0: found})[0].values()))
        u = F.conv(F.substring(_digest(r, seed), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16 ** DIGITS))
        # equal rows join once, so the rows of one round are about ``oversample`` whatever repeats
        joined = _with_distance(rows, found).where(u * F.lit(cost) < F.lit(float(oversample)) * F.col("d2")).groupBy("x").agg(F.min("id").alias("id")).collect()
        if joined:
            found = np.vstack([found, [p["x"] for p in sorted(joined, key=lambda p: p["id"])]])
    return found


def reduce_candidates(points: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """At most ``k`` of the candidates: the heaviest, then those of greatest weight · squared distance to the ones taken."""
    taken = [int(np.argmax(weights))]
    while len(taken) < k:
        _, d2 = _nearest(points, points[taken])
        gain = weights * d2
        if gain.max() <= 0:
            break
        taken.append(int(np.argmax(gain)))
    return points[taken]


def _sums(rows: DataFrame, centers: dict[int, np.ndarray]) -> dict[int, dict[int, tuple[int, float, np.ndarray]]]:
    """For every k and cluster: rows, cost and sum of the rows, from one pass."""
    d = next(iter(centers.values())).shape[1]

    def add_up(batches):
        n = {k: np.zeros(len(c)) for k, c in centers.items()}
        cost = {k: np.zeros(len(c)) for k, c in centers.items()}
        total = {k: np.zeros(c.shape) for k, c in centers.items()}
        for b in batches:
            x = _matrix(b, d)
            for k, c in centers.items():
                at, d2 = _nearest(x, c)
                n[k] += np.bincount(at, minlength=len(c))
                cost[k] += np.bincount(at, weights=d2, minlength=len(c))
                np.add.at(total[k], at, x)
        out = [(k, j, [n[k][j], cost[k][j], *total[k][j]]) for k, c in centers.items() for j in range(len(c)) if n[k][j]]
        yield pa.RecordBatch.from_pylist([{"k": k, "cluster": j, "s": s} for k, j, s in out],
                                         schema=pa.schema([("k", pa.int32()), ("cluster", pa.int32()), ("s", pa.list_(pa.float64()))]))
    parts = rows.select("x").mapInArrow(add_up, "k int, cluster int, s array<double>")
    cells = parts.select("k", "cluster", F.posexplode("s").alias("i", "v")).groupBy("k", "cluster", "i").agg(F.sum("v").alias("v"))
    flat: dict = {}
    for r in cells.collect():
        flat.setdefault((r["k"], r["cluster"]), np.zeros(d + 2))[r["i"]] = r["v"]
    out: dict = {k: {} for k in centers}
    for (k, j), s in flat.items():
        out[k][j] = (int(s[0]), s[1], s[2:])
    return out


def fit_sweep(rows: DataFrame, ks: list[int], seed: int = 42, max_iter: int = 20, rounds: int = 4,
              oversample: float | None = None) -> dict[int, tuple[np.ndarray, float]]:
    """rows (id, x) → {k: (centres, inertia)}. A table with fewer than k different rows gives fewer centres."""
    most = max(ks)
    points = candidates(rows, oversample or 2 * most, rounds, seed)
    counted = _sums(rows, {0: points})[0]
    weights = np.array([counted[j][0] if j in counted else 0 for j in range(len(points))], dtype=float)
    start = reduce_candidates(points, weights, most)
    centers = {k: start[:k].copy() for k in ks}
    moving = set(ks)
    for _ in range(max_iter):
        if not moving:
            break
        for k, clusters in _sums(rows, {k: centers[k] for k in sorted(moving)}).items():
            new = centers[k].copy()
            for j, (n, _cost, total) in clusters.items():
                new[j] = total / n
            if np.abs(new - centers[k]).max() <= STILL:
                moving.discard(k)
            centers[k] = new
    final = _sums(rows, centers)
    return {k: (centers[k], float(sum(cost for _, cost, _ in final[k].values()))) for k in ks}
