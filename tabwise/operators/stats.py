"""Distributed statistics with bounded driver traffic.

* ``exact_medians``: exact (interpolated) medians of many columns at once by iterative selection. Spark's own
  ``median`` is a global aggregate whose final task holds every distinct value; here every pass is a partial
  aggregate, and only a bracket of at most ``limit`` distinct values per column ever reaches the driver.
* ``value_counts``: per-column distinct values with counts for low-cardinality columns (G2/G8), guarded by an
  HyperLogLog estimate so high-cardinality text is never grouped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDE = 32  # more columns than this are summed as arrays instead of by an expression each
FAN = 64  # p×p blocks merged by one task


def _q(name: str) -> str:
    return f"`{name}`"


def exact_medians(df: DataFrame, cols: list[str], limit: int = 20_000, accuracy: int = 10_000,
                  approximate: bool = False) -> dict[str, float | None]:
    """Median per column (NULLs ignored; even counts interpolate the two middle values, like SQL ``median``).

    ``approximate=True`` returns ``percentile_approx`` results in a single pass (for very large tables
    where an exact fill value is not worth extra passes). Else at most about ``limit`` distinct values, over all
    columns together, reach the driver.
    """
    if not cols:
        return {}
    cols = list(dict.fromkeys(cols))
    x = {c: F.col(_q(c)).cast("double") for c in cols}
    if approximate:
        row = df.agg(*[F.percentile_approx(x[c], 0.5, accuracy).alias(c) for c in cols]).first()
        return {c: (None if row[c] is None else float(row[c])) for c in cols}

    first = df.agg(*[F.count(x[c]).alias(f"n{i}") for i, c in enumerate(cols)],
                   *[F.approx_count_distinct(x[c], 0.05).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    n = {c: int(first[f"n{i}"]) for i, c in enumerate(cols)}
    # bracket per column: lo <= v <= hi (None = unbounded); below = #values < lo; inside = #values in bracket;
    # distinct = (over-)estimate of distinct values in the bracket, the size of the final collect
    state = {c: {"lo": None, "hi": None, "below": 0, "inside": n[c],
                 "distinct": min(n[c], int(first[f"d{i}"] * 1.3) + 1)} for i, c in enumerate(cols)}
    targets = {c: ((n[c] - 1) // 2, n[c] // 2) for c in cols if n[c] > 0}

    def in_bracket(c):
        s = state[c]
        cond = x[c].isNotNull()
        if s["lo"] is not None:
            cond = cond & (x[c] >= F.lit(s["lo"]))
        if s["hi"] is not None:
            cond = cond & (x[c] <= F.lit(s["hi"]))
        return cond

    margin = 2.0 / accuracy
    share = max(50, limit // len(cols))  # the limit is for all columns together
    while True:
        pending = [c for c in targets if state[c]["distinct"] > share]
        if not pending:
            break
        before = [(state[c]["inside"], state[c]["distinct"]) for c in pending], margin
        # narrow: approximate quantiles of the in-bracket values around the target ranks
        aggs = []
        for c in pending:
            s, (r1, r2) = state[c], targets[c]
            size = max(s["inside"], 1)
            f1 = min(max((r1 - s["below"]) / size - margin, 0.0), 1.0)
            f2 = min(max((r2 + 1 - s["below"]) / size + margin, 0.0), 1.0)
            aggs.append(F.percentile_approx(F.when(in_bracket(c), x[c]), [f1, f2], accuracy).alias(c))
        qs = df.agg(*aggs).first().asDict()
        proposal = {c: (float(qs[c][0]), float(qs[c][1])) for c in pending}
        checks = []
        for c in pending:
            lo, hi = proposal[c]
            checks += [F.count(F.when(x[c] < F.lit(lo), 1)).alias(f"b_{c}"),
                       F.count(F.when((x[c] >= F.lit(lo)) & (x[c] <= F.lit(hi)), 1)).alias(f"i_{c}"),
                       F.approx_count_distinct(F.when((x[c] >= F.lit(lo)) & (x[c] <= F.lit(hi)), x[c]), 0.05)
                       .alias(f"d_{c}")]
        got = df.agg(*checks).first().asDict()
        for c in pending:
            r1, r2 = targets[c]
            below, inside = got[f"b_{c}"], got[f"i_{c}"]
            if below <= r1 and below + inside > r2:  # both middle ranks are in the new bracket
                lo, hi = proposal[c]
                distinct = 1 if lo == hi else int(got[f"d_{c}"] * 1.3) + 1
                state[c].update(lo=lo, hi=hi, below=below, inside=inside, distinct=distinct)
            else:  # sketch guarantee missed (should not happen): widen the margin and retry
                margin *= 4
        if before == ([(state[c]["inside"], state[c]["distinct"]) for c in pending], margin):
            raise RuntimeError(f"median brackets stopped narrowing for {pending}")

    result: dict[str, float | None] = {c: None for c in cols}
    live = [c for c in targets]
    if not live:
        return result
    # final: distinct in-bracket values with counts, about ``limit`` over all columns; values outside the brackets
    # are dropped from the row's array before it is exploded
    stacked = df.select(F.explode(F.filter(F.array(*[
        F.when(in_bracket(c), F.struct(F.lit(i).alias("ci"), x[c].alias("v"))) for i, c in enumerate(live)
    ]), lambda p: p.isNotNull())).alias("p")).select("p.ci", "p.v")
    rows = stacked.groupBy("ci", "v").count().collect()
    by_col: dict[int, list] = {}
    for r in rows:
        by_col.setdefault(r["ci"], []).append((r["v"], r["count"]))
    for i, c in enumerate(live):
        values = sorted(by_col.get(i, []))
        r1, r2 = targets[c]
        pos = state[c]["below"]
        v1 = v2 = None
        for v, cnt in values:
            if v1 is None and pos + cnt > r1:
                v1 = v
            if pos + cnt > r2:
                v2 = v
                break
            pos += cnt
        if v1 is None or v2 is None:
            continue
        result[c] = v1 if r1 == r2 else v1 + 0.5 * (v2 - v1)
    return result


def value_counts(df: DataFrame, cols: list[str], max_values: int = 50,
                 estimates: dict[str, int] | None = None) -> dict[str, list[tuple]]:
    """Distinct non-NULL values with their counts, for each column that has at most ``max_values`` of them.

    Columns with more values map to ``None``. Pass 1 estimates the distinct count (HyperLogLog++, rsd 5 %: at the
    few-hundred values that matter its linear-counting regime is within a few percent, far inside the margin);
    only columns under a safe margin take part in pass 2, a grouped count over (column, value) whose size is
    bounded by columns × margin and which combines map-side, so a hot value costs nothing extra.
    """
    if not cols:
        return {}
    margin = int(max_values * 1.5) + 10
    est = estimates or df.agg(*[F.approx_count_distinct(F.col(_q(c)), 0.05).alias(f"e{i}")
                                for i, c in enumerate(cols)]).first().asDict()
    if not estimates:
        est = {c: est[f"e{i}"] for i, c in enumerate(cols)}
    small = [c for c in cols if est[c] <= margin]
    out: dict[str, list[tuple] | None] = {c: None for c in cols}
    if small:
        stacked = df.select(F.explode(F.array(*[
            F.struct(F.lit(i).alias("ci"), F.col(_q(c)).cast("string").alias("v")) for i, c in enumerate(small)
        ])).alias("p")).select("p.ci", "p.v").where(F.col("v").isNotNull())
        rows = stacked.groupBy("ci", "v").count().collect()
        got: dict[int, list] = {i: [] for i in range(len(small))}
        for r in rows:
            got[r["ci"]].append((r["v"], r["count"]))
        for i, c in enumerate(small):
            vals = sorted(got[i], key=lambda t: t[0].encode("utf-8"))
            out[c] = vals if len(vals) <= max_values else None
    return out


def mode_of(counts: list[tuple]) -> str | None:
    """Most frequent value; ties go to the lowest value (code-point order)."""
    if not counts:
        return None
    return sorted(counts, key=lambda t: (-t[1], t[0].encode("utf-8")))[0][0]


def mean_std(df: DataFrame, cols: list[str]) -> dict[str, tuple[float | None, float | None]]:
    """Mean and population standard deviation per column, one pass. More than ``WIDE`` columns are exploded and grouped by
    their number: one pair of aggregates, combined before the shuffle, in place of generated code for every column."""
    if not cols:
        return {}
    x = [F.col(_q(c)).cast("double") for c in cols]
    if len(cols) > WIDE:
        got = {r["pos"]: (r["m"], r["s"]) for r in df.select(F.posexplode(F.array(*x))).groupBy("pos").agg(
            F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).collect()}
        return {c: got.get(i, (None, None)) for i, c in enumerate(cols)}
    aggs = []
    for i in range(len(cols)):
        aggs += [F.avg(x[i]).alias(f"m{i}"), F.stddev_pop(x[i]).alias(f"s{i}")]
    row = df.agg(*aggs).first().asDict()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def _merge(a: tuple, b: tuple) -> tuple:
    """(n, means, products about the means) of two disjoint sets of rows together."""
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return a if a[0] else b
    d = b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


_BLOCK = "g long, n long, m array<double>, c array<double>"


def _as_block(g: int, part: tuple) -> pa.RecordBatch:
    upper = part[2][np.triu_indices(len(part[1]))]
    return pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([part[0]], pa.int64()), pa.array([part[1]], pa.list_(pa.float64())),
                                       pa.array([upper], pa.list_(pa.float64()))], ["g", "n", "m", "c"])


def _from_block(n: int, m, c) -> tuple:
    p = len(m)
    full = np.zeros((p, p))
    full[np.triu_indices(p)] = c
    return n, np.asarray(m, dtype=float), full + np.triu(full, 1).T


def _wide_moments(rows: DataFrame, p: int) -> tuple:
    """rows (x, one array of ``p`` numbers) → (n, means, products about the means).

    Every partition adds its Arrow batches up to one block: count, means and the packed upper triangle of the products.
    Blocks are merged ``FAN`` at a time until at most ``FAN`` are left, and those on the driver, so a task holds two p×p
    matrices and the driver ``FAN`` packed ones, however many partitions there are."""
    def add_up(batches):
        part = (0, np.zeros(p), np.zeros((p, p)))
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            for at in range(0, len(x), 4096):
                y = x[at:at + 4096]
                m = y.mean(0)
                part = _merge(part, (len(y), m, (y - m).T @ (y - m)))
        if part[0]:
            yield _as_block(TaskContext.get().partitionId(), part)

    def merge(batches):
        part = (0, np.zeros(p), np.zeros((p, p)))
        for b in batches:
            for i in range(b.num_rows):
                part = _merge(part, _from_block(b.column("n")[i].as_py(), *(b.column(c)[i].values.to_numpy() for c in "mc")))
        if part[0]:
            yield _as_block(TaskContext.get().partitionId(), part)
    # a partition with rows gives one block, so the number of blocks is bounded by the number of partitions
    blocks, left = rows.mapInArrow(add_up, _BLOCK), rows.rdd.getNumPartitions()
    while left > FAN:
        left = -(-left // FAN)
        blocks = blocks.repartition(left, "g").mapInArrow(merge, _BLOCK)
    part = (0, np.zeros(p), np.zeros((p, p)))
    for r in blocks.collect():
        part = _merge(part, _from_block(r["n"], r["m"], r["c"]))
    return part


def centered_moments(df: DataFrame, cols: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, population covariance) over complete rows, one pass. ``covar_pop`` is updated with centred
    running moments, so large raw values do not cancel catastrophically as Σxx − n·x̄x̄ would. More than ``WIDE`` columns
    are summed as p×p blocks, likewise about running means, instead of p²/2 expressions."""
    p = len(cols)
    x = [F.col(_q(c)).cast("double") for c in cols]
    if p > WIDE:
        n, m, products = _wide_moments(df.select(F.array(*x).alias("x")).where(~F.exists("x", lambda v: v.isNull())), p)
        return n, m, products / max(n, 1)
    cond = " AND ".join(f"{_q(c)} IS NOT NULL" for c in cols) if cols else "true"
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(x[i]).alias(f"m{i}") for i in range(p)]
    aggs += [F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)]
    row = df.where(F.expr(cond)).agg(*aggs).first().asDict()
    m = np.array([row[f"m{i}"] or 0.0 for i in range(p)], dtype=float)
    cov = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    return int(row["n"]), m, cov


def is_integral(df: DataFrame, c: str) -> bool:
    return dict(df.dtypes)[c] in ("tinyint", "smallint", "int", "bigint")


def fold_of(c, folds: int, df: DataFrame | None = None):
    """Fold number of a row from its key: integral keys use ``pmod(key, folds)`` (reproducible in any SQL
    engine); other keys (text, structs, decimals) hash first with ``xxhash64``."""
    from pyspark.sql import types as T

    col = F.col(_q(c)) if isinstance(c, str) else c
    if not folds:
        return F.lit(0)
    integral = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if df is not None and isinstance(c, str) and not isinstance(df.schema[c].dataType, integral):
        return F.pmod(F.xxhash64(col), F.lit(folds))
    return F.pmod(col, F.lit(folds))
