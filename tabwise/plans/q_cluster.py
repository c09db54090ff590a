"""K-Means (U1, G9, G10, G16, G17, V2) and PCA (U3, U4, G12, G13, O5) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import round_half_up, sql_round
from ..operators.kmeans import first_rows_as_centers, kmeans, kmeans_from
from ..operators.pca import pca, pca_reduce
from ..operators.prep import fit_scaler
from ..sources import read_table
from .registry import register

KM_FEATURES = ["c_acctbal", "c_nationkey"]
KM_K = 4


def _customer_points(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")


def _customer_kmeans(spark, sf_dir, iterations):
    pts = _customer_points(spark, sf_dir)
    sc = fit_scaler(pts, KM_FEATURES)
    init = first_rows_as_centers(pts, "c_custkey", KM_FEATURES, KM_K, sc)
    return kmeans_from(pts, "c_custkey", KM_FEATURES, init, iterations)


def _lloyd_sql(iterations: int) -> str:
    """Unrolled Lloyd steps in SQL (k = 4, two standardised features, start = 4 lowest keys)."""
    d2 = "(z.f0 - c.f0) * (z.f0 - c.f0) + (z.f1 - c.f1) * (z.f1 - c.f1)"
    parts = [
        "st AS (SELECT avg(c_acctbal) AS ma, stddev_pop(c_acctbal) AS sa, avg(CAST(c_nationkey AS DOUBLE)) AS mn, "
        "stddev_pop(CAST(c_nationkey AS DOUBLE)) AS sn FROM customer)",
        "z AS (SELECT c_custkey, c_acctbal, c_nationkey, "
        "(c_acctbal - ma) / CASE WHEN sa = 0 THEN 1 ELSE sa END AS f0, "
        "(CAST(c_nationkey AS DOUBLE) - mn) / CASE WHEN sn = 0 THEN 1 ELSE sn END AS f1 FROM customer, st)",
        "c0 AS (SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS INTEGER) AS cl, f0, f1 "
        "FROM (SELECT * FROM z ORDER BY c_custkey LIMIT 4))",
    ]
    for i in range(iterations + 1):
        parts.append(
            f"a{i} AS (SELECT c_custkey, cl, d2 FROM (SELECT z.c_custkey, c.cl, {d2} AS d2, "
            f"row_number() OVER (PARTITION BY z.c_custkey ORDER BY {d2}, c.cl) AS rn FROM z, c{i} c) WHERE rn = 1)")
        if i < iterations:
            parts.append(
                f"c{i + 1} AS (SELECT c{i}.cl, coalesce(m.f0, c{i}.f0) AS f0, coalesce(m.f1, c{i}.f1) AS f1 FROM c{i} "
                f"LEFT JOIN (SELECT a{i}.cl, avg(z.f0) AS f0, avg(z.f1) AS f1 FROM a{i} JOIN z USING (c_custkey) "
                f"GROUP BY a{i}.cl) m ON m.cl = c{i}.cl)")
    return "WITH " + ",\n".join(parts) + "\n"


@register("kmeans_assign", _lloyd_sql(0) + f"""
SELECT c_custkey, cl AS cluster, {sql_round('sqrt(d2)', 6)} AS distance FROM a0""")
def q_kmeans_assign(spark, sf_dir):
    m = _customer_kmeans(spark, sf_dir, 0)
    return m.assign.select("c_custkey", "cluster", round_half_up("distance", 6).alias("distance"))


@register("kmeans_lloyd3", _lloyd_sql(3) + f"""
SELECT cl AS cluster, 'c_acctbal' AS feature, {sql_round('f0', 6)} AS center FROM c3
UNION ALL SELECT cl, 'c_nationkey', {sql_round('f1', 6)} FROM c3""")
def q_kmeans_lloyd3(spark, sf_dir):
    m = _customer_kmeans(spark, sf_dir, 3)
    return m.centers_table.select("cluster", "feature", round_half_up("center", 6).alias("center"))


@register("cluster_sizes", _lloyd_sql(3) + """
SELECT cl AS cluster, count(*) AS size FROM a3 GROUP BY cl""")
def q_cluster_sizes(spark, sf_dir):
    return _customer_kmeans(spark, sf_dir, 3).sizes


@register("cluster_averages", _lloyd_sql(3) + f"""
SELECT a3.cl AS cluster, count(*) AS size, {sql_round('avg(z.c_acctbal)', 4)} AS avg_c_acctbal,
       {sql_round('avg(CAST(z.c_nationkey AS DOUBLE))', 4)} AS avg_c_nationkey
FROM a3 JOIN z USING (c_custkey) GROUP BY a3.cl""")
def q_cluster_averages(spark, sf_dir):
    a = _customer_kmeans(spark, sf_dir, 3).averages
    return a.select("cluster", "size", round_half_up("avg_c_acctbal", 4).alias("avg_c_acctbal"),
                    round_half_up("avg_c_nationkey", 4).alias("avg_c_nationkey"))


@register("kmeans_score", _lloyd_sql(3) + f"""
, sp AS (SELECT s_suppkey, (s_acctbal - ma) / CASE WHEN sa = 0 THEN 1 ELSE sa END AS f0,
                (CAST(s_nationkey AS DOUBLE) - mn) / CASE WHEN sn = 0 THEN 1 ELSE sn END AS f1 FROM supplier, st),
dd AS (SELECT sp.s_suppkey, c.cl, (sp.f0 - c.f0) * (sp.f0 - c.f0) + (sp.f1 - c.f1) * (sp.f1 - c.f1) AS d2
       FROM sp, c3 c),
best AS (SELECT s_suppkey, cl AS assigned FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY d2, cl) AS rn
         FROM dd) WHERE rn = 1)
SELECT dd.s_suppkey, best.assigned, dd.cl AS cluster, {sql_round('sqrt(dd.d2)', 6)} AS distance
FROM dd JOIN best USING (s_suppkey)""")
def q_kmeans_score(spark, sf_dir):
    m = _customer_kmeans(spark, sf_dir, 3)
    sup = read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"),
        F.col("s_nationkey").alias("c_nationkey"))
    s = m.score(sup)
    return s.select(F.col("c_custkey").alias("s_suppkey"), "assigned", "cluster",
                    round_half_up("distance", 6).alias("distance"))


def _embedding_table(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    dim = len(e.select("embedding").first()[0])
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dim)]), \
        [f"e{i}" for i in range(dim)]


KM_RANGE, KM_SEED, KM_STEPS, KM_ROUNDS = (2, 8), 42, 20, 4
KM_OVERSAMPLE = 2 * KM_RANGE[1]


def _embedding_kmeans(spark, sf_dir):
    df, feats = _embedding_table(spark, sf_dir)
    return kmeans(df, "vec_id", feats, k=None, k_range=KM_RANGE, seed=KM_SEED, max_iter=KM_STEPS, prep=False)


def _sweep_sql() -> str:
    """The sweep in SQL: k-means|| candidates cand_R, their order as starts ``taken``, Lloyd steps cen_S of every k,
    assignment ``a`` (vec_id, k, cl, d2), ``cost`` (k, inertia) and ``best`` (the k at the elbow)."""
    lo, hi = KM_RANGE

    def nearest(rows, centres, by, order):
        return f"""SELECT {by}, n.o AS {order}, n.d2 AS d2 FROM (SELECT {by}, min({{'d2': d2, 'o': {order}}}) AS n FROM (
  SELECT {by}, {order}, list_sum(list_transform(list_zip({rows}.x, {centres}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2 FROM {rows}, {centres}) GROUP BY {by})"""
    out = ["""l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS f FROM embeddings),
st AS (SELECT f, avg(v) AS m, stddev_pop(v) AS s FROM l GROUP BY f),
zl AS MATERIALIZED (SELECT vec_id, f, (v - m) / CASE WHEN s = 0 THEN 1 ELSE s END AS v FROM l JOIN st USING (f)),
z AS MATERIALIZED (SELECT vec_id, list(v ORDER BY f) AS x FROM zl GROUP BY vec_id)""",
           f"cand_0 AS MATERIALIZED (SELECT 0 AS i, x FROM z ORDER BY md5(vec_id || ':start:{KM_SEED}'), CAST(vec_id AS VARCHAR) LIMIT 1)"]
    for r in range(KM_ROUNDS):
        u = f"CAST(('0x' || substr(md5(vec_id || ':{r}:{KM_SEED}'), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496.0"
        out.append(f"""near_{r} AS MATERIALIZED ({nearest('z', f'cand_{r}', 'vec_id', 'i')}),
new_{r} AS (SELECT x, min(CAST(vec_id AS VARCHAR)) AS id FROM near_{r} JOIN z USING (vec_id)
  WHERE {u} * (SELECT sum(d2) FROM near_{r}) < {float(KM_OVERSAMPLE)} * d2 GROUP BY x),
cand_{r + 1} AS MATERIALIZED (SELECT i, x FROM cand_{r} UNION ALL SELECT {r + 1} * 1000000 + row_number() OVER (ORDER BY id), x FROM new_{r})""")
    last = f"cand_{KM_ROUNDS}"
    out.append(f"""w AS MATERIALIZED (SELECT i, x, coalesce(n, 0) AS w FROM {last} LEFT JOIN (
  SELECT i, count(*) AS n FROM ({nearest('z', last, 'vec_id', 'i')}) GROUP BY i) USING (i)),
taken_1 AS MATERIALIZED (SELECT 1 AS j, i, x FROM w ORDER BY w DESC, i LIMIT 1)""")
    for j in range(2, hi + 1):
        out.append(f"""t_{j} AS (SELECT i AS t, x FROM taken_{j - 1}),
gain_{j} AS ({nearest('w', f't_{j}', 'i', 't')}),
taken_{j} AS MATERIALIZED (SELECT * FROM taken_{j - 1} UNION ALL (SELECT {j}, i, x FROM w JOIN gain_{j} USING (i) WHERE w * d2 > 0 ORDER BY w * d2 DESC, i LIMIT 1))""")
    out.append(f"cen_0 AS MATERIALIZED (SELECT k, j - 1 AS cl, x FROM taken_{hi}, range({lo}, {hi + 1}) r(k) WHERE j <= k)")
    for s in range(KM_STEPS):
        out.append(f"""a_{s} AS MATERIALIZED ({nearest('z', f'cen_{s}', 'vec_id, k', 'cl')}),
m_{s} AS (SELECT k, cl, list(v ORDER BY f) AS x FROM (SELECT k, cl, f, avg(v) AS v FROM a_{s} JOIN zl USING (vec_id) GROUP BY ALL) GROUP BY k, cl),
cen_{s + 1} AS MATERIALIZED (SELECT k, cl, coalesce(m.x, c.x) AS x FROM cen_{s} c LEFT JOIN m_{s} m USING (k, cl))""")
    out.append(f"""a AS MATERIALIZED ({nearest('z', f'cen_{KM_STEPS}', 'vec_id, k', 'cl')}),
cost AS (SELECT k, sum(d2) AS inertia FROM a GROUP BY k),
ends AS (SELECT min(inertia) AS lo, max(inertia) AS hi, arg_min(inertia, k) AS first, arg_max(inertia, k) AS last FROM cost),
chord AS (SELECT k, (k - {lo}) / {float(hi - lo)} AS px, (inertia - first) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END AS py,
  (last - first) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END AS dy FROM cost, ends),
best AS (SELECT k AS chosen FROM chord ORDER BY abs(py - dy * px) DESC, k LIMIT 1)""")
    return "WITH " + ",\n".join(out) + "\n"


_SWEEP = _sweep_sql()


@register("kmeans_full", _SWEEP + "SELECT CAST(cl AS INTEGER) AS cluster, count(*) AS size FROM a, best WHERE k = chosen GROUP BY cl")
def q_kmeans_full(spark, sf_dir):
    """U1 end to end on the embeddings (k-means|| start, k by elbow): the sizes of the clusters."""
    return _embedding_kmeans(spark, sf_dir).sizes


@register("kmeans_elbow", _SWEEP + f"SELECT CAST(k AS INTEGER) AS k, {sql_round('inertia', 4)} AS inertia, k = chosen AS chosen FROM cost, best")
def q_kmeans_elbow(spark, sf_dir):
    """Inertia of k = 2…8, and the k at the elbow."""
    return _embedding_kmeans(spark, sf_dir).elbow_table.select("k", round_half_up("inertia", 4).alias("inertia"), "chosen")


@register("kmeans_silhouette", _SWEEP + f""",
p AS (SELECT vec_id, cl, x, list_inner_product(x, x) AS q FROM a JOIN best ON k = chosen JOIN z USING (vec_id)),
g AS (SELECT cl, any_value(n) AS n, list(m ORDER BY f) AS m, any_value(q) AS q FROM (
  SELECT cl, f, avg(v) AS m FROM p JOIN zl USING (vec_id) GROUP BY cl, f) JOIN (SELECT cl, count(*) AS n, avg(q) AS q FROM p GROUP BY cl) USING (cl) GROUP BY cl),
d AS (SELECT vec_id, p.cl, g.cl AS other, n, p.q + g.q - 2 * list_inner_product(x, m) AS mean_sq FROM p, g),
ab AS (SELECT vec_id, max(CASE WHEN cl = other AND n > 1 THEN mean_sq * n / (n - 1) END) AS a,
              min(CASE WHEN cl <> other THEN mean_sq END) AS b FROM d GROUP BY vec_id)
SELECT CAST(chosen AS INTEGER) AS k, s AS silhouette_sq_euclidean FROM best, (
  SELECT {sql_round('avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END)', 6)} AS s FROM ab)""")
def q_kmeans_silhouette(spark, sf_dir):
    """Silhouette (squared Euclidean distance) of the k at the elbow."""
    m = _embedding_kmeans(spark, sf_dir)
    return spark.createDataFrame([(m.k, m.silhouette)], "k int, s double").select("k", round_half_up("s", 6).alias("silhouette_sq_euclidean"))


@register("lloyd_quality", _lloyd_sql(3) + f""",
p AS (SELECT z.c_custkey, z.f0, z.f1, a3.cl, a3.d2 FROM z JOIN a3 USING (c_custkey)),
g AS (SELECT cl, count(*) AS n, avg(f0) AS m0, avg(f1) AS m1, avg(f0 * f0 + f1 * f1) AS q FROM p GROUP BY cl),
d AS (SELECT p.c_custkey, p.cl, g.cl AS other, g.n,
             f0 * f0 + f1 * f1 - 2 * (f0 * m0 + f1 * m1) + q AS mean_sq FROM p, g),
ab AS (SELECT c_custkey, max(CASE WHEN cl = other AND n > 1 THEN mean_sq * n / (n - 1) END) AS a,
              min(CASE WHEN cl <> other THEN mean_sq END) AS b FROM d GROUP BY c_custkey)
SELECT {sql_round('(SELECT sum(d2) FROM p)', 4)} AS inertia,
       {sql_round('avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END)', 6)} AS silhouette_sq_euclidean FROM ab""")
def q_lloyd_quality(spark, sf_dir):
    """G16/G17 on the fixed-start path: inertia and silhouette after three Lloyd steps."""
    m = _customer_kmeans(spark, sf_dir, 3)
    df = spark.createDataFrame([(m.inertia, m.silhouette)], "i double, s double")
    return df.select(round_half_up("i", 4).alias("inertia"), round_half_up("s", 6).alias("silhouette_sq_euclidean"))


# ---------------------------------------------------------------------------------------------------------
PCA3 = ["price", "net_price", "qty"]


def _lineitem_pca_input(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("row_key"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_price"),
        F.col("l_quantity").alias("qty"), F.col("l_tax").alias("tax"))


_PCA_BASE = """
WITH b AS (SELECT l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS net_price, l_quantity AS qty
           FROM lineitem)
"""


@register("pca_covariance", _PCA_BASE + "\n UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{c}' AS feature_b, "
    + sql_round(f"corr({a}, {c})", 6) + " AS value FROM b" for a in PCA3 for c in PCA3))
def q_pca_covariance(spark, sf_dir):
    m = pca(_lineitem_pca_input(spark, sf_dir), "row_key", PCA3, prep=False)
    return m.covariance.select("feature_a", "feature_b", round_half_up("value", 6).alias("value"))


@register("pca_variance", _PCA_BASE + f""",
r AS (SELECT abs(corr(price, net_price)) AS r FROM b)
SELECT 1 AS component, {sql_round('(1 + r) / 2 * 100', 4)} AS explained_pct,
       {sql_round('(1 + r) / 2 * 100', 4)} AS cumulative_pct FROM r
UNION ALL
SELECT 2, {sql_round('(1 - r) / 2 * 100', 4)}, CAST(100.0 AS DOUBLE) FROM r""")
def q_pca_variance(spark, sf_dir):
    m = pca(_lineitem_pca_input(spark, sf_dir), "row_key", ["price", "net_price"], prep=False)
    v = m.variance
    return v.select("component", round_half_up("explained_pct", 4).alias("explained_pct"),
                    round_half_up("cumulative_pct", 4).alias("cumulative_pct"))


PCA4 = [*PCA3, "tax"]


def _power_sql(squarings: int = 40) -> str:
    """Eigenvectors of the 4×4 correlation matrix by power iteration (the matrix is squared and scaled again and
    again) and deflation; the largest |loading| of each is positive. CTEs b (the table), m0…m3 (matrix, deflated),
    e1…e4 (eigenvector x0…x3 with value l)."""
    n = range(4)
    cells = [f"c{i}{j}" for i in n for j in n]
    parts = ["b AS (SELECT *, l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS net_price, l_quantity AS qty, "
             "l_tax AS tax FROM lineitem)",
             "m0 AS (SELECT " + ", ".join(("CAST(1 AS DOUBLE)" if i == j else f"corr({PCA4[i]}, {PCA4[j]})") + f" AS c{i}{j}"
                                          for i in n for j in n) + " FROM b)"]
    for k in n:
        square = ", ".join("(" + " + ".join(f"c{i}{h} * c{h}{j}" for h in n) + f") AS d{i}{j}" for i in n for j in n)
        parts.append(f"p{k}(step, {', '.join(cells)}) AS (SELECT 0, {', '.join(cells)} FROM m{k} UNION ALL SELECT step + 1, "
                     + ", ".join(f"d{i}{j} / (d00 + d11 + d22 + d33)" for i in n for j in n)
                     + f" FROM (SELECT step, {square} FROM p{k} WHERE step < {squarings}))")
        top = "greatest(c00, c11, c22, c33)"  # the limit is v·vᵀ: the column of the largest loading, made positive
        col = ", ".join("CASE " + " ".join(f"WHEN c{j}{j} = {top} THEN c{i}{j} / sqrt(c{j}{j})" for j in n) + f" END AS x{i}" for i in n)
        norm = "sqrt(" + " + ".join(f"x{i} * x{i}" for i in n) + ")"
        unit = f"(SELECT {', '.join(f'x{i} / {norm} AS x{i}' for i in n)} FROM (SELECT {col} FROM p{k} WHERE step = {squarings}))"
        value = " + ".join(f"x{i} * x{j} * c{i}{j}" for i in n for j in n)
        parts.append(f"e{k + 1} AS (SELECT {value} AS l, x0, x1, x2, x3 FROM {unit}, m{k})")
        if k < 3:
            parts.append(f"m{k + 1} AS (SELECT " + ", ".join(f"c{i}{j} - l * x{i} * x{j} AS c{i}{j}" for i in n for j in n)
                         + f" FROM m{k}, e{k + 1})")
    return "WITH RECURSIVE " + ",\n".join(parts)


@register("pca_top_features", _power_sql() + ",\nl AS (" + " UNION ALL ".join(
    f"SELECT {k + 1} AS component, '{f}' AS feature, x{j} AS loading FROM e{k + 1}" for k in range(4) for j, f in enumerate(PCA4))
    + f""")
SELECT component, feature, {sql_round('loading', 4)} AS loading, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY component ORDER BY abs(loading) DESC, feature) AS rank FROM l) WHERE rank <= 2""")
def q_pca_top_features(spark, sf_dir):
    m = pca(_lineitem_pca_input(spark, sf_dir), "row_key", PCA4, prep=False)
    return m.top_features(2).select("component", "feature", round_half_up("loading", 4).alias("loading"), "rank")


_Z4 = [f"((b.{f} - a.m{j}) / a.s{j})" for j, f in enumerate(PCA4)]


@register("pca_reduce", _power_sql() + ",\na AS (SELECT " + ", ".join(
    f"avg({f}) AS m{j}, stddev_pop({f}) AS s{j}" for j, f in enumerate(PCA4)) + """ FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, """ + ", ".join(
    sql_round("(" + " + ".join(f"{z} * e{k}.x{j}" for j, z in enumerate(_Z4)) + ")", 4) + f' AS "PC{k}"' for k in (1, 2))
    + " FROM b, a, e1, e2")
def q_pca_reduce(spark, sf_dir):
    out, _side = pca_reduce(_lineitem_pca_input(spark, sf_dir), "row_key", 2, PCA4, prep=False)
    return out.select(*[F.col(f"row_key.{c}").alias(c) for c in ("l_orderkey", "l_linenumber", "l_partkey")],
                      round_half_up("PC1", 4).alias("PC1"), round_half_up("PC2", 4).alias("PC2"))


@register("pca_wide_covariance", f"""
WITH l AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS f, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT 'e' || a.f AS feature_a, 'e' || b.f AS feature_b, {sql_round('corr(a.v, b.v)', 6)} AS value
FROM l a JOIN l b USING (vec_id) GROUP BY a.f, b.f""")
def q_pca_wide_covariance(spark, sf_dir):
    """U3 on many columns: covariance of all standardised dimensions of the embeddings, summed as blocks."""
    df, feats = _embedding_table(spark, sf_dir)
    m = pca(df, "vec_id", feats, prep=False)
    return m.covariance.select("feature_a", "feature_b", round_half_up("value", 6).alias("value"))
