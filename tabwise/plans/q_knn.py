"""kNN queries (M4, J2) on the embeddings: 64 standardised dimensions, label as class, folds vec_id % 5."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import round_half_up, sql_round
from ..operators.knn import knn
from .q_cluster import _embedding_table
from .registry import register


def _knn(spark, sf_dir):
    df, feats = _embedding_table(spark, sf_dir)
    return knn(df, "vec_id", "label", feats, k=None, k_range=(3, 20), folds=5, prep=False)


_KNN_BASE = """
WITH e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS d
           FROM embeddings),
st AS (SELECT d, avg(v) AS m, stddev_pop(v) AS s FROM e GROUP BY d),
z AS (SELECT e.vec_id, e.d, (e.v - st.m) / CASE WHEN st.s = 0 THEN 1 ELSE st.s END AS z FROM e JOIN st USING (d)),
pairs AS (SELECT a.vec_id AS q, b.vec_id AS t, sqrt(sum((a.z - b.z) * (a.z - b.z))) AS dist
          FROM z a JOIN z b ON a.d = b.d AND a.vec_id % 5 <> b.vec_id % 5 GROUP BY a.vec_id, b.vec_id),
nb AS (SELECT q, t, dist, rn FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, t) AS rn FROM pairs)
       WHERE rn <= 20),
nbl AS (SELECT nb.*, CAST(l.label AS DOUBLE) AS tl FROM nb JOIN embeddings l ON l.vec_id = nb.t),
ks AS (SELECT range AS k FROM range(3, 21)),
votes AS (SELECT q, k, tl, count(*) AS c FROM nbl JOIN ks ON nbl.rn <= ks.k GROUP BY q, k, tl),
pred AS (SELECT q, k, tl AS prediction FROM (
           SELECT *, row_number() OVER (PARTITION BY q, k ORDER BY c DESC, tl) AS r FROM votes) WHERE r = 1),
acc AS (SELECT k, avg(CASE WHEN prediction = CAST(em.label AS DOUBLE) THEN 1.0 ELSE 0.0 END) AS accuracy
        FROM pred JOIN embeddings em ON em.vec_id = pred.q GROUP BY k)
"""


@register("knn_k_scores", _KNN_BASE + f"""
SELECT CAST(k AS INTEGER) AS k, {sql_round('accuracy', 6)} AS accuracy FROM acc""")
def q_knn_k_scores(spark, sf_dir):
    m = _knn(spark, sf_dir)
    return m.k_scores.select(F.col("k").cast("int").alias("k"), round_half_up("accuracy", 6).alias("accuracy"))


@register("knn_predict", _KNN_BASE + """
, best AS (SELECT k FROM acc ORDER BY accuracy DESC, k ASC LIMIT 1)
SELECT pred.q AS vec_id, CAST(pred.k AS INTEGER) AS k, CAST(pred.prediction AS BIGINT) AS prediction,
       CAST(em.label AS BIGINT) AS label
FROM pred JOIN best ON pred.k = best.k JOIN embeddings em ON em.vec_id = pred.q""")
def q_knn_predict(spark, sf_dir):
    m = _knn(spark, sf_dir)
    p = m.cv_predictions.where(F.col("k") == m.k)
    return p.select(F.col("q_key").alias("vec_id"), F.col("k").cast("int").alias("k"),
                    F.col("prediction").cast("long").alias("prediction"), F.col("label").cast("long").alias("label"))


@register("knn_neighbours", _KNN_BASE + f"""
SELECT q AS vec_id, CAST(rn AS INTEGER) AS rank, t AS neighbour, {sql_round('dist', 6)} AS distance FROM nb""")
def q_knn_neighbours(spark, sf_dir):
    from ..operators.knn import neighbours

    m = _knn(spark, sf_dir)
    nb = neighbours(m.train, m.train, 20, m.block_rows, fold_mask=True)
    return nb.select(F.col("q_key").alias("vec_id"), F.col("rank").cast("int").alias("rank"),
                     F.col("t_key").alias("neighbour"), round_half_up("distance", 6).alias("distance"))


@register("knn_score", f"""
WITH e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS d
           FROM embeddings),
st AS (SELECT d, avg(v) AS m, stddev_pop(v) AS s FROM e GROUP BY d),
z AS (SELECT e.vec_id, e.d, (e.v - st.m) / CASE WHEN st.s = 0 THEN 1 ELSE st.s END AS z,
             (-e.v - st.m) / CASE WHEN st.s = 0 THEN 1 ELSE st.s END AS nz FROM e JOIN st USING (d)),
pairs AS (SELECT a.vec_id AS q, b.vec_id AS t, sqrt(sum((a.nz - b.z) * (a.nz - b.z))) AS dist
          FROM z a JOIN z b ON a.d = b.d GROUP BY a.vec_id, b.vec_id),
nb AS (SELECT q, t FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, t) AS rn FROM pairs) WHERE rn <= 5),
votes AS (SELECT nb.q, em.label, count(*) AS c FROM nb JOIN embeddings em ON em.vec_id = nb.t GROUP BY 1, 2),
best AS (SELECT q, label AS prediction, c AS top FROM (
           SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, label) AS r FROM votes) WHERE r = 1),
classes AS (SELECT DISTINCT label FROM embeddings)
SELECT best.q AS vec_id, CAST(best.prediction AS BIGINT) AS prediction, {sql_round('best.top * 20.0', 6)} AS confidence,
       CAST(classes.label AS BIGINT) AS label, {sql_round('coalesce(votes.c, 0) * 20.0', 6)} AS percent
FROM best CROSS JOIN classes LEFT JOIN votes ON votes.q = best.q AND votes.label = classes.label""")
def q_knn_score(spark, sf_dir):
    """V1: new rows (every vector with its sign turned) scored by the five nearest training rows."""
    df, feats = _embedding_table(spark, sf_dir)
    m = knn(df, "vec_id", "label", feats, k=5, prep=False)
    new = df.select("vec_id", *[(-F.col(f)).alias(f) for f in feats])
    p = m.predict(new).select("vec_id", "prediction", "confidence", F.explode("probabilities").alias("p"))
    return p.select("vec_id", F.col("prediction").cast("long").alias("prediction"),
                    round_half_up("confidence", 6).alias("confidence"), F.col("p.label").cast("long").alias("label"),
                    round_half_up("p.percent", 6).alias("percent"))
