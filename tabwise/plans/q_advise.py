"""Advice queries (C1, A2, T1, J5, O4): documents as problem statements, customer as the data,
benchmark items as reference passages. Whole texts, whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import round_half_up, sql_round
from ..operators.advise import TECHNIQUE_CARDS, TECHNIQUE_PHRASES, TECHNIQUES, column_tokens, suggest, top_matches, validate
from ..sources import read_table
from .registry import register

CUSTOMER_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
CUSTOMER_NUMERIC = {"c_custkey": True, "c_name": False, "c_nationkey": True, "c_acctbal": True,
                    "c_mktsegment": False}


def _statements(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def _tokens_sql(table: str, key: str, where: str = "") -> str:
    return (f"SELECT {key} AS k, lower(raw) AS t FROM (SELECT {key}, "
            f"unnest(regexp_split_to_array(text, '[^A-Za-z0-9]+')) AS raw FROM {table} {where}) WHERE raw <> ''")


def _values(rows) -> str:
    def lit(v):
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (int, float)):
            return str(v)
        return "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


_VOCAB = _values(column_tokens(CUSTOMER_COLS))
_PROPS = "\n    UNION ALL ".join(
    f"SELECT '{c}' AS target, {'true' if CUSTOMER_NUMERIC[c] else 'false'} AS t_numeric, "
    f"CAST(least(count(DISTINCT {c}), 51) AS INTEGER) AS t_distinct FROM customer" for c in CUSTOMER_COLS)
_TECH = _values([(t,) for t in TECHNIQUES])

_VALIDATE_SQL = f"""
WITH s AS (SELECT doc_id, text FROM documents),
toks AS (SELECT DISTINCT k AS doc_id, t AS token FROM ({_tokens_sql('s', 'doc_id')})),
vocab("column", position, token) AS (VALUES {_VOCAB}),
hits AS (SELECT toks.doc_id, vocab."column", vocab.position, count(*) AS hits
         FROM toks JOIN vocab USING (token) GROUP BY 1, 2, 3),
best AS (SELECT doc_id, "column" FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC,
         position DESC) AS rn FROM hits) WHERE rn = 1),
props AS ({_PROPS}),
nn AS (SELECT count(*) AS n FROM props WHERE t_numeric OR t_distinct <= 50),
tg AS (SELECT s.doc_id, coalesce(best."column", '{CUSTOMER_COLS[-1]}') AS target, lower(s.text) AS low
       FROM s LEFT JOIN best USING (doc_id)),
x AS (SELECT tg.*, props.t_numeric, props.t_distinct, tech.technique, nn.n,
             contains(low, 'predict') AS blocked
      FROM tg JOIN props USING (target) CROSS JOIN (VALUES {_TECH}) tech(technique) CROSS JOIN nn)
SELECT doc_id, technique,
  CASE WHEN technique IN ('kmeans', 'dbscan') AND blocked THEN false
       WHEN technique IN ('classification', 'decision_tree', 'knn') THEN t_distinct <= 50 AND t_distinct >= 2
       WHEN technique = 'regression' THEN t_numeric
       WHEN technique IN ('kmeans', 'dbscan') THEN n >= 2
       WHEN technique = 'pca' THEN n >= 3
       ELSE n >= 1 END AS applicable,
  CASE WHEN technique IN ('kmeans', 'dbscan') AND blocked THEN 'the statement asks to predict: use a supervised technique'
       WHEN technique IN ('classification', 'decision_tree', 'knn') AND NOT (t_distinct <= 50)
            THEN 'target ''' || target || ''' has more than 50 values'
       WHEN technique IN ('classification', 'decision_tree', 'knn') AND t_distinct < 2
            THEN 'target ''' || target || ''' has fewer than 2 classes'
       WHEN technique IN ('classification', 'decision_tree', 'knn')
            THEN 'target ''' || target || ''' has ' || CAST(t_distinct AS VARCHAR) || ' classes'
       WHEN technique = 'regression' AND t_numeric THEN 'target ''' || target || ''' is numeric'
       WHEN technique = 'regression' THEN 'regression needs a numeric target; ''' || target || ''' is text'
       WHEN technique = 'pca' THEN CAST(n AS VARCHAR) || ' numeric columns; PCA needs at least 3'
       WHEN technique IN ('kmeans', 'dbscan') THEN CAST(n AS VARCHAR) || ' numeric columns; clustering needs at least 2'
       ELSE CAST(n AS VARCHAR) || ' numeric columns' END AS reason,
  target
FROM x"""


@register("validate_docs", _VALIDATE_SQL)
def q_validate_docs(spark, sf_dir):
    return validate(read_table(spark, sf_dir, "customer"), _statements(spark, sf_dir), key="doc_id", text="text")


def _tfidf_sql(left_tokens: str, right_tokens: str, n_right: str) -> str:
    return f"""
rt AS (SELECT k AS r, t, count(*) AS tf FROM ({right_tokens}) GROUP BY 1, 2),
n AS (SELECT {n_right} AS n),
idf AS (SELECT t, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM rt, n GROUP BY t, n),
rw0 AS (SELECT r, t, tf * idf AS w FROM rt JOIN idf USING (t)),
rn AS (SELECT r, sqrt(sum(w * w)) AS rn FROM rw0 GROUP BY r),
rw AS (SELECT r, t, w / rn AS wn FROM rw0 JOIN rn USING (r)),
lt AS (SELECT k AS l, t, count(*) AS tf FROM ({left_tokens}) GROUP BY 1, 2),
lw AS (SELECT l, t, tf * coalesce(idf, (SELECT ln(1 + n) + 1 FROM n)) AS w FROM lt LEFT JOIN idf USING (t)),
lnorm AS (SELECT l, sqrt(sum(w * w)) AS ln FROM lw GROUP BY l),
dot AS (SELECT l, r, sum(w * wn) AS dot FROM lw JOIN rw USING (t) GROUP BY l, r),
sim AS (SELECT l, r, dot / ln AS cosine FROM dot JOIN lnorm USING (l))"""


@register("text_match_benchmark", "WITH " + _tfidf_sql(_tokens_sql("documents", "doc_id"),
                                                        _tokens_sql("benchmark", "item_id"),
                                                        "(SELECT count(*) FROM benchmark)") + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY floor(cosine * 1000000000.0 + 0.5) DESC, r) AS rank
           FROM sim)
SELECT l AS doc_id, r AS item_id, {sql_round('cosine', 6)} AS cosine, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE rank <= 3""")
def q_text_match_benchmark(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    bench = read_table(spark, sf_dir, "benchmark")
    m = top_matches(docs, "doc_id", "text", bench, "item_id", "text", n=3)
    return m.select(F.col("l").alias("doc_id"), F.col("r").alias("item_id"),
                    round_half_up("cosine", 6).alias("cosine"), F.col("rank").cast("int").alias("rank"))


_PHRASES = _values(list(TECHNIQUE_PHRASES.items()))


@register("suggest_techniques", "WITH s AS (SELECT doc_id, text FROM documents),\n"
          f"ph(technique, text) AS (VALUES {_PHRASES}),"
          + _tfidf_sql(_tokens_sql("s", "doc_id"), _tokens_sql("ph", "technique"), "(SELECT count(*) FROM ph)")
          + f""",
base AS (SELECT s.doc_id, tech.technique, contains(lower(s.text), 'predict') AS blocked
         FROM s CROSS JOIN (VALUES {_TECH}) tech(technique)),
sc AS (SELECT base.doc_id, base.technique, {sql_round('coalesce(sim.cosine, 0.0)', 6)} AS score,
              NOT (base.technique IN ('kmeans', 'dbscan') AND base.blocked) AS applicable
       FROM base LEFT JOIN sim ON sim.l = base.doc_id AND sim.r = base.technique)
SELECT doc_id, technique, score,
       CASE WHEN score >= 0.3 THEN 'High' WHEN score >= 0.15 THEN 'Medium' ELSE 'Low' END AS label, applicable,
       CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, technique) AS INTEGER) AS rank
FROM sc""")
def q_suggest_techniques(spark, sf_dir):
    s = suggest(None, _statements(spark, sf_dir), key="doc_id", text="text")
    return s.select("doc_id", "technique", "score", "label", "applicable", F.col("rank").cast("int").alias("rank"))


@register("validate_docs_nodata", f"""
SELECT doc_id, technique,
  CASE WHEN technique IN ('kmeans', 'dbscan') AND contains(lower(text), 'predict') THEN false ELSE true END AS applicable,
  CASE WHEN technique IN ('kmeans', 'dbscan') AND contains(lower(text), 'predict')
       THEN 'the statement asks to predict: use a supervised technique'
       ELSE 'no data: judged on the statement only' END AS reason,
  CAST(NULL AS VARCHAR) AS target
FROM documents CROSS JOIN (VALUES {_TECH}) tech(technique)""")
def q_validate_docs_nodata(spark, sf_dir):
    """C1 without a data file: validity from the statement alone."""
    return validate(None, _statements(spark, sf_dir), key="doc_id", text="text")


# problem statements made of the suppliers' rows
_ASKS = ["group customers into segments of similar behaviour", "predict churn class yes or no for mktsegment",
         "detect unusual fraud and rare spending patterns", "estimate the numeric value of acctbal"]
_ST_SQL = ("SELECT s_suppkey AS doc_id, CASE s_suppkey % 4 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_ASKS))
           + " END || ' ' || s_name AS text FROM supplier")


@register("suggest_with_data", f"WITH v AS ({_VALIDATE_SQL.replace('SELECT doc_id, text FROM documents', _ST_SQL)}),\n"
          f"s AS ({_ST_SQL}), ph(technique, text) AS (VALUES {_PHRASES}),"
          + _tfidf_sql(_tokens_sql("s", "doc_id"), _tokens_sql("ph", "technique"), "(SELECT count(*) FROM ph)")
          + f""",
card(technique, category, use_when) AS (VALUES {_values([(t, *c) for t, c in TECHNIQUE_CARDS.items()])}),
sc AS (SELECT v.doc_id, v.technique, v.applicable, v.reason,
              {sql_round("coalesce(sim.cosine, 0.0) + CASE WHEN v.applicable THEN 0.2 ELSE 0.0 END", 6)} AS score
       FROM v LEFT JOIN sim ON sim.l = v.doc_id AND sim.r = v.technique)
SELECT doc_id AS s_suppkey, technique, category, use_when, score,
       CASE WHEN score >= 0.3 THEN 'High' WHEN score >= 0.15 THEN 'Medium' ELSE 'Low' END AS label, applicable, reason,
       CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, technique) AS INTEGER) AS rank
FROM sc JOIN card USING (technique)""")
def q_suggest_with_data(spark, sf_dir):
    """A2 with the customer table as data: statements made of the suppliers' rows, bonus for applicable techniques."""
    k = F.col("s_suppkey")
    ask = F.coalesce(*[F.when(k % 4 == i, F.lit(t)) for i, t in enumerate(_ASKS)])
    st = read_table(spark, sf_dir, "supplier").select("s_suppkey", F.concat_ws(" ", ask, F.col("s_name")).alias("text"))
    s = suggest(read_table(spark, sf_dir, "customer"), st, key="s_suppkey", text="text")
    return s.select("s_suppkey", "technique", "category", "use_when", "score", "label", "applicable",
                    F.element_at("reasons", -1).alias("reason"), F.col("rank").cast("int").alias("rank"))
