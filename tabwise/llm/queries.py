"""Registered queries of the training-data operators over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_repair, decontam, embedding_dups, html_extract, license_scan, minhash, periodic_runs, pii, quality, secrets, suffix_dedup, token_files
from .common import table
from .span_sql import PII_SQL, SECRETS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return wrap


# words as the operators take them: A-Z in lower case, runs without space and \\x09-\\x0D
_WORDS = """regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+')"""

_OP1_SQL = f"""
WITH item AS (SELECT min(item_id) AS item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL GROUP BY text),
iw AS (SELECT item_id, {_WORDS.format(text="text")} AS w FROM item),
dw AS (SELECT doc_id, {_WORDS.format(text="text")} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
i1 AS (SELECT item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM iw),
d1 AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM dw),
same AS (SELECT doc_id, item_id, p - q AS diagonal, p FROM d1 JOIN i1 USING (word)
         WHERE least(d1.n, i1.n + p - q) - greatest(0, p - q) >= 13),
dense AS (SELECT doc_id, item_id, count(*) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY p
                 RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS c FROM same)
SELECT doc_id, count(DISTINCT item_id) AS n_items,
       array_to_string(list_sort(list(DISTINCT item_id)), ',') AS item_ids
FROM dense WHERE c >= 10 GROUP BY doc_id"""

_OP5_SQL = f"""
WITH RECURSIVE dw AS (SELECT doc_id, coalesce({_WORDS.format(text="text")}, []) AS w FROM documents WHERE doc_id IS NOT NULL),
sh AS (SELECT DISTINCT doc_id, s FROM (
         SELECT doc_id, array_to_string(w, ' ') AS s FROM dw WHERE len(w) BETWEEN 1 AND 4
         UNION ALL
         SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s
         FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw WHERE len(w) >= 5))),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM both_ JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM dw UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y)
SELECT dw.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, dw.doc_id = r.component_id AS kept
FROM dw LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) r USING (doc_id)"""

_OP7_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
         WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT vec_id AS x, vec_id AS y FROM e UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y),
c AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM e LEFT JOIN c ON c.x = e.vec_id JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = e.vec_id"""


@register("op1_decontaminate", _OP1_SQL)
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap benchmark texts."""
    found = decontam.contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_items", F.array_join(F.col("item_ids").cast("array<string>"), ",").alias("item_ids"))


@register("op2_bpe")
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the bytes decoded from them, as digests."""
    ids = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                     public_tokenizers.PATTERN, decode=True)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op3_pii", PII_SQL)
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms of every text, as counts, digest and span list."""
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


@register("op4_html")
def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@register("op5_minhash", _OP5_SQL)
def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents``."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("class_id")


@register("op6_tokens")
def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, written to wavelet-matrix files in doc_id order and read back."""
    read = token_files.corpus_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@register("op7_embeddings", _OP7_SQL)
def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of ``embeddings`` at cosine 0.9."""
    return embedding_dups.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@register("op8_licenses")
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with licence notices, their licences and spans."""
    return license_scan.licensed_documents(table(spark, sf_dir, "documents"))


@register("op9_secrets", SECRETS_SQL)
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets and linked credential parts of every text, as counts, digest and span list."""
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


@register("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text, learnt from the labels that are not held out."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op11_conversations")
def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of the damaged conversations, and their cheapest repair as cost, audit and digest."""
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_all(rows, conversation_repair.damage(rows))


@register("op12_suffixes")
def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every text that strings of earlier documents cover, and the digest of the rest."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@register("op13_runs")
def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every text, and the text without their repeats, as digests."""
    docs = periodic_runs.with_made_runs(table(spark, sf_dir, "documents"))
    return periodic_runs.digest(periodic_runs.periodic_runs(docs))
