"""C1 technique validity, A2 suggestion ranking (+ T1 per statement, J5 token join, O4 ranking).

Both work on a *table* of statements, so a million problem statements cost one job, not a million requests.
The data profile they use is computed once and is bounded (columns × 50 values).

Similarity is TF-IDF cosine over ASCII word tokens of the whole texts (our re-aim of the reference's language
model vectors): idf(t) = ln((1 + N) / (1 + df(t))) + 1 over the phrase side's N texts; a statement token the
phrases never use gets df = 0. Statement tokens join the phrase tokens on the token; the phrase side is
broadcast only when its token table is under ``broadcast_rows`` (checked), else it is a shuffle join.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import round_half_up, token_rows
from ..session import cut_lineage, spread
from .prep import fit_prep
from .profile import as_profile_input, is_numeric_type
from .stats import value_counts
from .text_scores import Index, score_rows, token_counts

TECHNIQUES = ["classification", "regression", "decision_tree", "knn", "kmeans", "dbscan", "pca", "anomaly"]

# Fixed values (our own wording): reference phrases describing when each technique fits.
TECHNIQUE_PHRASES = {
    "classification": "classify predict category class label outcome yes no churn whether will customer leave",
    "regression": "predict estimate forecast numeric value amount price salary score continuous how much",
    "decision_tree": "rules explain decision interpretable why which factors classify predict category",
    "knn": "similar neighbours nearest similarity classify predict category based on similar records",
    "kmeans": "group segment cluster customers segments groups similar behaviour segmentation",
    "dbscan": "clusters density irregular shapes noise outliers groups arbitrary shape",
    "pca": "reduce dimensions features compress components variance important features drivers",
    "anomaly": "detect unusual anomalies outliers fraud suspicious abnormal rare spending patterns",
}

# Fixed values (our own wording): what a suggestion shows beside its score.
TECHNIQUE_CARDS = {
    "classification": ("supervised", "a column holds few classes and new rows need one of them"),
    "regression": ("supervised", "a number has to be estimated from the other columns"),
    "decision_tree": ("supervised", "classes should be told apart by rules a person can read"),
    "knn": ("supervised", "rows that look alike share a class"),
    "kmeans": ("unsupervised", "rows should fall into a known number of round groups"),
    "dbscan": ("unsupervised", "groups have any shape and stray rows should stand out"),
    "pca": ("unsupervised", "many numeric columns say much the same"),
    "anomaly": ("unsupervised", "a few rows differ from all others"),
}

# Fixed values (ours): score cut-offs for the confidence label.
HIGH_CUTOFF, MEDIUM_CUTOFF = 0.30, 0.15


def _name_tokens(name: str) -> list[str]:
    return sorted({t for t in re.split(r"[^a-z0-9]+", name.lower()) if t})


def column_tokens(columns: list[str]) -> list[tuple[str, int, str]]:
    """(column, position, token) rows for the column-name vocabulary (bounded by the schema)."""
    return [(c, i, t) for i, c in enumerate(columns) for t in _name_tokens(c)]


def choose_targets(statements: DataFrame, key: str, text: str, columns: list[str]) -> DataFrame:
    """T1 for every statement: the column sharing the most distinct tokens with the statement (ties → later
    column); none → the last column. (key, target)."""
    spark = statements.sparkSession
    vocab = spark.createDataFrame(column_tokens(columns), "column string, position int, token string")
    # the vocabulary is bounded by the schema: it is joined first, so only its few tokens are made distinct
    toks = token_rows(spread(statements), key, text, "__k", "token").join(F.broadcast(vocab), "token")
    hits = (toks.distinct().groupBy("__k", "column", "position").agg(F.count(F.lit(1)).alias("hits")))
    best = hits.groupBy("__k").agg(F.max(F.struct("hits", "position", "column")).alias("b"))
    return (statements.select(F.col(key).alias("__k")).join(best, "__k", "left")
            .select(F.col("__k").alias(key), F.coalesce(F.col("b.column"), F.lit(columns[-1])).alias("target")))


def data_facts(df: DataFrame | None, max_categories: int = 50):
    """Bounded facts about the data: per column numeric flag and distinct count (capped), cleaned numeric count."""
    if df is None:
        return None
    data = as_profile_input(df)
    numeric = {f.name: is_numeric_type(f.dataType) for f in data.schema.fields}
    prep = fit_prep(df, max_categories=max_categories)
    # text columns: the preprocessing already counted their values; numeric ones get one bounded count
    counts = value_counts(data, [c for c in data.columns if c not in prep.categories], max_categories)
    distinct = {}
    for c in data.columns:
        vals = prep.categories.get(c) if c in prep.categories else counts.get(c)
        distinct[c] = len(vals) if vals is not None else max_categories + 1
    return {"columns": data.columns, "numeric": numeric, "distinct": distinct, "n_numeric_clean": len(prep.columns)}


def validate(df: DataFrame | None, statements: DataFrame, key: str = "id", text: str = "statement",
             block_terms: tuple[str, ...] = ("predict",), max_categories: int = 50) -> DataFrame:
    """(key, technique, applicable, reason, target) for every statement × technique."""
    facts = data_facts(df, max_categories)
    blocked = F.lit(False)
    for term in block_terms:
        blocked = blocked | F.lower(F.col(text)).contains(term.lower())
    s = statements.select(F.col(key), blocked.alias("__blocked"))  # the text goes no further
    if facts is not None:
        targets = choose_targets(statements, key, text, facts["columns"])
        spark = statements.sparkSession
        props = spark.createDataFrame(
            [(c, bool(facts["numeric"][c]), int(facts["distinct"][c])) for c in facts["columns"]],
            "target string, t_numeric boolean, t_distinct int")
        s = s.join(targets, key).join(F.broadcast(props), "target", "left")
        n_num = facts["n_numeric_clean"]
    else:
        s = s.select("*", F.lit(None).cast("string").alias("target"), F.lit(None).cast("boolean").alias("t_numeric"),
                     F.lit(None).cast("int").alias("t_distinct"))
        n_num = None
    tech = F.explode(F.array(*[F.lit(t) for t in TECHNIQUES])).alias("technique")
    s = s.select("*", tech)
    t = F.col("technique")
    nodata = F.lit(facts is None)
    few = F.col("t_distinct") <= max_categories
    supervised_ok = few & (F.col("t_distinct") >= 2)
    clustering = t.isin("kmeans", "dbscan")
    applicable = (F.when(nodata & ~clustering, F.lit(True))
                  .when(clustering & F.col("__blocked"), F.lit(False))
                  .when(nodata, F.lit(True))
                  .when(t.isin("classification", "decision_tree", "knn"), supervised_ok)
                  .when(t == "regression", F.col("t_numeric"))
                  .when(clustering, F.lit((n_num or 0) >= 2))
                  .when(t == "pca", F.lit((n_num or 0) >= 3))
                  .otherwise(F.lit((n_num or 0) >= 1)))
    reason = (F.when(nodata & ~clustering, F.lit("no data: judged on the statement only"))
              .when(clustering & F.col("__blocked"), F.lit("the statement asks to predict: use a supervised technique"))
              .when(nodata, F.lit("no data: judged on the statement only"))
              .when(t.isin("classification", "decision_tree", "knn") & ~few,
                    F.concat(F.lit("target '"), F.col("target"), F.lit(f"' has more than {max_categories} values")))
              .when(t.isin("classification", "decision_tree", "knn") & (F.col("t_distinct") < 2),
                    F.concat(F.lit("target '"), F.col("target"), F.lit("' has fewer than 2 classes")))
              .when(t.isin("classification", "decision_tree", "knn"),
                    F.concat(F.lit("target '"), F.col("target"), F.lit("' has "), F.col("t_distinct").cast("string"),
                             F.lit(" classes")))
              .when((t == "regression") & F.col("t_numeric"),
                    F.concat(F.lit("target '"), F.col("target"), F.lit("' is numeric")))
              .when(t == "regression", F.concat(F.lit("regression needs a numeric target; '"), F.col("target"),
                                                F.lit("' is text")))
              .when(t == "pca", F.lit(f"{n_num} numeric columns; PCA needs at least 3"))
              .when(clustering, F.lit(f"{n_num} numeric columns; clustering needs at least 2"))
              .otherwise(F.lit(f"{n_num} numeric columns")))
    return s.select(key, "technique", applicable.alias("applicable"), reason.alias("reason"), "target")


BROADCAST_BYTES = 16 << 20


def right_weights(right: DataFrame, rkey: str, rtext: str) -> tuple[DataFrame, DataFrame, float]:
    """Unit TF-IDF vectors of the right side (r, t, wn), its idf (t, idf), both written as several joins read them, and
    the idf of tokens it never uses."""
    rt = cut_lineage(token_rows(right, rkey, rtext, "r", "t").groupBy("r", "t").agg(F.count(F.lit(1)).alias("tf")))
    n_right = right.select(rkey).distinct().count()
    idf = rt.groupBy("t").agg(F.count(F.lit(1)).alias("df")).select(
        "t", (F.log((F.lit(1.0 + n_right)) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf"))
    rw = rt.join(idf, "t").select("r", "t", (F.col("tf") * F.col("idf")).alias("w"))
    rnorm = rw.groupBy("r").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("rn"))
    rw, idf = cut_lineage(rw.join(rnorm, "r").select("r", "t", (F.col("w") / F.col("rn")).alias("wn"))), cut_lineage(idf)
    return rw, idf, float(math.log(1.0 + n_right) + 1.0)


def fits_broadcast(rw: DataFrame, broadcast_bytes: int | None = None) -> bool:
    size = rw.agg(F.sum(F.octet_length("t") + F.octet_length(F.col("r").cast("string")) + 32)).first()[0] or 0
    return size <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes)


def left_weights(left: DataFrame, lkey: str, ltext: str, idf: DataFrame, default_idf: float, small: bool) -> DataFrame:
    """Unit TF-IDF vectors of the left side (l, t, w), of the tokens that the right side knows."""
    lt = token_counts(spread(left), lkey, ltext, "l", "t").groupBy("l", "t").agg(F.sum("tf").alias("tf"))
    lw = cut_lineage(lt.join(F.broadcast(idf) if small else idf, "t", "left").select(
        "l", "t", (F.col("tf") * F.coalesce(F.col("idf"), F.lit(default_idf))).alias("w")))
    lnorm = lw.groupBy("l").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("ln"))
    # only shared tokens matter once the norms are known
    known = F.broadcast(idf.select("t")) if small else idf.select("t")
    return lw.join(known, "t", "left_semi").join(lnorm, "l").select("l", "t", (F.col("w") / F.col("ln")).alias("w"))


def tfidf_weights(left: DataFrame, lkey: str, ltext: str, right: DataFrame, rkey: str, rtext: str,
                  broadcast_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Unit TF-IDF vectors of both sides as rows (l, t, w) and (r, t, wn); document frequencies are the right side's.

    Both are written, as several joins read them. The right side is broadcast where its tokens and numbers take at most
    ``broadcast_bytes``, else it is shuffled."""
    rw, idf, default_idf = right_weights(right, rkey, rtext)
    small = fits_broadcast(rw, broadcast_bytes)
    return left_weights(left, lkey, ltext, idf, default_idf, small), F.broadcast(rw) if small else rw


def by_repeats(left: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose key comes once, and those whose key comes again (None without any). Null keys match nothing."""
    rows = left.where(F.col(key).isNotNull())
    again = cut_lineage(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(key))
    size = again.agg(F.sum(F.octet_length(F.col(key).cast("string")) + 32)).first()[0]
    if size is None:
        return rows, None
    again = F.broadcast(again) if size <= BROADCAST_BYTES else again
    return rows.join(again, key, "left_anti"), rows.join(again, key, "left_semi")


def matched(left: DataFrame, lkey: str, ltext: str, right: DataFrame, rkey: str, rtext: str, n: int | None, joined) -> DataFrame:
    """(l, r, cosine, rank or not) by the cheaper way: rows whose key comes once are scored where they are, against an index
    of the right side that goes to all tasks; ``joined`` (of lw, rw) does the texts that are spread over rows, and all
    texts where the right side is too large for that."""
    rw, idf, default_idf = right_weights(right, rkey, rtext)
    small = fits_broadcast(rw)
    once, again = by_repeats(left, lkey) if small else (None, left)
    found = None
    if once is not None:
        found = score_rows(spread(once.select(lkey, ltext)), lkey, ltext, Index(rw, idf, default_idf), n)
    if again is None:
        return found
    more = joined(left_weights(again, lkey, ltext, idf, default_idf, small), F.broadcast(rw) if small else rw)
    return more if found is None else found.select(*more.columns).unionByName(more)


def tfidf_similarity(left: DataFrame, lkey: str, ltext: str, right: DataFrame, rkey: str, rtext: str) -> DataFrame:
    """(l, r, cosine) for every left/right pair sharing at least one token (for a right side of a few phrases)."""
    def joined(lw, rw):
        return lw.join(rw, "t").groupBy("l", "r").agg(F.sum(F.col("w") * F.col("wn")).alias("cosine"))

    return matched(left, lkey, ltext, right, rkey, rtext, None, joined).select("l", "r", "cosine")


SLACK = 4e-9  # cosines that agree to 9 decimals are ties, so bounds closer than this decide nothing


def match_bounds(lw: DataFrame, rw: DataFrame, n: int, first_tokens: int = 8) -> DataFrame:
    """(l, t, w, essential, rest, least): what can keep a right text out of the ``n`` best of a left one.

    The right side is an inverted index ordered by impact: every token has its greatest weight, the bound of what it
    adds, and its ``n`` weightiest postings. The postings of a left text's ``first_tokens`` strongest tokens give ``n``
    pairs and with them ``least``, a score that the n-th best reaches. Tokens whose bounds together stay below it (``rest``)
    are not essential: a pair that shares no other token cannot come in."""
    heavy = Window.partitionBy("t").orderBy(F.desc("wn"), "r")
    index = (rw.withColumn("k", F.row_number().over(heavy)).where(F.col("k") <= n)
             .groupBy("t").agg(F.max("wn").alias("most"), F.collect_list(F.struct("r", "wn")).alias("head")))
    strong = Window.partitionBy("l").orderBy(F.desc("u"), "t")
    weak = Window.partitionBy("l").orderBy("u", F.desc("t")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = lw.join(index, "t").withColumn("u", F.col("w") * F.col("most"))
    parts = cut_lineage(parts.withColumn("place", F.row_number().over(strong)).withColumn("upto", F.sum("u").over(weak))
                        .withColumn("head", F.when(F.col("place") <= first_tokens, F.col("head"))))
    some = (parts.where("head is not null").select("l", "w", F.explode("head").alias("h"))
            .groupBy("l", F.col("h.r").alias("r")).agg(F.sum(F.col("w") * F.col("h.wn")).alias("p")))
    best = Window.partitionBy("l").orderBy(F.desc("p"), "r")
    least = (some.withColumn("k", F.row_number().over(best)).where(F.col("k") == n).select("l", F.col("p").alias("least")))
    parts = parts.drop("head").join(least, "l", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    parts = parts.withColumn("essential", F.col("upto") >= F.col("least") - SLACK)
    rest = F.max(F.when(~F.col("essential"), F.col("upto"))).over(Window.partitionBy("l"))
    return cut_lineage(parts.withColumn("rest", F.coalesce(rest, F.lit(0.0))).select("l", "t", "w", "essential", "rest", "least"))


def candidate_pairs(bounds: DataFrame, rw: DataFrame) -> DataFrame:
    """(l, r, p): pairs with an essential token in common, their score over those tokens, that can still reach ``least``."""
    pairs = bounds.where("essential").join(rw, "t").groupBy("l", "r").agg(
        F.sum(F.col("w") * F.col("wn")).alias("p"), F.first("rest").alias("rest"), F.first("least").alias("least"))
    return pairs.where(F.col("p") + F.col("rest") >= F.col("least") - SLACK).select("l", "r", "p")


def pruned_matches(lw: DataFrame, rw: DataFrame, n: int) -> DataFrame:
    """The ``n`` best by joins: only pairs that can reach the n-th score are completed (``match_bounds``): essential tokens
    make the pairs, and the other tokens are added for those alone."""
    bounds = match_bounds(lw, rw, n)
    pairs = cut_lineage(candidate_pairs(bounds, rw))
    others = bounds.where("not essential").select("l", "t", "w")
    more = pairs.select("l", "r").join(others, "l").join(rw, ["r", "t"]).groupBy("l", "r").agg(F.sum(F.col("w") * F.col("wn")).alias("q"))
    sim = pairs.join(more, ["l", "r"], "left").select("l", "r", (F.col("p") + F.coalesce("q", F.lit(0.0))).alias("cosine"))
    w = Window.partitionBy("l").orderBy(F.desc(round_half_up("cosine", 9)), "r")
    return sim.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_matches(left: DataFrame, lkey: str, ltext: str, right: DataFrame, rkey: str, rtext: str,
                n: int = 3) -> DataFrame:
    """The ``n`` most similar right texts per left text (ties → lower right key): (l, r, cosine, rank).
    Ranked on the cosine rounded to 9 decimals so float noise cannot reorder equal scores.

    A right side that can be broadcast is an index in every task, which scores the rows it reads; else, and for texts spread
    over rows of one key, joins do it (``pruned_matches``). Left and right texts with no token in common are no match."""
    return matched(left, lkey, ltext, right, rkey, rtext, n, lambda lw, rw: pruned_matches(lw, rw, n))


def technique_phrases(spark) -> DataFrame:
    return spark.createDataFrame(list(TECHNIQUE_PHRASES.items()), "technique string, phrase string")


def suggest(df: DataFrame | None, statements: DataFrame, key: str = "id", text: str = "statement",
            phrases: DataFrame | None = None, block_terms: tuple[str, ...] = ("predict",)) -> DataFrame:
    """A2: every technique ranked per statement: (key, technique, category, use_when, score, label, rank, reasons).
    score = cosine(statement, technique phrase) + 0.2 when the data make the technique applicable (only
    when data are given); inapplicable techniques keep their similarity but carry the reason."""
    spark = statements.sparkSession
    ph = phrases if phrases is not None else technique_phrases(spark)
    sim = tfidf_similarity(statements, key, text, ph, "technique", "phrase").select(
        F.col("l").alias(key), F.col("r").alias("technique"), "cosine")
    base = statements.select(key, F.explode(F.array(*[F.lit(t) for t in TECHNIQUES])).alias("technique"))
    valid = validate(df, statements, key, text, block_terms)
    scored = (base.join(sim, [key, "technique"], "left").join(valid, [key, "technique"], "left")
              .select(key, "technique", F.coalesce(F.col("cosine"), F.lit(0.0)).alias("similarity"),
                      "applicable", "reason"))
    bonus = F.when(F.lit(df is not None) & F.col("applicable"), F.lit(0.2)).otherwise(F.lit(0.0))
    score = round_half_up(F.col("similarity") + bonus, 6)
    label = (F.when(score >= HIGH_CUTOFF, F.lit("High")).when(score >= MEDIUM_CUTOFF, F.lit("Medium"))
             .otherwise(F.lit("Low")))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "technique")
    reasons = F.array_compact(F.array(
        F.concat(F.lit("statement similarity "), F.format_number(F.col("similarity"), 3)), F.col("reason")))
    card = [F.coalesce(*[F.when(F.col("technique") == t, F.lit(c[i])) for t, c in TECHNIQUE_CARDS.items()]) for i in (0, 1)]
    return (scored.select(key, "technique", card[0].alias("category"), card[1].alias("use_when"), score.alias("score"),
                          label.alias("label"), reasons.alias("reasons"), "applicable")
            .withColumn("rank", F.row_number().over(w)))
