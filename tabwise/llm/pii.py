"""Personal data: base spans by rule, and an information-theoretic measure of the terms that disclose them.

Every email, address, card and phone number found is a protected entity. Over the whole corpus, with documents as
contexts, n_e documents hold entity e, n_t hold term t, n_et hold both, out of N. The corpus estimate of P(t|e) is drawn
towards independence by ``prior`` documents, (n_et + prior n_t / N) / (n_e + prior), so that it holds for entities of one
or two documents as well; log2(P(t|e) N / n_t) says how many of the entity's log2(N / n_e) bits the term gives away.
Terms whose share reaches ``generalise_at`` are spans of kind ``term`` wherever they stand in a document that holds the
entity: generalised to their class, or removed from ``remove_at`` on.

DataFrame functions only. Scale: two scans of the texts (spans; term counts with map-side aggregation), and joins on
rows without texts; texts are shuffled only where rows repeat, and for documents with an entity when they are rewritten.
Positions come from sums over the pieces of a text, texts are cut in blocks, and spans that overlap are told by blanking
the text, so a text of very many spans costs little more than its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .spans import find, joined, of_kind, redacted, row_keys, tagged

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"[\p{L}\p{N}]++"
BLANK = "\ufdd0"  # a noncharacter that stands for letters and digits of base spans
FREE_TERM = rf"(?<![\p{{L}}\p{{N}}{BLANK}])[\p{{L}}\p{{N}}]++(?!{BLANK})"
GENERALISE_AT, REMOVE_AT = 0.9, 0.96
PRIOR = 0.5  # weight, in documents, of independence in the smoothed estimate


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _byte(part: Column) -> Column:
    """A number of any length is at most 255."""
    short = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return F.when(F.length(short) <= 3, short.cast("int") <= 255).otherwise(F.lit(False))


def _luhn(v: Column) -> Column:
    d = _digits(v)
    n = F.length(d)

    def add(acc, i):  # i = 0 at the last digit
        x = F.substring(d, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: (add(acc, i)).cast("int"))
    return F.when(n.between(16, 19), total % 10 == 0).otherwise(F.lit(False))


def base_spans(text: Column) -> Column:
    """All base spans, tagged, by kind and then start."""
    digit = text.rlike("[0-9]")
    email = find(text, EMAIL, F.contains(text, F.lit("@")))
    ip = F.filter(find(text, IP, text.rlike(r"[0-9]\.[0-9]")), lambda s: F.forall(F.split(s["value"], r"\."), _byte))
    card = F.filter(find(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")), lambda s: _luhn(s["value"]))
    phone = F.filter(find(text, PHONE, digit & F.contains(text, F.lit("+"))),
                     lambda s: F.length(_digits(s["value"])).between(8, 15))
    return F.concat(*[tagged(k, i, s) for i, (k, s) in enumerate(zip(KINDS, (email, ip, card, phone)))])


def possible(text: Column) -> Column:
    """Without this no kind matches."""
    return F.coalesce(text.rlike(r"@[A-Za-z0-9-]|[0-9]\.[0-9]|\+[0-9]|[0-9](?:[\x20-]?[0-9]){15}"), F.lit(False))


def _terms(text: Column) -> Column:
    """Distinct lower-cased terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def blanked(text: Column, base: Column) -> Column:
    """The text with the letters and digits of base spans as BLANK and their other characters as spaces, so that a term
    that shares a character with a base span stands next to a BLANK or is gone."""
    def label(s, cut):
        return F.regexp_replace(F.regexp_replace(cut(s["start"], s["end"]), r"[\p{L}\p{N}]", BLANK), f"[^{BLANK}]", " ")
    ordered = F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return redacted(F.translate(text, BLANK, " "), ordered, label, whole=True)


def find_personal_data(docs: DataFrame, generalise_at: float = GENERALISE_AT, prior: float = PRIOR) -> DataFrame:
    """docs (doc_id, text, …) → one row per input row: doc_id, k1, k2 (row hashes), base, terms: arrays of spans
    (no, kind, start, end, value; of terms also share), by kind and start.

    Null and empty texts have no spans. Null ids stay null; repeated rows are each returned and count as one
    document with their id; extra columns are ignored; an empty table gives no rows.

    Terms with N·(n_e/N)^generalise_at documents or more cannot reach the share and never meet an entity."""
    k1, k2 = row_keys()
    rows = cut_lineage(docs.select("doc_id", "text", k1, k2)
                       .select("doc_id", "k1", "k2", "text", F.when(possible(F.col("text")), base_spans(F.col("text"))).alias("base"))
                       .select("doc_id", "k1", "k2", "base", F.when(F.size("base") > 0, F.col("text")).alias("text")))
    held = rows.where("text is not null").dropDuplicates(["k1", "k2"])
    entity = cut_lineage(held.select("k1", "k2", F.explode("base").alias("b"))
                         .select("k1", "k2", F.col("b.kind").alias("kind"), F.lower("b.value").alias("entity")).distinct())
    # entities of the very same documents have the same terms and shares: one stands for all of them, so that a document
    # of very many entities does not meet its terms once for each
    places = [F.bit_xor(F.xxhash64("k1", "k2")).alias("a"), F.bit_xor(F.xxhash64("k2", "k1")).alias("b")]
    n_e = (entity.groupBy("kind", "entity").agg(F.count(F.lit(1)).alias("n_e"), *places)
           .groupBy("n_e", "a", "b").agg(F.min(F.struct("kind", "entity")).alias("one")).select("n_e", "one.kind", "one.entity"))
    n_rows, total = rows.count(), rows.select("k1", "k2").distinct().count()
    most = n_e.agg(F.max("n_e")).first()[0] or 0
    n = F.lit(float(max(total, 1)))
    once = docs if n_rows == total else docs.select("text", k1, k2).dropDuplicates(["k1", "k2"])
    n_t = (once.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
           .where(F.col("n_t") <= n * F.pow(F.lit(float(most)) / n, F.lit(generalise_at)) + 1e-6))
    words = held.select("k1", "k2", F.explode(_terms(F.col("text"))).alias("term")).join(n_t, "term")
    met = cut_lineage(entity.join(n_e.where(F.col("n_e") < total), ["kind", "entity"]).join(words, ["k1", "k2"])
                      .where(F.col("n_t") <= n * F.pow(F.col("n_e") / n, F.lit(generalise_at)) + 1e-6))
    p = (F.col("n_et") + prior * F.col("n_t") / n) / (F.col("n_e") + prior)
    flagged = (met.groupBy("kind", "entity", "term", "n_e", "n_t").agg(F.count(F.lit(1)).alias("n_et"))
               .withColumn("share", F.log2(p * n / F.col("n_t")) / F.log2(n / F.col("n_e")))
               .where(F.col("share") >= generalise_at - 1e-9).select("kind", "entity", "term", "share"))
    shares = met.join(flagged, ["kind", "entity", "term"]).groupBy("k1", "k2", "term").agg(F.max("share").alias("share"))
    places = held.select("k1", "k2", F.explode(find(blanked(F.col("text"), F.col("base")), FREE_TERM)).alias("t")) \
        .select("k1", "k2", F.lower("t.value").alias("term"), "t.start", "t.end")
    span = F.struct(F.lit(len(KINDS)).alias("no"), F.lit("term").alias("kind"), "start", "end", F.col("term").alias("value"), "share")
    marked = places.join(shares, ["k1", "k2", "term"]).groupBy("k1", "k2").agg(F.array_sort(F.collect_list(span)).alias("terms"))
    empty = "cast(array() as array<struct<no:int,kind:string,start:int,end:int,value:string{}>>)"
    return (rows.drop("text").join(marked, ["k1", "k2"], "left")
            .select("doc_id", "k1", "k2", F.coalesce("base", F.expr(empty.format(""))).alias("base"),
                    F.coalesce("terms", F.expr(empty.format(",share:double"))).alias("terms")))


def sanitise(docs: DataFrame, remove_at: float = REMOVE_AT, **args) -> DataFrame:
    """docs with personal data replaced in ``text``: base spans by their kind in brackets, disclosing terms by
    [TERM] or [NUMBER], or by nothing from a share of ``remove_at`` on. All other columns and rows stay as they are."""
    found = (find_personal_data(docs, **args).where((F.size("base") > 0)).dropDuplicates(["k1", "k2"])
             .select("k1", "k2", F.array_sort(F.concat(
                 F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("label"))),
                 F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(
                     s["share"] >= remove_at - 1e-9, F.lit("")).when(s["value"].rlike("^[0-9]+$"), F.lit("[NUMBER]")).otherwise(F.lit("[TERM]")).alias("label"))))).alias("spans")))
    names = docs.columns
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), possible(F.col("text")).alias("may"), *row_keys())
    changed = (work.where("may").join(found, ["k1", "k2"], "left")
               .select("row", F.when(F.col("spans").isNotNull(), redacted(F.col("row.text"), F.col("spans"), lambda s, cut: s["label"]))
                       .otherwise(F.col("row.text")).alias("clean")))
    out = work.where("not may").select("row", F.col("row.text").alias("clean")).unionByName(changed)
    return out.select(*[F.col("clean").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names])


def digest(found: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans of ``find_personal_data``."""
    counts = [of_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                        F.concat_ws(",", F.when(F.size("base") > 0, joined(F.col("base"))),
                                    F.when(F.size("terms") > 0, joined(F.col("terms")))).alias("spans"))
