"""Secrets: base spans by rule, and multipart credentials linked by an interval join.

Weak candidates (identifiers in assignments, mixed-case tokens with digits, endpoints) say little alone. They are
reported only where complementary parts stand within ``scope`` characters of each other in one document: a weak
secret next to an identifier or endpoint, a weak identifier or endpoint next to a secret. Base spans take part as
strong parts and are always reported.

DataFrame functions only. The interval join is a range frame over the parts of a document, ordered by start, so a
document of very many parts costs a sort and a sweep, never pairs. Texts are scanned once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .spans import find, joined, of_kind, row_keys, tagged

KINDS = ("assign", "access", "hex")
WEAK = ("identifier", "key", "endpoint")
SCOPE = 300
_ASSIGN = r"""["']?\x20*+[:=]\x20*+["']?"""
_WORD = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN = _WORD + _ASSIGN + r"[A-Za-z0-9+/_.=-]++"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
IDENTIFIER = r"(?i:user(?:_?name)?|login|account|client_?id|access_?key_?id)" + _ASSIGN + r"[A-Za-z0-9@+/_.-]{3,}+"
KEY = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{16,}+"
SHORT_KEY = r"(?i:pwd|passphrase|private_?key|credential|signature)" + _ASSIGN + r"[A-Za-z0-9+/_.=-]{4,}+"
ENDPOINT = r"(?i:https?|ftp|ssh|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqp)(?i:[+:][a-z]+)?://[^\s\"'<>]++"


def base_spans(text: Column) -> Column:
    """All base spans, tagged, by start and then kind."""
    low = F.lower(text)
    assign = F.filter(find(text, ASSIGN, low.rlike(r"passw|secret|token|api_?key")),
                      lambda s: F.length(F.regexp_extract(s["value"], _WORD + _ASSIGN + "(.*)$", 1)) >= 6)
    access = find(text, ACCESS, F.contains(text, F.lit("AKIA")))
    hexes = find(text, HEX, text.rlike("[0-9a-f]{24}"))
    every = F.concat(*[tagged(k, i, s) for i, (k, s) in enumerate(zip(KINDS, (assign, access, hexes)))])
    return in_order(every)


def in_order(spans: Column) -> Column:
    """By start and then kind."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["no"].alias("no"), s["end"].alias("end"), s.alias("s"))))
    return F.transform(keyed, lambda x: x["s"])


def weak_spans(text: Column) -> Column:
    """Weak candidates; those that overlap a base span are left out where the parts are linked."""
    low = F.lower(text)
    n = len(KINDS)
    ids = find(text, IDENTIFIER, low.rlike("user|login|account|client_?id|access_?key"))
    keys = F.concat(find(text, KEY, text.rlike("[A-Za-z0-9+/_-]{16}") & text.rlike("[0-9]")),
                    find(text, SHORT_KEY, low.rlike("pwd|passphrase|private_?key|credential|signature")))
    ends = find(text, ENDPOINT, F.contains(text, F.lit("://")))
    return F.concat(*[tagged(k, n + i, s) for i, (k, s) in enumerate(zip(WEAK, (ids, keys, ends)))])


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """docs (doc_id, text, …) → one row per input row: doc_id, k1, k2 (row hashes), base and linked: arrays of
    spans (no, kind, start, end, value) by start and kind.

    Null and empty texts have no spans. Null ids stay null; repeated rows are each returned; extra columns are
    ignored; an empty table gives no rows."""
    rows = cut_lineage(docs.select("doc_id", "text", *row_keys()).withColumn("base", base_spans(F.col("text")))
                       .select("doc_id", "k1", "k2", "base", weak_spans(F.col("text")).alias("weak")))
    parts = (rows.where(F.size("weak") > 0).dropDuplicates(["k1", "k2"])
             .select("k1", "k2", F.explode(F.concat("base", "weak")).alias("s")).withColumn("start", F.col("s.start")))
    kind, is_base = F.col("s.kind"), F.col("s.no") < len(KINDS)
    # a weak part overlaps a base span that starts before its end if one before reaches into it, or the next starts in it
    upto = Window.partitionBy("k1", "k2").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("k1", "k2").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, -1)
    parts = (parts.withColumn("reach", F.max(F.when(is_base, F.col("s.end"))).over(upto))
             .withColumn("next", F.min(F.when(is_base, F.col("start"))).over(after))
             .where(is_base | (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("s.end")))))
    near = Window.partitionBy("k1", "k2").orderBy("start").rangeBetween(-scope, scope)
    seen = {name: F.max(kind.isin(*kinds)).over(near) for name, kinds in
            (("secret", ("assign", "hex", "key")), ("other", ("access", "identifier", "endpoint")))}
    linked = (parts.withColumn("with_secret", seen["secret"]).withColumn("with_other", seen["other"])
              .where((kind == "key") & F.col("with_other") | kind.isin("identifier", "endpoint") & F.col("with_secret"))
              .groupBy("k1", "k2").agg(F.collect_set("s").alias("linked")))
    empty = F.expr("cast(array() as array<struct<no:int,kind:string,start:int,end:int,value:string>>)")
    return (rows.drop("weak").join(linked, ["k1", "k2"], "left")
            .select("doc_id", "k1", "k2", F.coalesce("base", empty).alias("base"), in_order(F.coalesce("linked", empty)).alias("linked")))


def digest(found: DataFrame) -> DataFrame:
    counts = [of_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                        joined(in_order(F.concat("base", "linked"))).alias("spans"))
