"""Spans of regular-expression matches as columns, in code points, by DataFrame functions only.

``regexp_extract_all`` gives the leftmost non-overlapping matches and ``split`` by the same expression the text
between them; adding up the lengths of both gives positions. Expressions are written with possessive quantifiers
and a start condition, so that no text, however long, costs more than a linear scan or deep recursion.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often a lambda inside refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def before(numbers: Column, merge, chunk: int = 128) -> Column:
    """For each number of an array the merge (sum, maximum, from 0) of all that stand before it, and at last of all.

    An aggregate copies its state at every step, so the array goes through in chunks: one short list per chunk, and one
    number per chunk in the list that joins them."""
    def listed(part, first):
        state = F.struct(first.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(part, state, lambda acc, x: F.struct(merge(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
                           lambda acc: acc)

    def chunked(n):
        ks = F.when(F.size(n) > 0, F.sequence(F.lit(0), F.ceil(F.size(n) / chunk).cast("int") - 1)).otherwise(F.expr("cast(array() as array<int>)"))
        cut = F.transform(ks, lambda k: F.slice(n, k * chunk + 1, F.lit(chunk)))
        return once(cut, lambda parts: once(
            listed(F.transform(parts, lambda part: F.aggregate(part, F.lit(0), merge)), F.lit(0)),
            lambda firsts: F.concat(F.flatten(F.transform(F.arrays_zip(parts.alias("p"), firsts["out"].alias("f")), lambda x: listed(x["p"], x["f"])["out"])),
                                    F.array(firsts["at"]))))
    return once(numbers, chunked)


def add(a, b):
    return (a + b).cast("int")


def find(text: Column, regex: str, guard: Column | None = None) -> Column:
    """array<struct<start,end,value>> of the matches in order; empty for null. ``guard`` is a cheap condition
    without which the text cannot match."""
    empty = F.expr(f"cast(array() as {SPAN})")
    matches = F.regexp_extract_all(text, F.lit(regex), F.lit(0))

    def placed(m):
        gaps = F.transform(F.slice(F.split(text, regex, -1), F.lit(1), F.size(m)), F.length)
        pairs = F.arrays_zip(m.alias("m"), gaps.alias("g"))
        starts = before(F.transform(pairs, lambda x: (x["g"] + F.length(x["m"])).cast("int")), add)
        full = F.arrays_zip(m.alias("m"), gaps.alias("g"), F.slice(starts, F.lit(1), F.size(m)).alias("b"))
        return F.transform(full, lambda x: F.struct((x["b"] + x["g"]).cast("int").alias("start"), (x["b"] + x["g"] + F.length(x["m"])).cast("int").alias("end"),
                                                    x["m"].alias("value")))

    found = once(matches, placed)
    return F.when(guard if guard is not None else F.lit(True), F.coalesce(found, empty)).otherwise(empty)


def tagged(kind: str, order: int, spans: Column) -> Column:
    """Spans with their kind and its place in the list of kinds."""
    return F.transform(spans, lambda s: F.struct(F.lit(order).alias("no"), F.lit(kind).alias("kind"), s["start"].alias("start"),
                                                 s["end"].alias("end"), s["value"].alias("value")))


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined, in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    """How many of the spans have a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


BLOCK = 512


def cutter(text: Column, use) -> Column:
    """``use(cut)`` where ``cut(a, b)`` is the text from code point a to b, found in blocks and not from the start."""
    def of(blocks):
        def cut(a, b):
            first, last = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
            inside = F.substring(F.get(blocks, first), a % BLOCK + 1, b - a)
            across = F.concat(F.substring(F.get(blocks, first), a % BLOCK + 1, F.lit(BLOCK)),
                              F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
                              F.substring(F.get(blocks, last), F.lit(1), (b - 1) % BLOCK + 1))
            return F.when(b <= a, "").when(first == last, inside).otherwise(across)
        return use(cut)
    return once(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}+"), F.lit(0)), of)


def redacted(text: Column, spans: Column, label, whole: bool = False) -> Column:
    """The text with each span (in order of start) replaced by ``label(span, cut)``; what overlaps an earlier span
    goes with it. With ``whole`` a span that reaches beyond an earlier one keeps the rest of its place: the label gets
    that rest as span."""
    def done(cut):
        def joined_up(s):
            def pieces(ends):
                def piece(x):
                    span, at = x["s"], x["at"]
                    fresh = F.concat(cut(at, span["start"]), label(span, cut))
                    if not whole:
                        return F.when(span["start"] >= at, fresh).otherwise("")
                    rest = F.struct(at.alias("start"), span["end"].alias("end"))
                    return F.when(span["start"] >= at, fresh).when(span["end"] > at, label(rest, cut)).otherwise("")
                both = F.arrays_zip(s.alias("s"), F.slice(ends, F.lit(1), F.size(s)).alias("at"))
                return F.concat(F.array_join(F.transform(both, piece), ""), cut(F.element_at(ends, -1), F.length(text)))
            return once(before(F.transform(s, lambda x: x["end"].cast("int")), lambda a, b: F.greatest(a, b)), pieces)
        return once(spans, joined_up)
    return F.when(F.size(spans) > 0, cutter(text, done)).otherwise(text)


def row_keys(text: str = "text", doc_id: str = "doc_id") -> list[Column]:
    """Two hashes that name a row by its id and text (rows that repeat both have the same spans)."""
    both = F.concat_ws("\x00", F.col(doc_id).cast("string"), F.coalesce(F.col(text), F.lit("")))
    return [F.xxhash64(both).alias("k1"), F.hash(both, F.lit(17)).alias("k2")]
