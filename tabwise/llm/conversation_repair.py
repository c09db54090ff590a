"""Conversation structure repair (operator 11): the cheapest edits that give every conversation a legal turn order.

A legal conversation is empty, or an optional system turn followed by user/assistant pairs. Rows are edited by Keep (0),
Rerole (1), Delete (2, forced on blank and duplicate rows) and Insert (5); a truncated row that stays adds 5. Of all
cheapest audits the ASCII-least is chosen.

Hirschberg's divide and conquer over four states (nothing yet, after system, after user, after assistant): a forward
vector of costs from the start and a backward vector from the end meet in the middle of the conversation; of the
crossing states with the least sum the one with the ASCII-least way to it is taken, and both halves are solved the same
way. Only vectors are held. Comparing ways needs no strings: two ways to different states differ before either ends
(each holds one letter other than I per row and ends in one), so a vector carries the order of its four ways.

Conversations may be of any length. Equal rows are counted before the first shuffle (all but the first are duplicates
and deleted), rows are range-partitioned by conversation and turn, and each task repairs the conversations that lie
wholly inside its range. One that is longer than a chunk, or touches the border of a range, is cut into chunks: each
chunk gives its 4 x 4 table of costs, the tables of a conversation are joined to find the states at the cuts, and the
chunks are then solved on their own. Digests run over the repaired chunks in order, one chunk in memory at a time.

Nulls: role and text read as one space, turns sort first and count for no gap, a null conv_id is one conversation.
Equal turns are taken in the order of role, then text (bytes). An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

WHITE = " \t\n\x0b\f\r"
CHUNK_ROWS, CHUNK_CHARS = 1 << 14, 4 << 20
FAR = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)
FORCED = (USER, USER, ASSISTANT, USER)  # what an inserted or reroled turn leads to, by state
KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
CLOSING = (0, 10, 5, 0)  # inserts that complete the last pair
NAMES = {USER: "user", ASSISTANT: "assistant"}
FINE, TRUNCATED, GONE = range(3)


def moves(initial: str, fault: int) -> list[list[tuple[int, int, int, str]]]:
    """By state the cheapest edits of a row to every next state: (next, cost, order among them, letters)."""
    table = []
    for state in range(4):
        best = {state: (2, "D")}
        at, extra = state, 5 if fault == TRUNCATED else 0
        for inserts in range(4 if fault != GONE else 0):
            options = [(FORCED[at], 1, "R")]
            if at in KEEPS.get(initial, {}):
                options.append((KEEPS[initial][at], 0, "K"))
            for to, cost, letter in options:
                best[to] = min(best.get(to, (FAR, "")), (5 * inserts + cost + extra, "I" * inserts + letter))
            at = FORCED[at]
        order = sorted(best, key=lambda to: best[to][1])
        table.append([(to, best[to][0], order.index(to), best[to][1]) for to in best])
    return table


def forward(vector: tuple, table) -> tuple:
    """The vector ((cost, order) by state) after one row or chunk, costs relative to the least, and that least cost."""
    best = {}
    for state, (cost, order) in enumerate(vector):
        if cost < FAR:
            for to, more, way, *_ in table[state]:
                if to not in best or (cost + more, order, way) < best[to]:
                    best[to] = (cost + more, order, way)
    least = min(cost for cost, _, _ in best.values())
    # a way that has kept no pair yet and costs 13 more than another can never win (from there two inserts and one
    # deletion do what it can), so vectors stay few
    best = {to: b for to, b in best.items() if to > SYSTEM or b[0] - least <= 20}
    ranked = sorted(best, key=lambda to: best[to][1:])
    return tuple((best[to][0] - least, ranked.index(to)) if to in best else (FAR, 4) for to in range(4)), least


def backward(vector: tuple, table) -> tuple:
    """Cost from every state before a row or chunk to the end, given those after it."""
    return tuple(min([FAR] + [more + vector[to] for to, more, *_ in table[state]]) for state in range(4))


class Solver:
    """Row kinds, and steps of vectors remembered (few differ once costs are relative)."""

    def __init__(self):
        self.tables = {initial + str(fault): moves(initial, fault) for initial in "suao" for fault in range(3)}
        self.ahead, self.back = {}, {}

    def _back(self, vector, kind):
        step = self.back.get((vector, kind))
        if step is None:
            new = backward(vector, self.tables[kind])
            least = min(new)
            step = self.back[vector, kind] = tuple(c - least if c < FAR else FAR for c in new)
        return step

    def _ahead(self, vector, kind):
        step = self.ahead.get((vector, kind))
        if step is None:
            step = self.ahead[vector, kind] = forward(vector, self.tables[kind])
        return step

    def transfer(self, kinds: list[str]) -> list[list[tuple[int, int, int]]]:
        """The table of a chunk: by state (next, cost, order of the ways)."""
        out = []
        for state in range(4):
            vector, total = tuple((0, 0) if s == state else (FAR, 4) for s in range(4)), 0
            for kind in kinds:
                vector, least = self._ahead(vector, kind)
                total += least
            out.append([(to, cost + total, order) for to, (cost, order) in enumerate(vector) if cost < FAR])
        return out

    def solve(self, kinds: list[str], state: int, end: tuple) -> tuple[list[str], int]:
        """Letters of every row on the audit-least cheapest way from ``state`` to ``end`` (costs by last state), and
        the last state. Halves wait on a stack, so only vectors and the letters found are held."""
        letters, todo = [], [(0, len(kinds), end)]
        while todo:
            low, high, end = todo.pop()
            if high - low == 1:
                to, _, _, way = min(self.tables[kinds[low]][state], key=lambda m: (m[1] + end[m[0]], m[2]))
                letters.append(way)
                state = to
            elif high > low:
                middle = (low + high) // 2
                ahead = tuple((0, 0) if s == state else (FAR, 4) for s in range(4))
                for k in range(low, middle):
                    ahead, _ = self._ahead(ahead, kinds[k])
                back = end
                for k in range(high - 1, middle - 1, -1):
                    back = self._back(back, kinds[k])
                crossing = min(range(4), key=lambda s: (ahead[s][0] + back[s], ahead[s][1]))
                todo.append((middle, high, end))
                todo.append((low, middle, tuple(0 if s == crossing else FAR for s in range(4))))
        return letters, state

    def cost(self, kinds: list[str], letters: list[str], state: int) -> int:
        total = 0
        for kind, way in zip(kinds, letters):
            state, more = next((to, cost) for to, cost, _, w in self.tables[kind][state] if w == way)
            total += more
        return total


def edited(roles, texts, copies, letters, state, closing: bool):
    """(audit, repaired (role, text) turns): further copies of a row are deleted, inserts have no text."""
    audit, turns = [], []
    for role, text, n, way in zip(roles, texts, copies, letters):
        audit.append(way + "D" * (n - 1))
        for letter in way:
            if letter == "D":
                continue
            keeps = KEEPS.get(role[:1], {}) if letter == "K" else {}
            state = keeps.get(state, FORCED[state])
            turns.append((role if letter == "K" else NAMES[state], "" if letter == "I" else text))
    if closing:
        for _ in range(CLOSING[state] // 5):
            audit.append("I")
            state = FORCED[state]
            turns.append((NAMES[state], ""))
    return "".join(audit), turns


def damage(rows: DataFrame) -> DataFrame:
    """The faults that the query plants, by crc32 of ``conv_id:turn`` modulo 20 (nulls: one space): 0 drops the row,
    1 empties the text, 2 removes its ``.!?``, 3 repeats the row, 4 makes it a user's."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    hurt = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("d")).where("d <> 0")
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    again = F.when(F.col("d") == 3, 2).otherwise(1)
    return hurt.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.explode(F.sequence(F.lit(1), again)).alias("n")).drop("n")


def marked(rows: DataFrame) -> DataFrame:
    """Distinct rows with the number of copies, and for the first copy its fault and the kind of row it is."""
    blank = F.lit(" ")
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    rows = rows.withColumn("same", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    # keys without nulls, so that counting and joining share one partitioning and texts move once
    zero = F.lit(0).cast("long")
    parts = {"c": F.coalesce("conv_id", zero), "c_known": F.col("conv_id").isNotNull(), "t": F.coalesce("turn", zero), "t_known": F.col("turn").isNotNull()}
    keys, said = [*parts, "same"], ["c", "c_known", "same"]
    rows = rows.withColumns(parts)
    turns = rows.select(keys).distinct()
    first = turns.groupBy(said).agg(F.min(F.struct("t_known", "t")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = turns.join(first, said).where("first <> struct(t_known, t)").select(keys).withColumn("later", F.lit(True))
    rows = rows.groupBy(keys).agg(F.first("role").alias("role"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    rows = rows.join(later, keys, "left").withColumns({"conv_id": F.when(F.col("c_known"), F.col("c")), "turn": F.when(F.col("t_known"), F.col("t"))})
    end = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    fault = F.when(end == "", "blank").when(F.col("later"), "duplicate").when(~end.isin(".", "!", "?"), "truncated").otherwise("")
    initial = F.substring("role", 1, 1)
    kind = F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("o"),
                    F.when(F.col("fault") == "truncated", str(TRUNCATED)).when(F.col("fault") == "", str(FINE)).otherwise(str(GONE)))
    return rows.withColumn("fault", fault).select("conv_id", "turn", "role", "text", "copies", "fault", kind.alias("kind"))


_TURNS = "known long, least long, most long, turns long, blank long, duplicate long, truncated long, illegal long, head string, tail string"
_PIECE = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("whole", pa.bool_()), *[
    (n, pa.string() if n in ("head", "tail") else pa.int64()) for n in (c.split()[0] for c in _TURNS.split(", "))],
    ("cost", pa.int64()), ("audit", pa.string()), ("sha", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
    ("kinds", pa.list_(pa.string())), ("copies", pa.list_(pa.int64())), ("table", pa.list_(pa.list_(pa.int64())))])
_PIECE_SQL = f"conv_id long, part int, seq int, whole boolean, {_TURNS}, cost long, audit string, sha string, roles array<string>, " \
    "texts array<string>, kinds array<string>, copies array<long>, table array<array<long>>"


def _facts(turns, roles, faults, copies) -> dict:
    """Counts of a chunk: turns with their least, greatest and number of distinct values, faults, illegal neighbours."""
    known = [t for t in turns if t is not None]
    initials = [r[:1] for r in roles]
    count = {f: 0 for f in ("blank", "duplicate", "truncated")}
    for fault, n in zip(faults, copies):
        if fault:
            count[fault] += 1
        count["blank" if fault == "blank" else "duplicate"] += n - 1
    legal = {("s", "u"), ("u", "a"), ("a", "u")}
    illegal = sum((a, b) not in legal for a, b in zip(initials, initials[1:])) + sum(copies) - len(copies)
    return {"known": len(known), "least": known[0] if known else None, "most": known[-1] if known else None,
            "turns": sum(a != b for a, b in zip(known, [None, *known])), **count, "illegal": illegal, "head": initials[0], "tail": initials[-1]}


def _digest(turns) -> str:
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()


def _ranges(batches, texts_too: bool):
    """Conversations of one sorted range: repaired where they lie inside it (turns only with ``texts_too``), else cut into
    chunks for the next stage."""
    solver, part, seq, out, held = Solver(), TaskContext.get().partitionId(), 0, [], 0
    rows, size, now, opened, first = [], 0, None, False, True

    def flush(last: bool):
        nonlocal rows, size, seq, opened, held
        if not rows:
            return
        turns, roles, texts, copies, faults, kinds = map(list, zip(*rows))
        row = {"conv_id": now, "part": part, "seq": seq, "whole": not (opened or first or last), **_facts(turns, roles, faults, copies)}
        if row["whole"]:
            letters, final = solver.solve(kinds, START, CLOSING)
            audit, repaired = edited(roles, texts, copies, letters, START, True)
            cost = solver.cost(kinds, letters, START) + 2 * (sum(copies) - len(copies)) + CLOSING[final]
            row |= {"cost": cost, "audit": audit, "sha": _digest(repaired)}
            if texts_too:
                row |= {"roles": [r for r, _ in repaired], "texts": [t for _, t in repaired]}
        else:
            row |= {"roles": roles, "texts": texts, "kinds": kinds, "copies": copies,
                    "table": [[v for way in ways for v in way] for ways in solver.transfer(kinds)]}
        out.append(row)
        held += size
        rows, size, seq, opened = [], 0, seq + 1, True

    for batch in batches:
        for conv, turn, role, text, copies, fault, kind in zip(*(c.to_pylist() for c in batch.columns)):
            if seq + len(rows) == 0:
                now = conv
            elif conv != now:
                if rows:
                    flush(False)
                now, opened, first = conv, False, False
            rows.append((turn, role, text, copies, fault, kind))
            size += len(text) + 64
            if len(rows) >= CHUNK_ROWS or size >= CHUNK_CHARS:
                opened = True  # more rows may follow: never whole by itself
                flush(False)
            if held > 1 << 20:
                yield pa.RecordBatch.from_pylist(out, _PIECE)
                out, held = [], 0
    flush(True)
    if out:
        yield pa.RecordBatch.from_pylist(out, _PIECE)


def _cuts(group: pa.Table) -> pa.Table:
    """State before and after every chunk of a conversation, from the tables of its chunks."""
    rows = group.sort_by([("part", "ascending"), ("seq", "ascending")]).to_pylist()
    tables = [[[tuple(ways[k:k + 3]) for k in range(0, len(ways), 3)] for ways in r["table"]] for r in rows]
    ends = [CLOSING]
    for table in reversed(tables[1:]):
        ends.append(backward(ends[-1], table))
    state, out = START, []
    for k, (r, table, end) in enumerate(zip(rows, tables, reversed(ends))):
        to, _, _ = min(table[state], key=lambda m: (m[1] + end[m[0]], m[2]))
        out.append({"part": r["part"], "seq": r["seq"], "before": state, "after": to, "last": k == len(rows) - 1})
        state = to
    return pa.Table.from_pylist(out, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int32()), ("after", pa.int32()), ("last", pa.bool_())]))


def _chunks(batches):
    """Chunks with known border states, repaired."""
    solver = Solver()
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            before, after, last = row.pop("before"), row.pop("after"), row.pop("last")
            kinds, copies = row["kinds"], row["copies"]
            letters, _ = solver.solve(kinds, before, tuple(0 if s == after else FAR for s in range(4)))
            audit, repaired = edited(row["roles"], row["texts"], copies, letters, before, last)
            cost = solver.cost(kinds, letters, before) + 2 * (sum(copies) - len(copies)) + (CLOSING[after] if last else 0)
            row |= {"cost": cost, "audit": audit, "roles": [r for r, _ in repaired], "texts": [t for _, t in repaired], "kinds": None, "copies": None, "table": None}
            yield pa.RecordBatch.from_pylist([row], _PIECE)


_RESULT = pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                     ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _joined(batches):
    """Pieces sorted by conversation and place, one result row per conversation; digests grow piece by piece."""
    now, started, out = None, False, []
    legal = {("s", "u"), ("u", "a"), ("a", "u")}

    def close():
        gaps = 0 if state["least"] is None else state["most"] - state["least"] + 1 - state["turns"]
        out.append({"conv_id": now, "gaps": gaps, **{n: state[n] for n in ("blank", "duplicate", "truncated", "illegal", "cost")},
                    "audit": "".join(state["audit"]), "repaired_sha256": state["whole"] or state["sha"].hexdigest()})

    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if not started or row["conv_id"] != now:
                if started:
                    close()
                now, started = row["conv_id"], True
                state = {n: 0 for n in ("blank", "duplicate", "truncated", "illegal", "cost", "turns")} | {
                    "least": None, "most": None, "tail": None, "audit": [], "whole": row["sha"], "sha": hashlib.sha256(), "lines": 0}
            for n in ("blank", "duplicate", "truncated", "illegal", "cost"):
                state[n] += row[n]
            state["illegal"] += state["tail"] is not None and (state["tail"], row["head"]) not in legal
            state["tail"] = row["tail"]
            if row["known"]:
                state["turns"] += row["turns"] - (state["most"] == row["least"])
                state["least"] = row["least"] if state["least"] is None else state["least"]
                state["most"] = row["most"]
            state["audit"].append(row["audit"])
            for role, text in zip(row["roles"] or [], row["texts"] or []):
                state["sha"].update(("\n" * (state["lines"] > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                state["lines"] += 1
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, _RESULT)
            out = []
    if started:
        close()
    if out:
        yield pa.RecordBatch.from_pylist(out, _RESULT)


def pieces(rows: DataFrame, texts: bool = True) -> DataFrame:
    """Repaired pieces of every conversation (``whole``, or chunks in order of part and seq): counts, cost, audit and
    the repaired turns as ``roles`` and ``texts`` (without ``texts`` only their digest for whole conversations). Written under the checkpoint folder, so that chunks are cut once."""
    rows = marked(rows)
    rows = rows.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    cut = cut_lineage(rows.mapInArrow(lambda batches: _ranges(batches, texts), _PIECE_SQL))
    chunks = cut.where("not whole")
    states = chunks.select("conv_id", "part", "seq", "table").groupBy("conv_id").applyInArrow(
        _cuts, "part int, seq int, before int, after int, last boolean")
    solved = chunks.join(states, ["part", "seq"]).select(*[f.split()[0] for f in _PIECE_SQL.split(", ")], "before", "after", "last")
    return cut.where("whole").unionByName(solved.mapInArrow(_chunks, _PIECE_SQL))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    names = [f.split()[0] for f in _PIECE_SQL.split(", ")][:-3]
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    all_pieces = pieces(rows, texts=False).select(names)
    whole = all_pieces.where("whole").mapInArrow(_joined, schema)
    split = all_pieces.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return whole.unionByName(split.mapInArrow(_joined, schema))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, part, seq, place, role, text, in order of the middle three."""
    turns = pieces(rows).select("conv_id", "part", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "t"))
    return turns.select("conv_id", "part", "seq", "place", F.col("t.roles").alias("role"), F.col("t.texts").alias("text"))


def repair_all(rows: DataFrame, damaged: DataFrame) -> DataFrame:
    """``repair(damaged)`` for every conversation of ``rows``; one that lost all its rows has zeros and an empty audit."""
    ids = rows.select(F.col("conv_id").alias("c")).distinct()
    done = ids.join(repair(damaged), F.col("c").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return done.select(F.col("c").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
