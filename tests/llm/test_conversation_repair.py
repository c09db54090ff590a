"""Conversation repair against a plain table of all states with the audits themselves."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tabwise.llm import conversation_repair as C

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def brute(rows):
    """One conversation, rows in order: every state keeps its cheapest audit as (cost, audit, lines)."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    def inserted(ways):
        for _ in range(4):
            for state, (cost, audit, lines) in list(ways.items()):
                for to in "ua":
                    if (state, to) in after:
                        new = (cost + 5, audit + "I", [*lines, names[to] + ":"])
                        ways[to] = min(ways.get(to, new), new)
        return ways

    ways = {"": (0, "", [])}
    for (_, _, role, text), fault in zip(rows, faults):
        new = {}
        for state, (cost, audit, lines) in inserted(dict(ways)).items():
            options = [(state, 2, "D", [])]
            if fault in ("", "truncated"):
                more = 5 if fault else 0
                if (state, role[:1]) in after:
                    options.append((role[:1], more, "K", [f"{role}:{text}"]))
                options += [(to, 1 + more, "R", [f"{names[to]}:{text}"]) for to in "ua" if (state, to) in after]
            for to, extra, letter, line in options:
                way = (cost + extra, audit + letter, lines + line)
                new[to] = min(new.get(to, way), way)
        ways = new
    cost, audit, lines = min(w for s, w in inserted(ways).items() if s in ("", "a"))
    turns = [t for _, t, _, _ in rows if t is not None]
    initials = [r[:1] for _, _, r, _ in rows]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(original):
    rows = sorted(damaged(original), key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()) if r[0] is not None
                  else (False, 0, r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    return {conv: brute([r for r in rows if r[0] == conv]) for conv in {r[0] for r in original}}


def check(spark, original):
    df = spark.createDataFrame(original, SCHEMA).withColumn("kind", F.lit("x")).withColumn("n", F.lit(1))
    got = C.repair_all(df, C.damage(df)).select(COLUMNS).collect()
    want = expected(original)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r[0]], (r, want[r[0]])


def made(n, seed, roles=("system", "user", "assistant", "tool", "", None), most=14):
    rnd = random.Random(seed)
    texts = ["Yes.", "no", "Right!", "", " ", "a. b", None, "Why? ", "é…", "x"]
    return [(conv, turn if rnd.random() < 0.9 else rnd.choice([None, 3]), rnd.choice(roles),
             (rnd.choice(texts) or "") + str(rnd.randrange(9)) + rnd.choice([".", ""]) if rnd.random() < 0.6 else rnd.choice(texts))
            for conv in range(n) for turn in range(rnd.randrange(1, most))]


def test_every_conversation_of_random_rows(spark):
    rows = made(150, 1) + made(60, 2, ("user", "assistant"), 30)[0:400]
    check(spark, [(c + 1000 * (k % 2), t, r, x) for k, (c, t, r, x) in enumerate(rows)] + [(None, 1, "user", "Hi."), (None, None, "assistant", "So.")])


def test_chunks_of_long_conversations(spark, monkeypatch):
    """Conversations cut into chunks of seven rows give the same audits; equal rows many times over too."""
    monkeypatch.setattr(C, "CHUNK_ROWS", 7)
    rows = made(4, 5, ("system", "user", "assistant", "user"), 300)
    rows += [(77, 5, "user", "again and again.")] * 400 + [(77, t, "assistant", "same.") for t in range(60)]
    check(spark, rows)


def test_a_long_conversation_in_one_piece():
    """20,000 rows by halving: cost and audit equal the plain table's."""
    rnd = random.Random(3)
    kinds = [rnd.choice("suao") + str(rnd.choice([0, 0, 0, 1, 2])) for _ in range(3000)]
    solver = C.Solver()
    letters, final = solver.solve(kinds, C.START, C.CLOSING)
    rows = [(0, i, {"s": "system", "u": "user", "a": "assistant", "o": "tool"}[k[0]], "" if k[1] == "2" else f"{i}" + ("." if k[1] == "0" else "")) for i, k in enumerate(kinds)]
    want = brute(rows)
    assert solver.cost(kinds, letters, C.START) + C.CLOSING[final] == want[5]
    assert "".join(letters) + "I" * (C.CLOSING[final] // 5) == want[6]
    assert len(solver.ahead) < 2000 and len(solver.back) < 2000
    table = solver.transfer(kinds)
    assert min(c + C.CLOSING[to] for to, c, _ in table[C.START]) == want[5]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, 1, "user", "x")] * 3 + [(2, 0, "user", "y.")]])
def test_small_tables(spark, rows):
    check(spark, rows)


def test_the_repaired_turns_are_legal(spark):
    df = spark.createDataFrame(made(40, 9), SCHEMA)
    turns = C.repaired_turns(df).orderBy("conv_id", "part", "seq", "place").collect()
    by = {}
    for r in turns:
        by.setdefault(r.conv_id, []).append(r.role[:1])
    assert by and all(re.fullmatch("(s?(ua)+)?", "".join(v)) for v in by.values())


def test_the_table_of_the_driver(spark):
    from tabwise.llm.queries import QUERIES
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = expected(rows)
    got = QUERIES["op11_conversations"](spark, "/root/testdata/sf0.001").select(COLUMNS).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want and len(got) == len(want)
