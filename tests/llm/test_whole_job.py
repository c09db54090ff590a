"""Cases that an operator once left out."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[2]))

from tabwise.llm import license_scan, pii  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_rare_entities_have_terms_in_the_whole_document(spark):
    """Entities planted in one and two documents of the driver's table; their terms stand far away and repeat."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    far = " the" * 40
    planted = [(-1, f"Quorvex wrote.{far} mail once@quiet.example{far} quorvex, Quorvex"),
               (-2, f"Bramtil here{far} twice@quiet.example"), (-3, f"twice@quiet.example{far} for bramtil")]
    both = docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    text = dict(planted)
    rows = {r.doc_id: r for r in pii.find_personal_data(both).where("doc_id < 0").collect()}
    assert {d: sorted(t.value for t in r.terms if t.value in ("quorvex", "bramtil")) for d, r in rows.items()} == {
        -1: ["quorvex"] * 3, -2: ["bramtil"], -3: ["bramtil"]}
    assert all(text[d][t.start:t.end].lower() == t.value and t.value != "the" and 0.9 <= t.share < 1 for d, r in rows.items() for t in r.terms)
    clean = {r.doc_id: r.text for r in pii.sanitise(both).where("doc_id < 0").collect()}
    assert clean[-1] == f"[TERM] wrote.{far} mail [EMAIL]{far} [TERM], [TERM]".replace("wrote", "[TERM]" if any(
        t.value == "wrote" for t in rows[-1].terms) else "wrote").replace("mail", "[TERM]" if any(t.value == "mail" for t in rows[-1].terms) else "mail")


def test_document_wide_terms_equal_sql_and_ignore_repeats(spark, tmp_path):
    import duckdb

    from tabwise.llm.span_sql import PII_SQL
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(PII_SQL)
    names = [c[0] for c in want.description]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = pii.digest(pii.find_personal_data(docs))
    want = sorted(tuple(r[names.index(c)] for c in got.columns) for r in want.fetchall())
    assert sorted(map(tuple, got.collect())) == want and sum("term:" in r[-1] for r in want) > 10
    twice = pii.digest(pii.find_personal_data(docs.unionByName(docs)))
    assert sorted(map(tuple, twice.distinct().collect())) == want and twice.count() == 2 * len(want)
    assert pii.find_personal_data(docs.where("false")).count() == 0


def test_licences_with_long_insertions_and_back_to_back(spark):
    mit = max((t for n, t in license_scan.TEMPLATES if n == "MIT"), key=len).split()
    k, short = len(mit) // 2, "Released under the MIT License."
    clause = [f"added{i}" for i in range(40)]
    lines = " ".join(f"{i // 6} {w}" if i % 6 == 0 else w for i, w in enumerate(mit))
    rem = " ".join(f"REM {w}" if i % 5 == 0 else w for i, w in enumerate(mit))
    texts = [" ".join([*mit[:k], *clause[:n], *mit[k:]]) for n in (0, 7, 40)] + [lines, rem, f"{short} {short}", " ".join([short] * 40),
             "Licensed under CC BY 4.0. " * 2, " ".join([*mit, *mit, *mit[:k], *clause[:9], *mit[k:]]), " ".join(mit[:k]), " ".join([*mit[k:], *mit[:k]]),
             " ".join([*mit[20:25], *clause, *clause[:10], *mit[:k], *clause, *mit[k:]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.licensed_documents(docs).collect()}
    assert {d: (r.licenses, r.n_matches) for d, r in got.items()} == {
        **{d: ("MIT", 1) for d in range(5)}, 5: ("MIT", 2), 6: ("MIT", 40), 7: ("CC-BY-4.0", 2), 8: ("MIT", 3), 11: ("MIT", 1)}
    assert all(s.endswith(":100") for r in got.values() for s in r.spans.split(","))
    assert got[2].spans == f"MIT:0:{len(texts[2]) - (not texts[2][-1].isalnum())}:100"
