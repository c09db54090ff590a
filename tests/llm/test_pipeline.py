"""The pipeline against its stages done by hand on the smallest table, and the entry without the package."""

import sys
from pathlib import Path

import public_tokenizers
import tiktoken

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tabwise.llm import bpe, pii  # noqa: E402
from tabwise.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {r.doc_id for r in QUERIES["op10_quality"](spark, SF).collect() if r.predicted}
    docs = {d: t for d, t in docs.items() if d in good}
    docs = {d: docs[d] for d, (_, c) in brute.near_duplicates(docs).items() if d == c}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    leaked = brute.contaminated(docs, items)
    docs = {d: t for d, t in docs.items() if d not in leaked}
    spans = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    want = {}
    for d, t in docs.items():
        cuts = sorted([(s, e, f"[{k.upper()}]") for k, s, e in brute.personal(t)]
                      + [(s.start, s.end, "" if s.share >= 1 - 1e-9 else "[NUMBER]" if s.value.isdigit() else "[TERM]") for s in spans[d].terms])
        out, at = "", 0
        for s, e, label in cuts:
            if s >= at:
                out += t[at:s] + label
            at = max(at, e)
        want[d] = library.encode_ordinary(out + t[at:])
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < 200


def test_stages_return_documents_columns(spark):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "same words here again", "en", "s", 3), (4, "same words here again", "en", "s", 3)],
                                "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.where("false")):
        for _, stage in corpus_pipeline.STAGES[1:4]:  # the first needs labels of these ids
            assert stage(spark, docs, SF).columns == names
    assert len(corpus_pipeline.STAGES) == 5


def test_registered_names():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_dedup_stage_with_null_and_repeated_ids(spark):
    """Equal rows, null ids and ids that repeat: one row of each group stays."""
    text = "one two three four five six seven eight nine ten"
    rows = [(None, text), (None, text), (3, text), (3, text), (4, "other words that stand alone in this small table here"), (None, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    kept = corpus_pipeline.keep_one_of_each(spark, docs, "")
    assert kept.columns == docs.columns
    texts = sorted(str(r.text) for r in kept.collect())
    assert texts == sorted(["None", "", text, rows[4][1]])
    assert corpus_pipeline.keep_one_of_each(spark, docs.where("false"), "").count() == 0
