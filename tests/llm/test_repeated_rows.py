"""Rows that repeat a doc_id, in the mix and in the pipeline's exact stage."""

from collections import Counter

import corpus_pipeline
from lodestrata.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_copies_of_repeated_rows(spark):
    rows = [(7, "same text of six words here", "en", "s1", 1)] * 4 + [(7, "another text", "en", "s1", 2), (None, "no id", "en", "s0", 3), (None, "no id", "en", "s0", 3)]
    rows += [(i, "w " * (i + 1), "en", f"s{i % 3}", i) for i in range(10, 40)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r["size"]] += r.copies
    found = mixing.copies(docs)
    assert found.columns == docs.columns
    assert Counter((r.doc_id, len(r.text.split())) for r in found.collect()) == +want
    assert want[7, 6] > 1


def test_exact_stage_keeps_one_row(spark):
    rows = [(1, "a b", "en", "s", 3)] * 3 + [(1, "a  b", "en", "s", 4), (2, "ab", "en", "s", 2), (2, "other", "en", "s", 5), (None, "x", None, None, None), (None, "x", None, None, None), (0, "y", "en", "s", 1), (4, None, "en", "s", 0), (4, "", "en", "s", 0)]
    found = corpus_pipeline.exact_stage(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()
    assert Counter((r.doc_id, r.text or "") for r in found) == Counter([(1, "a  b"), (2, "other"), (None, "x"), (0, "y"), (4, "")])
    empty = spark.createDataFrame([], SCHEMA)
    assert corpus_pipeline.exact_stage(spark, empty, "").count() == 0 and mixing.copies(empty).count() == 0
