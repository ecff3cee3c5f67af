"""Small tables whose results were worked out by hand."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import elements as E
from lodestrata.operators import evaluate, sections, segment, vectors, views
from lodestrata.plans import coarse

H, I, P, TABLE = E.HEADER, E.ITEM, E.TEXT, E.TABLE
ELEMENT = "doc_id long, idx int, page int, type string, text string"


def _column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


def test_texts(spark):
    t = F.col("t")
    assert _column(spark, [" a b \n", "\x1cx\x1f", "", None], T.strip(t)) == ["a b", "x", "", None]
    assert _column(spark, [" 12 ", "-3", "+1_000", "3.5", "x", "", None], T.to_int(t)) == [12, -3, 1000, None, None, None, None]
    assert _column(spark, ["1. Scope", "2.3.1 X", "1.", "2024 Report", "Notes", "3 Wide"], T.heading_number(t)) == ["1", "2.3.1", None, "2024", None, "3"]
    markers = {"• a": True, "- b": True, "1) c": True, "12. d": True, "(a) e": True, "iv. f": True, "(A) g": False, "IV. h": False, "x. -": False, "a. i": False, "▪ j": True}
    assert _column(spark, list(markers), T.is_list_item(t)) == list(markers.values())
    assert _column(spark, ['One. two. Three! "Four" five?\n\nsix', "One. Two is. Three", "  ", None], T.sentences(t)) == [["One. two.", "Three!", '"Four" five?', "six"], ["One.", "Two is.", "Three"], [], None]
    assert _column(spark, ["| . . . . . . 1 |", "| a | b |", "...", ""], T.is_contents_table(t)) == [True, False, True, False]


def test_spans(spark):
    """Spans of a line meet without a space; size 12 is the body, 20 and 16 are headings, 13.9 is bold and short."""
    rows = [(1, 1, 0, 0, 0, 0, 20.0, 0, "Intro"), (1, 1, 0, 0, 1, 0, 20.04, 0, "duction"), (1, 1, 0, 1, 2, 0, 20.0, 0, " second  line ")]
    rows += [(1, 1, 1, 0, 3, 0, 12.0, 0, "Body text that is long enough to be the body of it all."), (1, 1, 2, 0, 4, 0, 12.0, 16, "Bold short"), (1, 1, 3, 0, 5, 0, 12.0, 0, "(a) item"), (1, 1, 4, 0, 6, 1, 30.0, 0, "picture"), (1, 2, 0, 0, 7, 0, 16.0, 0, "Next page"), (1, 2, 1, 0, 8, 0, 12.0, 0, "  ")]
    rows += [(2, 1, 0, 0, 0, 1, 9.0, 0, "scan")]
    spans = spark.createDataFrame(rows, "doc_id long, page int, block int, line int, pos int, block_type int, size double, flags int, text string")
    found = [tuple(r) for r in E.from_spans(spans).orderBy("doc_id", "idx").collect()]
    body = "Body text that is long enough to be the body of it all."
    assert found == [(1, 0, 1, H, 1, "Introduction second line", 1), (1, 1, 1, P, 1, body, None), (1, 2, 1, H, 1, "Bold short", 3), (1, 3, 1, I, 1, "(a) item", None), (1, 4, 2, H, 1, "Next page", 2)]
    assert [tuple(r) for r in E.unreadable(spans).collect()] == [(2, "no text")]
    assert [r.size for r in E.font_histogram(spans).where("doc_id = 1").orderBy("size").collect()] == [12.0, 16.0, 20.0]


@pytest.fixture(scope="module")
def document(spark):
    rows = [(1, P, "Preamble."), (1, H, " 1. Scope"), (1, P, "Alpha."), (2, I, "- beta"), (2, TABLE, "| . . . . . . 1 |"), (2, P, "Gamma. "), (3, TABLE, "| a | b |"), (3, H, "1.1 Detail"), (3, H, "Notes"), (4, P, None), (4, "PictureItem", "Delta."), (4, H, "2. End")]
    rows = [(1, i, *r) for i, r in enumerate(rows)] + [(2, 0, None, P, "No heading here"), (2, 1, 9, P, "  "), (3, 0, 5, H, "Only a heading")]
    return spark.createDataFrame(rows, ELEMENT).repartition(4)


def test_structural_chunks(document):
    found = sections.structural_chunks(document).orderBy("doc_id", "id").collect()
    told = [(r.doc_id, r.id, r.section_id, r.number, r.heading, r.heading_level, r.heading_path, r.pages, r.element_idxs, r.n_chars, r.contains_table, r.flush_reason) for r in found]
    assert told == [
        (1, 0, 0, None, None, 0, "", [1], [0], 9, False, "new_heading"),
        (1, 1, 1, "1", "1. Scope", 1, "1. Scope", [1, 2], [2, 3, 5], 22, False, "before_table"),
        (1, 2, 1, "1", "1. Scope", 1, "1. Scope", [3], [6], 9, True, "table_atomic"),
        (1, 3, 3, None, "Notes", 3, "1. Scope > 1.1 Detail > Notes", [4], [10], 6, False, "new_heading"),
        (2, 0, 0, None, None, 0, "", [], [0], 15, False, "end"),
    ]
    assert found[1].text == "Alpha.\n\n- beta\n\nGamma."


def test_tree(document):
    tree = sections.section_tree(document)
    rows = {(r.doc_id, r.section_id): r for r in tree.collect()}
    assert {k: (r.parent_id, r.n_chars_self, r.n_chars_total, r.pages) for k, r in rows.items()} == {
        (1, 0): (None, 9, 42, [1, 2, 3, 4]), (1, 1): (0, 27, 33, [1, 2, 3, 4]), (1, 2): (1, 0, 6, [3, 4]), (1, 3): (2, 6, 6, [3, 4]), (1, 4): (0, 0, 0, [4]), (2, 0): (None, 15, 15, []), (3, 0): (None, 0, 0, [5]), (3, 1): (0, 0, 0, [5])}
    kinds = {c: [x.idx for x in rows[1, 1][c]] for c in ("paragraphs", "lists", "tables")}
    assert kinds == {"paragraphs": [2, 5], "lists": [3], "tables": [6]} and [x.idx for x in rows[1, 3].paragraphs] == [10]
    assert {tuple(r) for r in sections.summary(tree).collect()} == {(1, "1. Scope", 4, 4, 42), (2, None, 0, 0, 15), (3, "Only a heading", 1, 1, 0)}
    stats = {r.doc_id: r for r in sections.structural_stats(sections.structural_chunks(document), tree).collect()}
    assert (stats[1].n_chunks, stats[1].n_tables, stats[1].chars, stats[1].mean_chars) == (4, 1, 46, 11.5) and (stats[3].n_chunks, stats[3].chars) == (0, 0)


def test_levels(spark):
    heads = spark.createDataFrame([(1, i, 1, H, t) for i, t in enumerate(["A", "B", "1 C", "D", "E", "1.1 F", "1.1.1 G", "2 H"])], ELEMENT)
    found = sections.sections(heads).orderBy("section_id").collect()
    assert [(r.level, r.parent_id) for r in found] == [(1, 0), (2, 1), (1, 0), (2, 3), (3, 4), (2, 3), (3, 6), (1, 0)]
    assert found[6].heading_path == "1 C > 1.1 F > 1.1.1 G" and found[6].path == [3, 6, 7]


def test_many_headings(spark):
    """More headings than a slice of the fold, against a plain stack."""
    import random

    rng, texts = random.Random(4), []
    for _ in range(300):
        texts.append(rng.choice(["Plain", ".".join(str(rng.randrange(1, 4)) for _ in range(rng.randrange(1, 5))) + " Name"]))
    found = sections.sections(spark.createDataFrame([(1, i, 1, H, t) for i, t in enumerate(texts)], ELEMENT)).orderBy("section_id").collect()
    stack, before = [], 0
    for i, t in enumerate(texts, 1):
        level = t.split()[0].count(".") + 1 if " " in t else before + 1
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, i))
        before = level
        assert (found[i - 1].level, found[i - 1].path) == (level, [s for _, s in stack])


def test_missed_headings(spark, document):
    text = "Intro para here.\n\n1.1. Beyond Things: a title. Body text.\n\n2 Methods and data. More.\n\n3.1 ab. no\n\n1. Foo bar baz.\nx"
    rows = [(1, 0, "s", 7, None, None, 0, "", [1], len(text), text, False, "end"), (1, 1, "s", 8, "4", "4 Top", 1, "4 Top", [2], len(text), text, True, "table_atomic"), (1, 2, "s", 8, "4", "4 Top", 1, "A > 4 Top", [2], len(text) + 1, "\x01" + text, False, "end"), (1, 3, "s", 8, "4", "4 Top", 1, "4 Top", [2], 5, "1 Foo", False, "end")]
    chunks = spark.createDataFrame(rows, "doc_id long, id int, strategy string, section_id int, number string, heading string, heading_level int, heading_path string, pages array<int>, n_chars int, text string, contains_table boolean, flush_reason string")
    found = sections.split_missed_headings(chunks, 60)
    assert found.columns == chunks.columns
    got = [(r.id, r.section_id, r.number, r.heading, r.heading_level, r.heading_path, r.text.split("\n")[0], r.flush_reason) for r in found.orderBy("id").collect()]
    cut = "post_split_missed_heading"
    assert got[:4] == [
        (0, 7, None, None, 0, "", "Intro para here.", "post_split_preamble"),
        (1, 7, "1.1", "1.1 Beyond Things: a title", 2, "1.1 Beyond Things: a title", "1.1. Beyond Things: a title. Body text.", cut),
        (2, 7, "2", "2 Methods and data", 2, "2 Methods and data", "2 Methods and data. More.", cut),
        (3, 7, "1", "1 Foo bar baz", 2, "1 Foo bar baz", "1. Foo bar baz.", cut),
    ]
    assert got[4] == (4, 8, "4", "4 Top", 1, "4 Top", "Intro para here.", "table_atomic")
    assert [g[0] for g in got] == list(range(10)) and got[6][5] == "A > 4 Top > 1.1 Beyond Things: a title" and got[5][6] == "\x01Intro para here."
    assert got[9] == (9, 8, "4", "4 Top", 1, "4 Top", "1 Foo", "end")


def test_segments(spark):
    rows = [(1, 0, [1.0, 0.0], 100, "1", "", "A", [1], False, "a" * 100), (1, 1, [1.0, 0.0], 100, "1", "A", "", [2, 1], True, "b" * 100), (1, 2, [0.0, 1.0], 100, "2", None, "", None, False, "c" * 100), (2, 0, [1.0, 0.0], 0, None, None, None, [], False, "")]
    units = spark.createDataFrame(rows, "doc_id long, k int, vector array<double>, n_chars int, major string, heading string, heading_path string, pages array<int>, contains_table boolean, text string")
    starts, cost, cosines = segment.solve(np.array([r[2] for r in rows[:3]]), np.array([100.0] * 3), np.array([0, 0, 1]), 200.0)
    assert starts == [0, 2] and abs(cost - 0.25) < 1e-9 and cosines == [1.0, 1.0]
    assert [tuple(r) for r in segment.rejected(units).collect()] == [(2, "no characters")]
    found = segment.solved(units)
    assert [(r.doc_id, r.target_k, r.target_chars) for r in found.collect()] == [(1, 12, 25.0)]
    told = found.withColumns({"starts": F.array(F.lit(0), F.lit(2)), "cosines": F.array(F.lit(1.0), F.lit(1.0))})
    chunk = segment.coarse_chunks(told).orderBy("id").collect()
    assert [(r.structural_ids, r.n_structural, r.n_chars, r.heading_first, r.heading_last, r.pages, r.contains_table, len(r.text)) for r in chunk] == [([0, 1], 2, 202, "A", "A", [1, 2], True, 202), ([2], 1, 100, None, None, None, False, 100)]


def test_target_k(spark):
    totals = {0: 12, 5_000: 12, 25_000: 12, 27_000: 14, 29_000: 14, 40_500: 20, 100_000: 30}
    rows = spark.createDataFrame([(t,) for t in totals], "t long").select("t", segment.target_k(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in rows} == totals


def test_evaluation(spark):
    rows = [(1, 0, [1.0, 0.0], [0, 1]), (1, 1, [0.8, 0.6], [2]), (1, 2, [0.0, 1.0], [3]), (2, 0, [1.0, 0.0], [0])]
    chunks = spark.createDataFrame(rows, "doc_id long, id long, v array<double>, structural_ids array<long>")
    asked = spark.createDataFrame([(1, 2, "Second heading", [1.0, 0.0]), (1, 9, "Not covered", [1.0, 0.0]), (2, 0, "Zero", [0.0, 1.0])], "doc_id long, gt long, query string, qv array<double>")
    said = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 0, [1.0, 0.0])], "doc_id long, id long, vector array<double>")
    report = {r.doc_id: r for r in evaluate.strategy("coarse", evaluate.covered(chunks).selectExpr("*", "100L * (id + 1) AS n_chars"), said, asked).collect()}
    one, two = report[1], report[2]
    assert (one.n, one.mean, one.least, one.most, one.median, one.coherence, one.similarity) == (3, 200.0, 100, 300, 200.0, 0.0, 0.7)
    assert (one.n_queries, one.recall_1, one.recall_3, one.recall_5) == (2, 0.0, 0.5, 0.5)
    assert [(s.gt_sid, s.q, s.first_rel_rank) for s in one.sample] == [(2, "Second heading", 1), (9, "Not covered", None)]
    assert (two.n, two.coherence, two.similarity, two.recall_1) == (1, 0.0, 0.0, 1.0)
    missing = evaluate.missing_strategy(asked, "fine").orderBy("doc_id").collect()
    assert [(r.doc_id, r.strategy, r.n, r._error) for r in missing] == [(1, "fine", None, "missing fine"), (2, "fine", None, "missing fine")]
    pairs = spark.createDataFrame([(1, 0, [1.0, 0.0])], "doc_id long, id long, v array<double>")
    assert [tuple(r) for r in evaluate.inter_adjacent(pairs, "doc_id", "id", "v").collect()] == [(1, 0.0)]
    assert [tuple(r) for r in evaluate.intra_coherence(pairs, ["doc_id", "id"], "v").collect()] == [(1, 0.0)]


def test_covered(spark):
    rows = spark.createDataFrame([(1, 5, [1, 2], None), (1, 6, None, 4), (1, 7, None, None)], "doc_id long, id long, structural_ids array<long>, parent_structural_id long")
    assert [r.covers for r in evaluate.covered(rows).orderBy("id").collect()] == [[1, 2], [4], [7]]


def test_report_of_the_whole_way(document):
    fine = coarse.structural(document)
    found = segment.coarse_chunks(segment.solved(coarse.units(fine)))
    rows = coarse.report(fine, {"structural": fine, "semantic_coarse": found, "none": None}).collect()
    told = {(r.doc_id, r.strategy): (r.n, r.n_queries, r._error) for r in rows}
    # headings of four characters: `1. Scope` twice and `Notes`
    assert told[1, "structural"] == (4, 3, None) and told[1, "none"] == (None, None, "missing none") and told[2, "structural"] == (1, 0, None)
    assert sum(found.where("doc_id = 1").select("n_structural").toPandas()["n_structural"]) == 4


def test_archives(spark):
    rows = [(1, 0, "1. A & B", [1, 2], [0, 1], 0.25, "text\nmore"), (1, 100, None, [3], [2], 1.0, None), (1, 1, "é!", [], [3], 0.0001, "t")]
    entries = views.archive_entries(spark.createDataFrame(rows, "doc_id long, id int, heading_first string, pages array<int>, structural_ids array<int>, mean_internal_cosine double, text string"))
    packed = views.archives(entries).collect()
    assert len(packed) == 1 and packed[0].n_files == 3
    with zipfile.ZipFile(io.BytesIO(bytes(packed[0].zip))) as archive:
        files = {n: archive.read(n).decode() for n in archive.namelist()}
    assert list(files) == ["chunk_00_1-A-B.txt", "chunk_01_chunk.txt", "chunk_100_chunk.txt"]
    assert files["chunk_00_1-A-B.txt"] == "# chunk 0 | pages [1, 2] | structural ids [0, 1] | mean_internal_cosine 0.25\n# heading: 1. A & B\n\ntext\nmore"
    assert files["chunk_01_chunk.txt"].startswith("# chunk 1 | pages [] | structural ids [3] | mean_internal_cosine 0.0001\n# heading: é!\n\n")
    assert files["chunk_100_chunk.txt"] == "# chunk 100 | pages [3] | structural ids [2] | mean_internal_cosine 1.0\n# heading: chunk\n\n"


def test_lists(spark, document):
    first = views.element_list(document).where("doc_id = 1 AND id = 1").head()
    assert (first.n_chars, first.preview, first.type, first.page, first.heading_level) == (9, " 1. Scope", H, 1, None)
    coarse_rows = spark.createDataFrame([(1, 0, "a\nb", "Head", [1])], "doc_id long, id int, text string, heading_first string, pages array<int>")
    row = views.chunk_list(coarse_rows).head()
    assert (row.n_chars, row.preview, row.heading, row.heading_path, row.contains_table) == (3, "a b", "Head", None, False)
    names = spark.createDataFrame([("zz.png",), ("chunk_sizes.png",), ("aa.png",), ("coarse_similarity.png",)], "name string")
    assert [r.name for r in views.figure_order(names).orderBy("place").collect()] == ["coarse_similarity.png", "chunk_sizes.png", "aa.png", "zz.png"]
    jobs = spark.createDataFrame([("a",), ("b",)], "job string")
    merged = spark.createDataFrame([("a", "done")], "job string, status string")
    assert {tuple(r) for r in views.job_status(jobs, merged, "job", "status").collect()} == {("a", "done"), ("b", "unknown")}
    page = views.counted_page(names, "name", 1, 2).collect()
    assert sorted((r.name, r.total) for r in page) == [("chunk_sizes.png", 4), ("coarse_similarity.png", 4)] and views.page(names, "name", 0, 0).count() == 0


def test_cached_encode(spark):
    def load():
        return lambda texts: np.array([[float(len(t)), 1.0] for t in texts])

    texts = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "old"), (4, None)], "i int, text string")
    cache = spark.createDataFrame([("old", [9.0, 9.0])], "t string, embedding array<float>").select(vectors.cache_key("m", F.col("t")).alias("key"), "embedding")
    rows, made = vectors.cached_encode(texts, cache, "m", vectors.model_encoder(load, batch=1))
    assert [(r.i, r.embedding) for r in rows.orderBy("i").collect()] == [(1, [2.0, 1.0]), (2, [2.0, 1.0]), (3, [9.0, 9.0]), (4, [0.0, 1.0])]
    assert made.count() == 2
    zero = spark.createDataFrame([("a b a",), ("!!",), (None,)], "t string").select(vectors.hashed_vector(F.col("t")).alias("v"), vectors.pooled_vector(F.col("t")).alias("p")).collect()
    assert abs(sum(x * x for x in zero[0].v) - 1) < 1e-12 and all(not any(r.v) and not any(r.p) for r in zero[1:])
