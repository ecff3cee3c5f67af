"""The report on the whole way in one pass, against the report on chunks that are given."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata import catalogue
from lodestrata.operators import elements as E
from lodestrata.operators import evaluate, segment, vectors
from lodestrata.plans import coarse

NAMES = ("structural", "semantic_coarse", "none")


def _documents():
    rng, rows = random.Random(5), []
    words = "alpha beta Gamma delta. Epsilon zeta! eta? 12 Theta 'Iota (kappa) É lambda.\n\nmu İ K".split(" ")
    for doc in range(12):
        for i in range(rng.randrange(1, 90)):
            kind = rng.choice([E.HEADER, E.TEXT, E.TEXT, E.ITEM, E.TABLE])
            text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))
            if kind == E.HEADER and rng.random() < 0.7:
                text = f"{rng.randrange(1, 4)}.{rng.randrange(1, 4)} {text[:9]}" if rng.random() < 0.5 else rng.choice(["1 Same", "abc", ""])
            rows.append((doc, i, i // 9, kind, rng.choice([text, f"  {text} ", None if kind == E.TABLE else text])))
    rows += [(20, 0, 1, E.TABLE, ""), (21, 0, 1, E.HEADER, "Alone"), (22, 0, 1, E.HEADER, "4 Long"), (22, 1, 1, E.TEXT, "Begin here. " * 900 + "\n2.1 Missed one. Body follows.\n3 Missed two. More"), (None, 0, 1, E.TEXT, "No id. At all.")]
    return rows


def test_whole_report(spark):
    rows = spark.createDataFrame(_documents(), "doc_id long, idx int, page int, type string, text string").repartition(3)
    fine = coarse.structural(rows)
    found = segment.coarse_chunks(segment.solved(coarse.units(fine)))
    want = coarse.report(fine.where("doc_id IS NOT NULL"), {NAMES[0]: fine.where("doc_id IS NOT NULL"), NAMES[1]: found.where("doc_id IS NOT NULL"), NAMES[2]: None})
    got = coarse.whole_report(rows, NAMES)
    assert got.dtypes == want.dtypes
    told, known = ({(r.doc_id, r.strategy): r.asDict(True) for r in df.collect() if r.doc_id is not None} for df in (got, want))
    assert told.keys() == known.keys() and (20, NAMES[1]) not in told and (20, NAMES[0]) in told and (22, NAMES[1]) in told
    for key, row in known.items():
        assert {k: pytest.approx(v, abs=1e-6) if isinstance(v, float) else v for k, v in row.items()} == told[key], key


def test_plan(spark):
    """Elements are made for the chunks and for the outline only, and one step is in Python."""
    plan = catalogue.queries()["coarse_report"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 4 and plan.count("Exchange") <= 10 and plan.count("MapInArrow") == 1 and "EvalPython" not in plan


def test_arrays(spark):
    """The array forms of the vectors give the very numbers of the expressions; ranks hold for more pairs than a block."""
    texts = ["a b a", "", "!!", "One two. Two three! Four five six?\n\nseven", "İstanbul Kelvin"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(vectors.hashed_vector(F.col("t")).alias("v")).collect()
    assert [r.v for r in rows] == vectors.hashed_array(texts).tolist()
    rng = np.random.default_rng(2)
    v = vectors.unit_rows(rng.integers(0, 2, (1500, 4)).astype(float))
    qv, owner = vectors.unit_rows(rng.integers(0, 3, (900, 4)).astype(float)), rng.integers(0, 1500, 900)
    near = np.round(qv @ v.T, 9)
    want = [1 + sum((-x, j) < (-near[i][o], o) for j, x in enumerate(near[i])) for i, o in enumerate(owner.tolist())]
    assert len(qv) * len(v) > evaluate.PAIRS and evaluate.first_ranks(qv, v, owner).tolist() == want
    assert evaluate._rounded(np.array([2.0**-10, -(2.0**-10), 0.1, 0.0])).tolist() == [976563.0, -976563.0, 1e8, 0.0]
    assert vectors.sum_rows(np.eye(3), np.array([2, 0, 1])).tolist() == [[1, 1, 0], [0, 0, 0], [0, 0, 1]]
