"""The stages of the pipeline and the whole of it against brute force: null and repeated ids, repeated rows, null texts, ties, empty tables."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from lodestrata.llm import langid, mixing, ngram_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei".split()


def _rows():
    rng = random.Random(3)
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, say(EN if i % 2 else DE, 60 + i), "en" if i % 2 else "de", f"s{i % 3}", i) for i in range(60)]
    base = say(EN, 120)
    near = base.split()
    near[50] = "elsewhere"
    rows += [(101, base, "en", "s0", 1), (100, " ".join(near), "en", "s1", 1), (102, base + " ", "en", "s1", 2), (None, base.replace(" ", "  "), "en", "s1", 3)]
    rows += [(7, "a text of its own " + say(EN, 40), "en", "s2", 1)] * 3 + [(None, "no id " + say(EN, 40), "en", "s0", 1)] * 2 + [(None, "none either " + say(DE, 40), "de", None, 2)]
    return [*rows, (200, None, None, None, 0), (201, "", "en", "s0", 0), (None, None, None, None, None), (202, "1234 5678", "en", "s0", 9)]


ROWS = _rows()


def _counter(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumn("clash", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))


def test_language_stage(spark, docs):
    found = corpus_pipeline.language_stage(spark, docs, "")
    assert found.columns == corpus_pipeline.COLUMNS
    want = Counter((i, t) for i, t, *_ in ROWS if t and any(c.isalpha() for c in t))
    got = _counter(found)
    judged = Counter((r.doc_id, r.rejected) for r in langid.identify(docs).collect())
    assert not got - want
    assert Counter(i for i, _ in got.elements()) == Counter({i: n for (i, r), n in judged.items() if not r})
    assert got[None, ROWS[-6][1]] == 2


def test_near_stage(spark, docs):
    rows = sorted({(i, t or "") for i, t, *_ in ROWS}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := re.findall(r"[^\x20\x09-\x0D]+", t.lower())) else set() for _, t in rows]
    up = list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[max(find(a), find(b))] = min(find(a), find(b))
    found = corpus_pipeline.near_stage(spark, docs, "")
    assert found.columns == corpus_pipeline.COLUMNS
    # null and empty texts are rows of their own, as they differ
    want = Counter((i, t) for a, (i, t) in enumerate(rows) if find(a) == a and t)
    got = _counter(found)
    assert Counter({k: n for k, n in got.items() if k[1]}) == want
    assert {k for k in got if not k[1]} == {(200, None), (201, ""), (None, None)}
    assert corpus_pipeline.near_stage(spark, docs.limit(0), "").count() == 0


def test_digests_that_clash(docs, monkeypatch):
    """Sets of one first digest are told apart by the second."""
    want = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect())
    h = np.array([3, 9, 9, 12], dtype=np.uint64)
    assert len(set(ngram_join.second_digest(h, np.array([1, 1, 1, 1])).tolist())) == 3
    assert ngram_join.told_apart(np.array([5, 6, 5]), np.array([1, 2, 3]), np.array([5])).tolist() == [1, 6, 3]
    assert want[100, 116, 100] == 1


def test_whole(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    stages = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        stage(spark, stages, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        stages = spark.read.parquet(f"{tmp_path}/{name}")
    kept = _counter(stages)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    # one row for each text, and of the near copies the one of least id
    assert max(Counter(norm(t) for _, t in kept.elements()).values()) == 1
    assert kept[100, ROWS[61][1]] == 1 and not any(i in (101, 102) for i, _ in kept) and sum(n for (i, _), n in kept.items() if i is None) == 2
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in mixing.copies(stages).collect():
        ids = known.encode_ordinary(r.text)
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and got
