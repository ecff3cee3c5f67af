"""Every unit asks in the retrieval queries, against brute force."""

import numpy as np
import pyarrow.parquet as pq

from lodestrata import catalogue

DIR = "/root/testdata/sf0.001"


def test_every_unit_asks(spark):
    known = {r["doc_id"] for r in pq.read_table(f"{DIR}/documents.parquet", columns=["doc_id"]).to_pylist()}
    docs = {}
    for r in pq.read_table(f"{DIR}/embeddings.parquet").to_pylist():
        if r["vec_id"] in known:
            docs.setdefault(r["vec_id"] // 50, []).append((r["vec_id"], np.array(r["embedding"], float)))
    ranks, first = set(), {}
    for doc, units in docs.items():
        for q, v in units:
            order = sorted((-round(float(v @ w), 9), k) for k, w in units)
            ranks |= {(doc, q, k, i) for i, (_, k) in enumerate(order, 1)}
            first[doc, q] = next((i for i, (_, k) in enumerate(order, 1) if k != q and k % 50 // 9 == q % 50 // 9), None)
    found = catalogue.queries()["retrieval_rank"](spark, DIR).collect()
    assert len(found) == len(ranks) and {(r.doc_id, r.qid, r.id, r.rank) for r in found} == ranks
    assert {(r.doc_id, r.qid): r.first_rank for r in catalogue.queries()["first_relevant"](spark, DIR).collect()} == first
    for r in catalogue.queries()["recall_at_k"](spark, DIR).collect():
        own = [f for (doc, _), f in first.items() if doc == r.doc_id]
        assert r.n_queries == len(own) == len(docs[r.doc_id])
        assert all(abs(r[f"recall_{k}"] - sum(f is not None and f <= k for f in own) / len(own)) <= 0.0005 + 1e-9 for k in (1, 3, 5))
