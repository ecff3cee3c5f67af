"""Substring dedup: Rabin-Karp hashes of every window of `k` words, counted in Spark.

1. Each task hashes the windows of a run of texts. A hash met twice there is known to repeat: its places go straight to
   the documents' replies, and the hash itself is sent once. All other hashes are sent in order, by document, to one of
   `buckets` buckets that a second, independent hash names; a row holds all that a run has for a bucket, so rows are few
   and a window however common comes once from each run.
2. Each bucket sorts its hashes; those that stand there twice, or came as known, repeat. A document is told which of its
   hashes of that bucket repeat, by their order alone: replies are packed by group of documents.
3. Documents meet their replies by group, hash their windows again, mark the words of repeated windows and so merge them
   into maximal intervals, and keep the rest.

A hash has 64 bits within a bucket, and buckets grow in number with the text (`chars_per_bucket`): of n windows about
n * n / 2**65 / buckets pairs are taken for one another, 2e-4 in all of 30 GB of text. Documents are told apart by a
64-bit hash of id and text, or by another one where two share the first. What a task holds is a bucket or a group of documents.

Null and empty texts have no words. Texts shorter than a window lose nothing. Repeated rows are separate documents: their
windows repeat. Windows are judged on the input. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import partitions
from .wordbatch import U64, Words, chunks, repeated

WINDOW = 35
CHARS_PER_BUCKET = 16_000_000
#: Bytes of text that make a run.
RUN_BYTES = 3 << 20
#: In place of a bucket: what follows are windows of the document, counted from its first.
DIRECT = 0xFFFFFFFF
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_REPLY = "target int, keys binary, buckets binary, n binary, places binary"


def _hashed(words: Words, k: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, hash and bucket of each window."""
    at, h = words.windows(words.hashes(0), k, 0)
    _, other = words.windows(words.hashes(1), k, 1)
    return at, h, ((other >> U64(20)) % U64(buckets)).astype(np.int64)


def _replies(keys: np.ndarray, bucket: np.ndarray, places: np.ndarray, groups: int) -> list[tuple]:
    """Rows of _REPLY for entries (document key, bucket, place) that are sorted by document and bucket."""
    if not len(keys):
        return []
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (bucket[1:] != bucket[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(keys)))
    key, target = keys[first], (keys[first] % U64(groups)).astype(np.int64)
    order = np.argsort(target, kind="stable")
    # the places of the entries in that order
    begin = np.concatenate(([0], np.cumsum(n[order])))
    flat = places[np.repeat(first[order] - begin[:-1], n[order]) + np.arange(len(places))].astype("<u4")
    edges = np.searchsorted(target[order], np.arange(groups + 1))
    rows = []
    for t in np.flatnonzero(np.diff(edges)):
        a, b = edges[t], edges[t + 1]
        some = order[a:b]
        rows.append((int(t), key[some].tobytes(), bucket[first[some]].astype("<u4").tobytes(), n[some].astype("<u4").tobytes(), flat[begin[a] : begin[b]].tobytes()))
    return rows


def _reply_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["target", "keys", "buckets", "n", "places"])


_SENT = "bucket int, target int, keys binary, n binary, hashes binary, known binary, buckets binary, places binary"


def _send(k: int, buckets: int, groups: int):
    def run(batches):
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            for first, last, data, offsets in chunks(batch.column(1), RUN_BYTES):
                words = Words(data, offsets)
                at, h, bucket = _hashed(words, k, buckets)
                if not len(at):
                    continue
                doc = words.doc[at]
                keys = key[first:last]
                order = np.lexsort((h, bucket))
                same = np.zeros(len(at) + 1, dtype=bool)
                same[1:-1] = (h[order][1:] == h[order][:-1]) & (bucket[order][1:] == bucket[order][:-1])
                twice = np.zeros(len(at), dtype=bool)
                twice[order] = same[1:] | same[:-1]
                heads = order[~same[:-1] & same[1:]]  # one of each hash that is known to repeat
                # the places of known repeats go with the row of some bucket and pass through it
                direct = np.flatnonzero(twice)
                place = at[direct] - words.word_at[doc[direct]]
                told = _replies(keys[doc[direct]], np.full(len(direct), DIRECT), place, groups)
                rest = np.flatnonzero(~twice)
                rest = rest[np.argsort(bucket[rest], kind="stable")]  # by bucket, then document, then place
                edges = np.searchsorted(bucket[rest], np.arange(buckets + 1))
                marks = np.searchsorted(bucket[heads], np.arange(buckets + 1))
                rows = []
                for b in range(buckets):
                    own, known = rest[edges[b] : edges[b + 1]], heads[marks[b] : marks[b + 1]]
                    if len(own) or len(known):
                        docs, n = np.unique(doc[own], return_counts=True)
                        rows.append((b, None, keys[docs].tobytes(), n.astype("<u4").tobytes(), h[own].tobytes(), h[known].tobytes(), None, None))
                for t, ks, bs, n, places in told:
                    rows.append((t % buckets, t, ks, n, None, None, bs, places))
                kinds = (pa.int32(), pa.int32(), *(pa.binary(),) * 6)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "target", "keys", "n", "hashes", "known", "buckets", "places"])

    return run


def _count(groups: int):
    """Replies of the buckets that a task has."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["target"] is not None:
                    yield _reply_batch([(row["target"], row["keys"], row["buckets"], row["n"], row["places"])])
                else:
                    held.setdefault(row["bucket"], []).append((row["keys"], row["n"], row["hashes"], row["known"]))
        for b in sorted(held):
            rows = held.pop(b)
            n = [np.frombuffer(r[1], "<u4").astype(np.int64) for r in rows]
            counts = np.concatenate(n)
            keys = np.repeat(np.concatenate([np.frombuffer(r[0], U64) for r in rows]), counts)
            place = np.arange(len(keys)) - np.repeat(np.cumsum(counts) - counts, counts)
            h = np.frombuffer(b"".join(r[2] for r in rows), U64)
            known = np.unique(np.frombuffer(b"".join(r[3] for r in rows), U64))
            del rows
            again = repeated(h)
            if len(known):
                near = np.minimum(np.searchsorted(known, h), len(known) - 1)
                again |= known[near] == h
            hit = np.flatnonzero(again)
            hit = hit[np.argsort(keys[hit], kind="stable")]
            yield _reply_batch(_replies(keys[hit], np.full(len(hit), b), place[hit], groups))

    return run


def _packed(batches):
    """Texts travel compressed."""
    writer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = batch.column(3).cast(pa.large_binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([writer.compress(t or b"") for t in texts], pa.binary())], names=["target", "doc_id", "key", "text"])


def _keep(k: int, buckets: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        reader = zstandard.ZstdDecompressor()
        texts = [reader.decompress(t) for t in docs["text"].to_pylist()]
        keys = docs["key"].to_numpy().astype(np.int64).view(U64) if len(texts) else np.zeros(0, U64)
        columns = [[r or b"" for r in replies[c].to_pylist()] for c in ("keys", "buckets", "n", "places")]
        told_key = np.frombuffer(b"".join(columns[0]), U64)
        told_bucket = np.frombuffer(b"".join(columns[1]), "<u4").astype(np.int64)
        told_n = np.frombuffer(b"".join(columns[2]), "<u4").astype(np.int64)
        places = np.frombuffer(b"".join(columns[3]), "<u4").astype(np.int64)
        begin = np.cumsum(told_n) - told_n
        by_key = np.argsort(told_key, kind="stable")
        sorted_key = told_key[by_key]
        # rows that stand twice: all their windows repeat, and replies to one don't fit the other
        twin = repeated(keys)
        n_words, n_removed, digests = [], [], []
        for first, last, data, offsets in chunks(pa.array(texts, pa.large_binary())):
            words = Words(data, offsets)
            own, twins = keys[first:last], twin[first:last]
            low, high = np.searchsorted(sorted_key, own), np.searchsorted(sorted_key, own, side="right")
            high = np.where(twins, low, high)
            marked = np.zeros(len(words.start), dtype=bool)
            if (high > low).any() or twins.any():
                at, _, bucket = _hashed(words, k, buckets)
                doc = words.doc[at]
                # a document's windows by bucket, in order: where replies point to
                name = doc * buckets + bucket
                order = np.argsort(name, kind="stable")
                # a document has no reply to a hash that its run knew to repeat, so its places skip those
                hit = twins[doc]
                window_at = np.searchsorted(doc, np.arange(words.n_docs + 1))
                known = np.zeros(len(at), dtype=bool)
                rows = np.concatenate([by_key[:0], *(by_key[a:b] for a, b in zip(low, high, strict=True))])
                owner = np.repeat(np.arange(words.n_docs), high - low)
                direct = told_bucket[rows] == DIRECT
                for r, d in zip(rows[direct], owner[direct], strict=True):
                    known[window_at[d] + places[begin[r] : begin[r] + told_n[r]]] = True
                hit |= known
                left = order[~known[order]]
                names = name[left]
                starts = np.searchsorted(names, owner[~direct] * buckets + told_bucket[rows[~direct]])
                sizes = told_n[rows[~direct]]
                flat = np.repeat(begin[rows[~direct]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                hit[left[np.repeat(starts, sizes) + places[flat]]] = True
                marked = words.covered(at[hit], k)
            removed = words.per_doc(marked)
            n_words += words.counts.tolist()
            n_removed += removed.tolist()
            for i in range(words.n_docs):
                parts = texts[first + i].split()
                if removed[i]:
                    parts = compress(parts, ~marked[words.word_at[i] : words.word_at[i + 1]])
                digests.append(hashlib.sha256(b" ".join(parts)).hexdigest())
        return pa.table([docs["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def substring_dedup(docs: DataFrame, *, k: int = WINDOW, chars_per_bucket: int = CHARS_PER_BUCKET) -> DataFrame:
    """One row for each row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    buckets = groups = max(8, size // chars_per_bucket + 1)
    # documents that differ and share a key: n * n / 2**65 of n, none as a rule; they go by the second hash
    keyed = rows.withColumns({"key": F.xxhash64("doc_id", "text"), "other": F.xxhash64(F.lit(1), "text", "doc_id")})
    clash = keyed.groupBy("key").agg(F.min("other").alias("a"), F.max("other").alias("b")).where("a <> b").select("key").collect()
    if clash:
        keyed = keyed.withColumn("key", F.when(F.col("key").isin([r[0] for r in clash]), F.col("other")).otherwise(F.col("key")))
    keyed = keyed.drop("other")
    parts = max(partitions(rows), buckets)
    sent = keyed.select("key", "text").mapInArrow(_send(k, buckets, groups), _SENT)
    replies = sent.repartition(parts, "bucket").mapInArrow(_count(groups), _REPLY)
    # the same remainder as for unsigned 64-bit keys
    target = ((F.pmod(F.shiftrightunsigned("key", 1), F.lit(groups)) * 2 + F.col("key").bitwiseAND(F.lit(1))) % groups).cast("int")
    texts = keyed.select(target.alias("target"), "doc_id", "key", "text").mapInArrow(_packed, "target int, doc_id long, key long, text binary")
    return texts.groupBy("target").cogroup(replies.groupBy("target")).applyInArrow(_keep(k, buckets), RESULT)
