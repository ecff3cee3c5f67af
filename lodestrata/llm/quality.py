"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and neighbouring pairs of words fall into `buckets` buckets by hash. The raw multinomial counts every document;
the target multinomial counts every other trusted one, in the order of a hash of their ids. A document's score is the mean over its n-grams of log p_target - log p_raw, the target smoothed
by `buckets` draws from raw. The threshold is a low quantile of the scores of all trusted documents that the target
didn't count, so a document is kept unless it is less like the trusted text than nearly all unseen trusted text; every
document is compared with it, so reruns agree.

Null and empty texts have no words: all counts 0, score 0, base_failed. Without trusted documents, the threshold is
minus infinity. Repeated rows give repeated results; other columns of the input are ignored. Trusted ids are sent to
every executor as long as they are `broadcast` at most; more of them meet the texts by a shuffle, with the same results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .wordbatch import U64, Words, chunks, mix, repeated, span_hash, BASES

BUCKETS = 1 << 14
#: Trusted ids that are sent to executors at most.
BROADCAST = 1_000_000
QUANTILE = 0.001
#: The threshold is this far below the quantile; it is a mean of log ratios.
MARGIN = 0.02
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def ngrams(words: Words, hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every word and of every pair of neighbours."""
    one = (hashes >> U64(20)) % U64(buckets)
    pair = np.flatnonzero(words.doc[:-1] == words.doc[1:]) if len(hashes) else np.zeros(0, np.int64)
    two = (mix(hashes[pair] * U64(3) + hashes[pair + 1]) >> U64(20)) % U64(buckets) if len(pair) else np.zeros(0, U64)
    return np.concatenate((one, two)).astype(np.int64), np.concatenate((words.doc, words.doc[pair]))


def base_counts(words: Words, sums: np.ndarray, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the base rules by text."""
    data, offsets = words.data, words.offsets
    by_text = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])
    # a code point is counted at its first byte
    chars = by_text(words.solid & ((data & 0xC0) != 0x80))
    symbols = by_text(_SYMBOL[data])
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    end = np.sort(np.concatenate((offsets[1:], breaks)), kind="stable")
    text = np.searchsorted(offsets, start, side="right") - 1
    # a break that ends its text opens a line that belongs to that text, and empty lines have no word: both drop out
    full = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, text = start[full], end[full], text[full]
    keys = span_hash(sums, start, end, BASES[0][0]) + mix(text.astype(U64) + U64(1))
    lines = np.bincount(text, minlength=words.n_docs)
    order = np.argsort(keys)
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    distinct = np.bincount(text[order][new], minlength=words.n_docs)
    at, windows = words.windows(hashes, 8)
    twice = at[repeated(windows + mix(words.doc[at].astype(U64) + U64(1)))]
    return {"n_words": words.counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines - distinct, "n_repeat_words": words.per_doc(words.covered(twice, 8))}


def _count(buckets: int):
    """n-gram counts of a task's texts (doc_id, text, whether the target counts it), raw and target: one row for each bucket met."""

    def run(batches):
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            trusted = batch.column(2).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in chunks(batch.column(1)):
                words = Words(data, offsets)
                bucket, doc = ngrams(words, words.hashes(), buckets)
                raw += np.bincount(bucket, minlength=buckets)
                good += np.bincount(bucket[trusted[first:last][doc]], minlength=buckets)
        met = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(raw[met]), pa.array(good[met])], names=["bucket", "raw", "good"])

    return run


def _score(ratio: np.ndarray, threshold: float):
    def run(batches):
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(1)):
                words = Words(data, offsets)
                sums = words.byte_sums()
                hashes = words.hashes(sums=sums)
                out = base_counts(words, sums, hashes)
                bucket, doc = ngrams(words, hashes, len(ratio))
                n = np.bincount(doc, minlength=words.n_docs)
                score = np.round(np.bincount(doc, weights=ratio[bucket], minlength=words.n_docs) / np.maximum(n, 1), 9)
                failed = (out["n_words"] < 20) | (100 * out["n_repeat_words"] > 30 * out["n_words"])
                columns = [batch.column(0).slice(first, last - first), *(pa.array(v.astype(np.int64)) for v in out.values()), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *out, "base_failed", "score", "kept"])

    return run


def halves(trusted: DataFrame) -> DataFrame:
    """doc_id and held of each trusted id: in the order of their hash the first is counted, the second held out, and so on."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    # the place in that order is the place within a slice of the hashes, after all the ids of the slices before
    ids = ids.withColumn("h", F.xxhash64("doc_id")).withColumn("slice", F.shiftright("h", 52))
    before = F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    slices = ids.groupBy("slice").agg(F.count(F.lit(1)).alias("n")).select("slice", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("slice").orderBy("h", "doc_id")) - 1
    return ids.join(F.broadcast(slices), "slice").select("doc_id", (place % 2 == 1).alias("held"))


def _quantile(scores: DataFrame, quantile: float) -> float | None:
    """The quantile of all scores, interpolated; null without any. The scores are kept on disk, only the lowest are sorted."""
    scores = scores.persist(StorageLevel.DISK_ONLY)
    n = scores.count()
    at = (n - 1) * quantile
    near = [r[0] for r in scores.orderBy("score").offset(int(at)).limit(2).collect()] if n else []
    scores.unpersist()
    return float(np.quantile(near, (at - int(at)) * (len(near) - 1))) if near else None


def quality(docs: DataFrame, trusted: DataFrame, *, buckets: int = BUCKETS, quantile: float = QUANTILE, margin: float = MARGIN, broadcast: int = BROADCAST) -> DataFrame:
    """One row for each row of docs (doc_id, text); trusted: the ids of documents of the target."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = halves(trusted)
    # half of the ids are counted, half set the threshold
    small = F.broadcast if trusted.select("doc_id").distinct().count() <= broadcast else lambda df: df
    told = texts.join(small(ids.where("not held")), "doc_id", "left").select("doc_id", "text", F.col("held").isNotNull().alias("counted"))
    counts = told.mapInArrow(_count(buckets), "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw"), F.sum("good")).collect()
    raw, good = np.zeros(buckets), np.zeros(buckets)
    for b, r, g in counts:
        raw[b], good[b] = r, g
    raw = (raw + 0.5) / (raw + 0.5).sum()
    ratio = np.log((good + buckets * raw) / (good.sum() + buckets)) - np.log(raw)
    held = texts.join(small(ids.where("held").select("doc_id")), "doc_id", "left_semi")
    low = _quantile(held.mapInArrow(_score(ratio, -np.inf), RESULT).where("not base_failed").select("score"), quantile)
    return texts.mapInArrow(_score(ratio, -np.inf if low is None else low - margin), RESULT)
