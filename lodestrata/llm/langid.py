"""Language ID: nearest centroid over normalised TF-IDF byte n-gram vectors.

Texts are lower-cased, everything in ASCII that is no letter becomes a space, and the byte 2- and 3-grams that aren't
all spaces fall into `DIM` buckets by hash. A vector holds (1 + log count) * idf, normalised. The training sample has at
most `max_train` texts in all, shared evenly by the languages and chosen by hash of their id (the documented bound). Each
language's vectors are clustered into a few centroids by spherical k-means; a text gets the language of the centroid of
largest cosine. It is rejected when that cosine is under `reject` times the lowest but a thousandth of the training
cosines: text unlike anything learned. A rejected text still names the nearest language in lang_pred.

Null text and text without any letter: lang_pred `und`, score 0, rejected. Without training rows every text is `und`, but
only those are rejected. Of languages of equal cosine the first by name wins.
Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .wordbatch import chunks

DIM = 1 << 13
#: Texts whose vectors are made at once.
ROWS = 256
MAX_TRAIN = 1600
CLUSTERS = 4
REJECT = 0.3
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:65] = 32
_FOLD[91:97] = 32
_FOLD[123:128] = 32
_FOLD[65:91] += 32


def gram_counts(data: np.ndarray, offsets: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Counts of hashed byte n-grams, a row for each text."""
    n_docs, b = len(offsets) - 1, _FOLD[data]
    doc = np.repeat(np.arange(n_docs, dtype=np.int64), np.diff(offsets))
    keys = []
    for n in (2, 3):
        if len(b) < n:
            continue
        m = len(b) - n + 1
        gram = b[:m].copy()
        for j in range(1, n):
            gram = (gram << np.uint32(8)) | b[j : m + j]
        keep = (doc[:m] == doc[n - 1 :]) & (gram != (0x2020 if n == 2 else 0x202020))
        h = (gram[keep] + np.uint32(n << 24)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        keys.append(doc[:m][keep] * dim + ((h >> np.uint32(13)) % np.uint32(dim)).astype(np.int64))
    if not keys:
        return np.zeros((n_docs, dim), dtype=np.float32)
    return np.bincount(np.concatenate(keys), minlength=n_docs * dim).reshape(n_docs, dim).astype(np.float32)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.zeros_like(counts)
    np.log(counts, out=out, where=counts > 0)
    out += counts > 0
    out *= idf
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-12)


def folded(column: pa.Array) -> pa.Array:
    """Lower case; null stays null."""
    return pc.utf8_lower(column)


def _sample(batches):
    for batch in batches:
        for first, last, data, offsets in chunks(folded(batch.column(1)), 1 << 19, ROWS):
            counts = gram_counts(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array([np.flatnonzero(r).astype(np.uint16).tobytes() for r in counts], pa.binary()), pa.array([r[r > 0].astype(np.float32).tobytes() for r in counts], pa.binary())], names=["lang", "at", "n"])


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit vectors; starts from far apart rows, so it needs no random numbers."""
    centres = [x.mean(axis=0)]
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[np.argmin(np.max(x @ np.array(centres).T, axis=1))])
    c = np.array(centres)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        new = np.array([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


class Model:
    """idf, centroids (a row each), the language of each, and the cosine below which a text is rejected."""

    def __init__(self, idf: np.ndarray, centres: np.ndarray, langs: list[str], least: float):
        self.idf, self.centres, self.langs, self.least = idf, centres, langs, least


def fit(docs: DataFrame, *, max_train: int = MAX_TRAIN, clusters: int = CLUSTERS, reject: float = REJECT) -> Model | None:
    """Learns from rows of docs (doc_id, text, lang) with a language, whatever fold the caller has left out."""
    rows = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    each = max(4, max_train // len(sizes))
    # a hash of the id picks about twice the rows wanted of each language, then the smallest hashes are taken
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, (2 * each + 50) / n)))])
    u = (F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30)))
    some = rows.withColumn("u", u).where(F.col("u") < share[F.col("lang")])
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id"))).where(F.col("r") <= each)
    got = sorted((r[0], bytes(r[1]), bytes(r[2])) for r in some.select("lang", "text").mapInArrow(_sample, "lang string, at binary, n binary").collect())
    counts = np.zeros((len(got), DIM), dtype=np.float32)
    for row, (_, at, n) in zip(counts, got, strict=True):
        row[np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.float32)
    keep = counts.sum(axis=1) > 0
    counts, tags = counts[keep], np.array([g[0] for g in got])[keep]
    if not len(counts):
        return None
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.05)
    x = vectors(counts, idf)
    centres, langs = [], []
    for tag in sorted(set(tags.tolist())):
        own = k_means(x[tags == tag], clusters)
        centres.append(own)
        langs += [tag] * len(own)
    c = np.concatenate(centres)
    near = np.sort((x @ c.T).max(axis=1))
    return Model(idf, c, langs, reject * float(near[len(near) // 1000]))


def _verdicts(model: Model | None, text: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and whether it is rejected of each text."""
    known = np.array([t is not None and _LETTER.search(t) is not None for t in text.to_pylist()], dtype=bool)
    score, lang, rejected = np.zeros(len(known)), np.full(len(known), "und", dtype=object), ~known
    if model is not None and len(known):
        cosine = vectors(gram_counts(data, offsets), model.idf) @ model.centres.T
        best = cosine.argmax(axis=1)
        score = np.where(known, np.clip(np.round(cosine[np.arange(len(best)), best].astype(float), 6), 0, 1), 0.0)
        lang = np.where(known, np.array(model.langs, dtype=object)[best], "und")
        rejected = ~known | (score < model.least)
    return lang, score, rejected


def _predict(model: Model | None):
    """Adds lang_pred, score and rejected to a struct to keep; the text is a column of its own, or that of the struct."""

    def run(batches):
        for batch in batches:
            row = batch.column(0)
            text = batch.column(1) if batch.num_columns > 1 else row.field("text")
            for first, last, data, offsets in chunks(folded(text), 1 << 19, ROWS):
                lang, score, rejected = _verdicts(model, text.slice(first, last - first), data, offsets)
                yield pa.RecordBatch.from_arrays([row.slice(first, last - first), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(rejected)], names=["row", "lang_pred", "score", "rejected"])

    return run


def _model(docs: DataFrame, **options) -> Model | None:
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return fit(rows.where(~fold & F.col("doc_id").isNotNull()), **options)


def _judged(rows: DataFrame, model: Model | None) -> DataFrame:
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_predict(model), f"row {kind}, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of docs (doc_id, text, lang); documents whose crc32(doc_id) mod 4 is 2 are never learned from."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    kept = F.struct(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("held_out"))
    rows = docs.select(kept.alias("row"), F.col("text").cast("string").alias("text"))
    return _judged(rows, _model(docs, **options)).select("row.*", "lang_pred", "score", "rejected")


def recognised(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, whose text is not rejected: each row carries its own verdict."""
    # texts travel once, within their rows
    kept = F.struct(*[F.col(c).cast("string").alias(c) if c == "text" else F.col(c) for c in docs.columns])
    return _judged(docs.select(kept.alias("row")), _model(docs, **options)).where("not rejected").select("row.*")
