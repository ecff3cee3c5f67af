"""Vectors as array<double>: keys, encoding with a cache, hashed embedding, pooling, cosine measures."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import md5
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T

#: Texts that a model gets at once.
BATCH = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector over its length; one without length stays."""
    return T.let(F.sqrt(dot(v, v)), lambda norm: F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x)))


def cache_key(model: str, text: Column) -> Column:
    return F.sha1(F.concat(F.lit(model), F.lit("\x00"), text))


def missing(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct keys that the cache lacks."""
    return texts.select("key").distinct().join(cache.select("key"), "key", "left_anti")


def model_encoder(load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = BATCH) -> Callable[[DataFrame], DataFrame]:
    """An encoder of rows (key, text) to (key, embedding) by a model that load() gives; each task loads it once."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in parts:
            known = texts.fillna("").tolist()
            found = [encode(known[i : i + batch]) for i in range(0, len(known), batch)]
            yield pd.Series([np.asarray(v, dtype=np.float32) for part in found for v in part], dtype=object)

    return lambda rows: rows.select("key", run("text").alias("embedding"))


def hashed_encoder(dim: int = 32) -> Callable[[DataFrame], DataFrame]:
    """The encoder that needs no model: hashed_vector of rows (key, text)."""
    return lambda rows: rows.select("key", hashed_vector(F.col("text"), dim).cast("array<float>").alias("embedding"))


def cached_encode(texts: DataFrame, cache: DataFrame, model: str, encode: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """texts with their embedding (of the column text, each row as often as it stands there), and what the cache (key, embedding) lacked.

    Only distinct texts that the cache lacks are encoded. The second result is meant for files.append_cache; persist or
    write it before use, or it is encoded for each of the two.
    """
    keyed = texts.withColumn("key", cache_key(model, F.coalesce("text", F.lit(""))))
    new = keyed.groupBy("key").agg(F.first(F.coalesce("text", F.lit(""))).alias("text")).join(cache.select("key"), "key", "left_anti")
    made = encode(new).select("key", "embedding")
    return keyed.join(cache.select("key", "embedding").unionByName(made), "key", "left").drop("key"), made


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")


def hashed_vector(text: Column, dim: int = 32) -> Column:
    """Unit vector of the counts of a text's words by md5 bucket; zeros for a text without words."""
    buckets = F.transform(_words(text), lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dim).cast("int"))
    counts = lambda b: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(b, lambda x: x == i)).cast("double"))
    return F.coalesce(T.let(buckets, lambda b: T.let(counts(b), unit)), zeros(dim))


@lru_cache(1 << 16)
def _bucket(word: str) -> int:
    return int(md5(word.encode()).hexdigest()[:8], 16)


def hashed_array(texts: list[str], dim: int = 32) -> np.ndarray:
    """hashed_vector of each text, to the bit, for code that works on whole documents: one row for each."""
    words = [re.findall("[a-z0-9]+", t.lower()) for t in texts]
    place = np.repeat(np.arange(len(texts)), np.fromiter(map(len, words), np.int64, len(words)))
    buckets = np.fromiter(map(_bucket, chain.from_iterable(words)), np.int64, len(place)) % dim
    return unit_rows(np.bincount(place * dim + buckets, minlength=len(texts) * dim).reshape(-1, dim).astype(float))


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """unit() of each row, to the bit."""
    norm = np.sqrt(np.cumsum(rows * rows, axis=1)[:, -1:])
    return rows / np.where(norm > 0, norm, 1.0)


def sum_rows(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of so many rows each, one after the other, added in order as a fold adds them."""
    out, first = np.zeros((len(counts), rows.shape[1])), np.cumsum(counts) - counts
    longest = np.argsort(-counts, kind="stable")
    for i in range(int(counts.max(initial=0))):
        longest = longest[counts[longest] > i]
        out[longest] += rows[first[longest] + i]
    return out


def pooled_vector(text: Column, dim: int = 32) -> Column:
    """Unit vector of the mean of the hashed vectors of a text's sentences; zeros for a text without words."""
    add = lambda total, s: F.zip_with(total, hashed_vector(s, dim), lambda x, y: x + y)
    return T.let(F.aggregate(F.coalesce(T.sentences(text), F.array().cast("array<string>")), zeros(dim), add), unit)


def vector_sum(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Element-wise sums by group: sums combine before the shuffle, so a group may be of any size."""
    parts = rows.select(*by, F.posexplode(vector).alias("d", "x")).groupBy(*by, "d").agg(F.sum(F.col("x").cast("double")).alias("s"))
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda e: e["s"]).alias("total"))


def mean_pool(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Unit vector of the mean of a group; the mean's length doesn't matter."""
    return vector_sum(rows, by, vector).select(*by, unit(F.col("total")).alias("centroid"))


def pairwise_mean(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Mean cosine of all pairs of a group's unit vectors from the length of their sum; 1 for one vector."""
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("k"))
    k = F.col("k").cast("double")
    mean = F.when(F.col("k") > 1, (dot(F.col("total"), F.col("total")) - k) / (k * (k - 1))).otherwise(F.lit(1.0))
    return n.join(vector_sum(rows, by, vector), by, "left").select(*by, "k", mean.alias("mean_cosine"))


def adjacent(rows: DataFrame, group: str, order: str, vector: str) -> DataFrame:
    """Cosine of each row with the next of its group; null for a group's last row."""
    after = F.lead(vector).over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("after", after).select(group, order, F.when(F.col("after").isNotNull(), dot(F.col(vector), F.col("after"))).alias("cosine"))


def similarity_matrix(rows: DataFrame, group: str, key: str, vector: str, heading: str | None = None) -> DataFrame:
    """Cosines of all pairs within a group, clipped to [0, 1]; the matrix itself is the result. With a heading, rows have labels."""
    label = lambda c: [F.concat(F.lit("#"), F.format_string("%02d", F.col(key)), F.lit(" "), F.substring(F.coalesce(heading, F.lit("")), 1, 30)).alias(c)] if heading else []
    a = rows.select(group, F.col(key).alias("i"), F.col(vector).alias("a"), *label("label_i"))
    b = rows.select(group, F.col(key).alias("j"), F.col(vector).alias("b"), *label("label_j"))
    labels = ["label_i", "label_j"] if heading else []
    return a.join(b, group).select(group, "i", "j", *labels, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(F.col("a"), F.col("b")))).alias("cosine"))
