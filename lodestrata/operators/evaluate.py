"""Quality measures of chunks and the data behind figures."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import adjacent, dot, pairwise_mean, sum_rows

LEAST_HEADING, SAMPLE, CUT, LEAST_STEPS = 4, 5, 60, 5
#: What a report says of a strategy's chunks of a document.
MEASURES = "n bigint, mean double, std double, least bigint, p10 double, median double, p90 double, most bigint, coherence double, similarity double, n_queries bigint, recall_1 double, recall_3 double, recall_5 double, sample array<struct<gt_sid:bigint,q:string,first_rel_rank:int>>"
#: Pairs of queries and chunks that `first_ranks` holds at a time.
PAIRS = 1 << 20


def size_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, population deviation, extremes and interpolated percentiles."""
    p = F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), p.alias("p"), F.max(value).alias("most"))
    return out.select(*by, "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "least", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p10", "median", "p90"))], "most")


def intra_coherence(sentences: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Mean over chunks of two sentences or more of their mean pairwise cosine; 0 for a group without any."""
    per = pairwise_mean(sentences, by, vector)
    return per.groupBy(*by[:-1]).agg(F.coalesce(F.avg(F.when(F.col("k") > 1, F.col("mean_cosine"))), F.lit(0.0)).alias("coherence"))


def inter_adjacent(chunks: DataFrame, group: str, order: str, vector: str) -> DataFrame:
    """Mean cosine of neighbouring chunks; 0 for a group of one chunk."""
    return adjacent(chunks, group, order, vector).groupBy(group).agg(F.coalesce(F.avg("cosine"), F.lit(0.0)).alias("similarity"))


def queries(chunks: DataFrame) -> DataFrame:
    """doc_id, query, gt: the heading of every structural chunk whose heading has four characters, and the chunk's id."""
    return chunks.where(F.length("heading") >= LEAST_HEADING).select("doc_id", F.col("heading").alias("query"), F.col("id").alias("gt"))


def covered(chunks: DataFrame) -> DataFrame:
    """Chunks with the structural ids that they cover: those they name, else their parent's, else their own."""
    told = [F.col("structural_ids")] if "structural_ids" in chunks.columns else []
    told += [F.when(F.col("parent_structural_id").isNotNull(), F.array("parent_structural_id"))] if "parent_structural_id" in chunks.columns else []
    kind = "array<bigint>"
    return chunks.withColumn("covers", F.coalesce(*[c.cast(kind) for c in told], F.array("id").cast(kind)))


def ranks(asked: DataFrame, chunks: DataFrame, group: str) -> DataFrame:
    """Rank of every chunk for every query of its group: by cosine, then id. asked: qid, qv; chunks: id, v. All pairs of a group are the result."""
    scored = asked.join(chunks, group).withColumn("sim", F.round(dot(F.col("qv"), F.col("v")), 9))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group, "qid").orderBy(F.desc("sim"), "id")))


def first_relevant(asked: DataFrame, chunks: DataFrame, group: str, relevant) -> DataFrame:
    """Every row of asked (qv, ...) with the first rank, from 1, of a chunk (id, v, ...) for which relevant(chunk) holds; null without one.

    The chunks of a group meet its queries as one row, so pairs are neither sorted nor shuffled: the rank of the best
    relevant chunk is one more than the number of chunks before it.
    """
    rest = [c for c in chunks.columns if c not in (group, "id", "v")]
    held = chunks.groupBy(group).agg(F.collect_list(F.struct("id", "v", *rest)).alias("__chunks"))
    place = lambda c: F.struct((-F.round(dot(F.col("qv"), c["v"]), 9)).alias("far"), c["id"].alias("id"))
    told = F.transform("__chunks", lambda c: F.struct(place(c).alias("at"), F.coalesce(relevant(c), F.lit(False)).alias("good")))
    rows = asked.join(held, group, "left").withColumn("__told", told)
    best = F.array_min(F.transform(F.filter("__told", lambda t: t["good"]), lambda t: t["at"]))
    rows = rows.withColumn("__best", best)
    before = F.size(F.filter("__told", lambda t: t["at"] < F.col("__best")))
    return rows.withColumn("first_rank", F.when(F.col("__best").isNotNull(), before + 1)).select(*asked.columns, "first_rank")


def recall(first: DataFrame, by: list[str], at: tuple[int, ...] = (1, 3, 5), sample: bool = False) -> DataFrame:
    """Queries of a group and the share of them whose first relevant chunk is among the first so many.

    With a sample, the first five queries too (gt_sid, q, first_rel_rank from 0), as an array.
    """
    hit = [F.bround(F.avg(F.coalesce((F.col("first_rank") <= k).cast("int"), F.lit(0))), 3).alias(f"recall_{k}") for k in at]
    if sample:
        row = F.struct(F.col("gt").alias("gt_sid"), F.substring("query", 1, CUT).alias("q"), (F.col("first_rank") - 1).alias("first_rel_rank"))
        hit.append(F.slice(F.array_sort(F.collect_list(row)), 1, SAMPLE).alias("sample"))
    return first.groupBy(*by).agg(F.count(F.lit(1)).alias("n_queries"), *hit)


def missing_strategy(asked: DataFrame, name: str) -> DataFrame:
    """A row for a strategy that has no chunks, for each document that has queries."""
    none = [F.lit(None).cast(k.split(" ", 1)[1]).alias(k.split(" ", 1)[0]) for k in MEASURES.split(", ")]
    return asked.select("doc_id").distinct().select("doc_id", F.lit(name).alias("strategy"), *none, F.lit(f"missing {name}").alias("_error"))


def strategy(name: str, chunks: DataFrame, sentences: DataFrame, asked: DataFrame) -> DataFrame:
    """One row for each document: sizes, coherence, similarity of neighbours, recall and a sample of queries of one strategy's chunks.

    chunks: doc_id, id, n_chars, v, covers; sentences: doc_id, id, vector; asked: doc_id, query, gt, qv. Recall is 0 and
    n_queries 0 where nothing is asked.
    """
    first = first_relevant(asked, chunks.select("doc_id", "id", "v", "covers"), "doc_id", lambda c: F.array_contains(c["covers"], F.col("gt").cast("long")))
    rows = size_stats(chunks.withColumn("n_chars", F.col("n_chars").cast("long")), ["doc_id"], "n_chars")
    rows = rows.join(intra_coherence(sentences, ["doc_id", "id"], "vector"), "doc_id", "left").join(inter_adjacent(chunks, "doc_id", "id", "v"), "doc_id")
    rows = rows.join(recall(first, ["doc_id"], sample=True), "doc_id", "left")
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("recall_1", "recall_3", "recall_5")]
    sample = F.col("sample").cast("array<struct<gt_sid:bigint,q:string,first_rel_rank:int>>").alias("sample")
    return rows.select(
        "doc_id", F.lit(name).alias("strategy"), "n", "mean", "std", "least", "p10", "median", "p90", "most",
        F.bround(F.coalesce("coherence", F.lit(0.0)), 4).alias("coherence"), F.bround("similarity", 4).alias("similarity"),
        F.coalesce("n_queries", F.lit(0)).alias("n_queries"), *zero, sample, F.lit(None).cast("string").alias("_error"))


def _rounded(values: np.ndarray) -> np.ndarray:
    """Values times 1e9, rounded as F.round rounds to nine places: by their shortest decimals, halves away from zero."""
    size = np.abs(values) * 1e9
    whole = np.floor(size + 0.5)
    for at in zip(*np.nonzero(np.abs(size - np.floor(size) - 0.5) < 1e-6), strict=True):
        whole[at] = float((Decimal(repr(float(abs(values[at])))) * 10**9).quantize(Decimal(1), ROUND_HALF_UP))
    return np.copysign(whole, values)


def first_ranks(qv: np.ndarray, v: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """first_relevant of one document as arrays: for each query (row of qv) the rank from 1 of the chunk (row of v, by id) at owner."""
    found, step = np.zeros(len(qv), np.int64), max(1, PAIRS // max(1, len(v)))
    for i in range(0, len(qv), step):
        q, own = qv[i : i + step], owner[i : i + step, None]
        near = np.zeros((len(q), len(v)))
        for d in range(v.shape[1]):  # in the order of dot()
            near += q[:, d, None] * v[None, :, d]
        near = _rounded(near)
        best = np.take_along_axis(near, own, axis=1)
        found[i : i + step] = 1 + ((near > best) | ((near == best) & (np.arange(len(v)) < own))).sum(axis=1)
    return found


def measured(n_chars: np.ndarray, v: np.ndarray, said: np.ndarray, n_said: np.ndarray, owner: np.ndarray, gt: list[int], query: list[str], qv: np.ndarray) -> dict:
    """MEASURES of one document's chunks, in the order of their ids, as `strategy` has them but not rounded.

    n_chars, v, n_said: characters, vector and number of sentences of each chunk; said: the vectors of all sentences, in
    order; gt, query, qv: queries by gt; owner: the place of the one chunk that covers each gt.
    """
    n, sizes = len(n_chars), np.sort(n_chars).astype(float)

    def percentile(p: float) -> float:
        at = (n - 1) * p
        low, high = int(np.floor(at)), int(np.ceil(at))
        return float(sizes[low] if sizes[low] == sizes[high] else (high - at) * sizes[low] + (at - low) * sizes[high])

    k = n_said[n_said > 1].astype(float)
    total = sum_rows(said, n_said)[n_said > 1]
    cosines = ((total * total).sum(axis=1) - k) / (k * (k - 1))
    rank = first_ranks(qv, v, owner)
    out = {"n": n, "mean": float(n_chars.sum() / n), "std": float(sizes.std()), "least": int(n_chars.min()), "p10": percentile(0.1), "median": percentile(0.5), "p90": percentile(0.9), "most": int(n_chars.max())}
    out |= {"coherence": float(cosines.mean()) if len(k) else 0.0, "similarity": float((v[1:] * v[:-1]).sum(axis=1).mean()) if n > 1 else 0.0, "n_queries": len(gt)}
    out |= {f"recall_{at}": float((rank <= at).sum() / len(gt)) if len(gt) else 0.0 for at in (1, 3, 5)}
    sample = [{"gt_sid": g, "q": q[:CUT], "first_rel_rank": int(r) - 1} for g, q, r in zip(gt[:SAMPLE], query[:SAMPLE], rank[:SAMPLE], strict=True)]
    return out | {"sample": sample or None}


def told(rows: DataFrame) -> DataFrame:
    """Rows of MEASURES rounded as `strategy` rounds them."""
    places = {"coherence": 4, "similarity": 4, "recall_1": 3, "recall_3": 3, "recall_5": 3}
    return rows.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p10", "median", "p90")} | {c: F.bround(c, n) for c, n in places.items()})


def trajectory(sentences: DataFrame, group: str, order: list[str], first: Column) -> DataFrame:
    """Sentences in order with their step and whether they open a chunk; groups of fewer than five have no trajectory."""
    step = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    return sentences.withColumns({"opens": first, "step": step, "__n": n}).where(F.col("__n") >= LEAST_STEPS).drop("__n")


def histogram(rows: DataFrame, by: str, value: str, bins: int = 20) -> DataFrame:
    """Counts in equal bins from the least to the largest value; the last bin is closed."""
    ends = rows.groupBy(by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    width = (F.col("high") - F.col("low")) / F.lit(float(bins))
    bin_ = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("low")) / width))).otherwise(F.lit(0)).cast("int")
    return rows.join(ends, by).groupBy(by, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def peaks(rows: DataFrame, group: str, order: str, vector: str, q: float = 0.9) -> DataFrame:
    """Places where the distance to the next row reaches its group's quantile."""
    near = adjacent(rows, group, order, vector).where("cosine is not null").withColumn("distance", F.round(1 - F.col("cosine"), 6))
    limit = near.groupBy(group).agg(F.percentile("distance", F.lit(q)).alias("threshold"))
    return near.join(limit, group).where("distance >= threshold - 1e-9D").select(group, order, "distance")
