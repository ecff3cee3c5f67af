"""Exact segmentation of a document's units into coarse chunks.

Dynamic programming is sequential within a document and parallel across them: the units of a document meet in one row and
go through a scalar Arrow UDF, which sees their vectors, lengths and section numbers alone. Its time is quadratic in the
units of one document, its memory linear. The same row then gives the chunks, so units are shuffled once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

ALPHA, BETA = 1.0, 0.3
#: Numbers of segments' vectors that `solve` holds at a time, but for one unit's.
CELLS = 1 << 21


def target_k(total: Column) -> Column:
    """Segments aimed at, 12 to 30; halves round to even."""
    return F.greatest(F.lit(12), F.least(F.lit(30), F.bround(total / F.lit(2000.0), 0).cast("int")))


def crossings(units: DataFrame) -> DataFrame:
    """Flags units whose major section differs from the one before, both being known."""
    before = F.lag("major").over(Window.partitionBy("doc_id").orderBy("k"))
    return units.withColumn("crossing", F.coalesce((F.col("major") != before), F.lit(False)).cast("int"))


def solve(vectors: np.ndarray, chars: np.ndarray, crossing: np.ndarray, target: float, alpha: float = ALPHA, beta: float = BETA) -> tuple[list[int], float, list[float]]:
    """First unit of each segment, the total cost and each segment's mean cosine; of equal costs the longest last segment wins."""
    n = len(chars)
    sums = np.vstack([np.zeros((1, vectors.shape[1])), np.cumsum(vectors, axis=0)])
    length, cross = np.concatenate(([0], np.cumsum(chars))), np.cumsum(crossing)
    best, parent = np.zeros(n + 1), np.zeros(n + 1, dtype=int)
    step = max(1, min(16, CELLS // max(1, sums.size)))
    for begin in range(1, n + 1, step):  # costs of all segments that end at one of so many units, then the recurrence over those ends
        end = np.arange(begin, min(begin + step, n + 1))
        last = int(end[-1])
        size = end[:, None] - np.arange(last)
        span = sums[end, None] - sums[None, :last]
        pairs = np.maximum(size * (size - 1), 1)
        loose = np.where(size > 1, 1 - ((span * span).sum(axis=2) - size) / pairs, 0.0)
        cost = loose + alpha * ((length[end, None] - length[:last] - target) / target) ** 2 + beta * (cross[end - 1, None] - cross[:last])
        for row, j in enumerate(end.tolist()):
            total = np.round(best[:j] + cost[row, :j], 12)
            parent[j] = int(np.argmin(total))
            best[j] = total[parent[j]]
    starts, cosines, j = [], [], n
    while j:
        i = int(parent[j])
        span, size = sums[j] - sums[i], j - i
        cosines.append((float(span @ span) - size) / (size * (size - 1)) if size > 1 else 1.0)
        starts.append(i)
        j = i
    return starts[::-1], float(best[n]), cosines[::-1]


_SOLVED = StructType([StructField("starts", ArrayType(IntegerType())), StructField("cost", DoubleType()), StructField("cosines", ArrayType(DoubleType()))])


@F.pandas_udf(_SOLVED)
def _segments(vectors: pd.Series, chars: pd.Series, crossing: pd.Series, target: pd.Series) -> pd.DataFrame:
    out = [solve(np.array([list(x) for x in v], dtype=float), np.asarray(c, dtype=float), np.asarray(m), float(t)) for v, c, m, t in zip(vectors, chars, crossing, target, strict=True)]
    return pd.DataFrame(out, columns=["starts", "cost", "cosines"])


def _documents(units: DataFrame) -> DataFrame:
    """A row for each document: its units in order (k first, then every other column), their number and characters."""
    rest = [c for c in units.columns if c not in ("doc_id", "k")]
    own = F.array_sort(F.collect_list(F.struct("k", *rest)))
    return units.groupBy("doc_id").agg(own.alias("u"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("n_units"))


def rejected(units: DataFrame) -> DataFrame:
    """Documents whose units have no characters, with the reason: there is no length to aim at."""
    total = units.groupBy("doc_id").agg(F.coalesce(F.sum("n_chars"), F.lit(0)).alias("total"))
    return total.where("total <= 0").select("doc_id", F.lit("no characters").alias("reason"))


def solved(units: DataFrame) -> DataFrame:
    """doc_id, u (units), n_units, target_k, target_chars, starts, cost, cosines of each document of units (doc_id, k, vector, n_chars, major, ...).

    Documents without characters have no target length; `rejected` has them.
    """
    per = _documents(units).where("total > 0").withColumn("target_k", target_k(F.col("total"))).withColumn("target_chars", F.col("total") / F.col("target_k"))
    changes = F.transform("u", lambda x, i: F.when((i > 0) & (x["major"] != F.get(F.col("u"), i - 1)["major"]), 1).otherwise(0))
    per = per.withColumn("s", _segments(F.transform("u", lambda x: x["vector"]), F.transform("u", lambda x: x["n_chars"]), changes, F.col("target_chars")))
    return per.select("doc_id", "u", "n_units", "target_k", "target_chars", "s.starts", "s.cost", "s.cosines")


def _last(at: Column) -> Column:
    return F.coalesce(F.try_element_at("starts", at + 2), F.col("n_units").cast("int")) - 1


def segments(found: DataFrame) -> DataFrame:
    """doc_id, id, first, last (unit positions, last included)."""
    rows = found.select("doc_id", "n_units", "starts", F.posexplode("starts").alias("id", "first"))
    return rows.select("doc_id", "id", "first", _last(F.col("id")).alias("last"))


def coarse_chunks(found: DataFrame) -> DataFrame:
    """The chunks of solved(), whole: ids of their units, characters with the blank lines between units, mean internal cosine.

    Where the units have them: text (joined), heading_first and heading_last (path, else heading), pages, contains_table.
    """
    has = set(found.schema["u"].dataType.elementType.names)
    rows = found.select("doc_id", "u", "n_units", "starts", F.posexplode(F.arrays_zip("starts", "cosines")).alias("id", "s"))
    first, last = F.col("s.starts"), _last(F.col("id"))
    rows = rows.select("doc_id", "id", F.slice("u", first + 1, last - first + 1).alias("m"), F.col("s.cosines").alias("cosine"))
    each = lambda c: F.transform("m", lambda x: x[c])
    n = F.size("m")
    chars = F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x["n_chars"]) + 2 * (n - 1)
    out = [F.lit("semantic_coarse").alias("strategy"), each("k").alias("structural_ids"), n.alias("n_structural"), chars.alias("n_chars"), F.bround("cosine", 4).alias("mean_internal_cosine")]
    if {"heading", "heading_path"} <= has:
        name = lambda x: F.coalesce(F.nullif(x["heading_path"], F.lit("")), F.nullif(x["heading"], F.lit("")))
        out += [name(F.col("m")[0]).alias("heading_first"), name(F.element_at("m", -1)).alias("heading_last")]
    if "pages" in has:
        out.append(F.array_sort(F.array_distinct(F.flatten(each("pages")))).alias("pages"))
    if "contains_table" in has:
        out.append(F.exists("m", lambda x: x["contains_table"]).alias("contains_table"))
    if "text" in has:
        out.append(F.array_join(F.transform("m", lambda x: F.coalesce(x["text"], F.lit(""))), "\n\n").alias("text"))
    return rows.select("doc_id", "id", *out)


def coarse_stats(found: DataFrame) -> DataFrame:
    """Chunks put in and out, target, total cost and sizes of each document."""
    sizes = coarse_chunks(found).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.bround(F.avg("n_chars"), 1).alias("mean_chars"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"))
    heads = found.select("doc_id", F.col("n_units").alias("n_input"), "target_k", F.bround("target_chars", 1).alias("target_chars"), F.lit(ALPHA).alias("alpha"), F.lit(BETA).alias("beta"), F.bround("cost", 4).alias("total_cost"))
    return heads.join(sizes, "doc_id")


def trace(found: DataFrame) -> DataFrame:
    """One row for each document: target, cost, weights and its segments (id, range, mean_internal_cosine, n_structural, n_chars)."""
    rows = coarse_chunks(found).join(segments(found).select("doc_id", "id", "first", "last"), ["doc_id", "id"])
    part = F.struct("id", F.array("first", "last").alias("range"), "mean_internal_cosine", "n_structural", "n_chars")
    parts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(part)).alias("segments"))
    return found.select("doc_id", "target_k", "target_chars", F.col("cost").alias("total_cost"), F.lit(ALPHA).alias("alpha"), F.lit(BETA).alias("beta")).join(parts, "doc_id")
