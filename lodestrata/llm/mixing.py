"""Mixing sources to target weights by systematic sampling.

Sources, in code point order and null last, weigh 5, 2, 1, repeating; their targets share the sum of all sizes by
weight, stop at `cap` times the size of their source, and the excess is shared again by weight until none is above. A
document's expected copies are its source's target over its source's size. Within a source, documents stand in order of
size, then id; the prefix sum of expected copies plus one offset, drawn from a hash of the source, crosses integer
boundaries, and each crossing emits one copy. Neighbours have nearly the same size, so a source's taken words come near
its target whatever its sizes are.

The prefix sum is spread over range partitions of (source, size, id): counts of each partition give where the next one
starts, so no task holds a source.

Null and empty texts have size 0 and take 0 words. Repeated rows are separate documents that stand side by side. A
source of size 0 has target 0. Other columns are ignored by mix() and kept by copies().
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut
from .wordbatch import Words, chunks

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix"


def _sizes(batches):
    """The last column is text; its words are counted, the others stay."""
    for batch in batches:
        names, text = batch.schema.names[:-1], batch.column(batch.num_columns - 1)
        for first, last, data, offsets in chunks(text):
            yield pa.RecordBatch.from_arrays([*[batch.column(n).slice(first, last - first) for n in names], pa.array(Words(data, offsets).counts.astype("int64"))], names=[*names, "size"])


def sized(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, source, the key column (a long) if there is one, and number of words of each row."""
    keys = [key] if key else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *keys, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_sizes, ", ".join(["doc_id long", "source string", *[f"{k} long" for k in keys], "size long"]))


def targets(totals: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size and target of each row of totals (source, source_size).

    Sources reach their caps in order of cap over weight; the level of those that don't is what is left over the weight
    that is left. Its windows hold one row for each source, nothing else.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    # the first source in that order that stays under its cap has the level of all that do
    first = F.min(F.when(F.col("ratio") >= F.col("before"), F.struct("ratio", "place", "before"))).over(whole)
    return (
        totals.withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
        .withColumn("most", F.col("source_size") * cap)
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("before", (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(by_ratio), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0))))
        .withColumn("level", first["before"])
        .select("source", "source_size", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"))
    )


def offset(source, seed: str = SEED):
    """One number in [0, 1) for a source, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, *, key: str | None = None, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and the key column, if one is named, for each row of docs (doc_id, text, source)."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = sized(docs, key).withColumn("unnamed", F.col("source").isNull())
    # written once: the ranges must not be drawn again between the counts and the ranks
    rows = cut(rows.repartitionByRange(parts, "unnamed", "source", "size", "doc_id").withColumn("part", F.spark_partition_id()))
    counts = rows.groupBy("part", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    goals = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), **options)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("skip", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    starts = starts.join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(F.col("part").alias("p"), F.col("source").alias("s"), "skip", "source_size", "target", offset(F.col("source")).alias("u"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("part", "source").orderBy("size", "doc_id")))
    ranked = ranked.join(starts, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = (F.col("skip") + F.col("r")).cast("double")
    copies = F.when(F.col("size") > 0, F.floor(rank * each + F.col("u")) - F.floor((rank - 1) * each + F.col("u"))).otherwise(F.lit(0)).cast("long")
    return ranked.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), *([key] if key else []))


def copies(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of docs, with all its columns, as often as it is taken; repeated rows are rows of their own."""
    # written once: a row's key must be the same on both sides of the join
    rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    taken = mix(rows, key="__row", **options).where("copies > 0").select("__row", F.col("copies").alias("__copies"))
    return rows.join(taken, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), t AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source
), w AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS most FROM t
), r AS (
  SELECT *, most::DOUBLE / weight AS ratio FROM w
), b AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(most) OVER x, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER x, 0))::DOUBLE AS before
  FROM r WINDOW x AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT source, source_size, least(most::DOUBLE, (min(CASE WHEN ratio >= before THEN {'r': ratio, 'p': place, 'b': before} END) OVER ()).b * weight) AS target,
         ('0x' || substr(md5('mix:' || coalesce(source, chr(0))), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM b
), k AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.u, CASE WHEN g.source_size > 0 THEN g.target / g.source_size::DOUBLE ELSE 0.0::DOUBLE END AS each,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id)::DOUBLE AS rank
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), c AS (
  SELECT *, CASE WHEN size > 0 THEN floor(rank * each + u) - floor((rank - 1) * each + u) ELSE 0 END::BIGINT AS copies FROM k
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""
