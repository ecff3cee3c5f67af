"""Exact dedup, DataFrame functions only.

Texts are equal when they are identical after deleting ASCII white space. Groups are formed by the 128-bit content hash
of the normalised text together with that text itself: rows of one hash are told apart by comparing their bytes, so a
collision makes two groups. That aggregation combines before its shuffle, so a group of any size sends one row from each
task. The rows, without their texts, then meet the group they belong to by (hash, sha256); a hot group is one row on the
other side, and skewed partitions of that join can be split.

The row that stays has most code points in its original text, then the smallest doc_id; a null doc_id comes last. Null
texts count as empty, and all empty texts are one group. Repeated rows with one doc_id are one document in keep_id and
kept, but each counts in group_size. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE_SPACE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def classes(docs: DataFrame) -> DataFrame:
    """One row for each distinct normalised text: hash, text_sha256, group_size, keep_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce("text", F.lit(""))).alias("n"), normalised(F.col("text")).alias("norm"))
    rows = rows.withColumn("hash", F.unhex(F.md5("norm")))
    # the largest (code points, -doc_id); null sorts below every id
    best = F.max(F.struct("n", (-F.col("doc_id")).alias("negated")))
    groups = rows.groupBy("hash", "norm").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    return groups.select("hash", F.sha2("norm", 256).alias("text_sha256"), "group_size", (-F.col("best.negated")).alias("keep_id"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text), dropped ones too."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"))
    rows = rows.select("doc_id", F.unhex(F.md5("norm")).alias("hash"), F.sha2("norm", 256).alias("text_sha256"))
    joined = rows.join(classes(docs), ["hash", "text_sha256"])
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id ASC NULLS LAST) AS keep_id FROM d
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
