"""A corpus pipeline of five stages over documents (doc_id, text, lang, source, n_chars).

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of documents. Empty tables stay empty; columns beyond those of documents are dropped
by the first stage. Null ids and ids that several rows share are ids like others: every row goes or stays by its own
text, of rows that repeat id and text one stays, and the mix counts copies by row. Null texts are rejected by the first
stage. Ties go to the row of most code points, then of least id (null last), then of least lang, source and n_chars.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm import bpe_sql, exact_dedup, langid, mixing, ngram_join

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that language ID rejects go."""
    return langid.recognised(docs.select(*COLUMNS))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, as one row."""
    key = ["__null", "__id", "__sha"]
    named = [F.col("doc_id").isNull().alias("__null"), F.coalesce("doc_id", F.lit(0)).alias("__id")]
    kept = exact_dedup.exact_dedup(docs).where("kept").select(*named, F.col("text_sha256").alias("__sha")).distinct()
    rows = docs.select(*COLUMNS, *named, F.sha2(exact_dedup.normalised(F.col("text")), 256).alias("__sha")).join(kept, key)
    # rows that repeat the kept id and its text, white space aside: the longest stays, as for keep_id
    first = Window.partitionBy(*key).orderBy(F.length("text").desc_nulls_last(), "text", "lang", "source", "n_chars")
    return rows.withColumn("__r", F.row_number().over(first)).where("__r = 1").select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates, as one row."""
    return ngram_join.representatives(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.copies(docs.select(*COLUMNS))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document of the mix, copies too."""
    return bpe_sql.encode_decode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("ngram_join", near_stage),
    ("mixing", mixing_stage),
    ("bpe", encoding_stage),
]
#: Language ID and the encoder can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents of sf_dir, each stage cut off in the shared folder."""
    from lodestrata.llm.storage import cut

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
