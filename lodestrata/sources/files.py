"""Reading and writing of the pipeline's artifacts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ELEMENT = "doc_id long, idx int, page int, type string, level int, parent_heading string, text string, heading_level int, n_rows int, n_cols int"
SPAN = "doc_id long, page int, block int, line int, pos int, block_type int, size double, flags int, text string"
#: Default length of a preview in bytes.
PREVIEW_BYTES = 200_000


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines file; blank lines are skipped, a broken one raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Valid rows only, for paged views: offsets and totals count valid rows, wherever blank or broken lines stand between them."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a JSON lines file, or none where it is missing."""
    try:
        return read_jsonl(spark, path, schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_metrics(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One row for each metrics document of a folder: its name, its fields, or the text that doesn't parse."""
    rows = spark.read.option("wholetext", True).text(folder, pathGlobFilter="*.json").select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), "value")
    fields = F.from_json("value", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    return rows.select("name", fields.alias("fields"), F.when(fields["_broken"].isNotNull(), F.col("value")).alias("_error"))


def read_documents(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """doc_id, name and content of the files of a folder; ids come from the names, so they stay when files are added."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.xxhash64(name).alias("doc_id"), name.alias("name"), "content")


def current_document(documents: DataFrame) -> DataFrame:
    """The first document by name, as pipelines of one document at a time take it."""
    return documents.orderBy("name").limit(1)


def parse(documents: DataFrame, parser: Callable[[bytes], Iterator[dict]], schema: str = SPAN) -> DataFrame:
    """Rows that a parser makes of each document's bytes: spans for elements.from_spans, or elements (schema ELEMENT).

    The parser yields dicts without doc_id, in order; spans get their place pos, elements their idx, from that order. It
    runs in the tasks that read the files; rows leave a document at a time.
    """
    fields = [f.split()[0] for f in schema.split(", ")]
    place = "pos" if "pos" in fields else "idx"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for doc_id, content in zip(part["doc_id"], part["content"], strict=True):
                rows = [{place: i, **row, "doc_id": doc_id} for i, row in enumerate(parser(content))]
                yield pd.DataFrame(rows, columns=fields, dtype=object)

    return documents.select("doc_id", "content").mapInPandas(run, schema)


def artifacts(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Name, size and time of the files of a stage; their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def preview_file(spark: SparkSession, path: str, most: int = PREVIEW_BYTES) -> DataFrame:
    """Name and the first bytes of a file as text; what isn't UTF-8 shows as the replacement character."""
    text = F.make_valid_utf8(F.substring("content", 1, most).cast("string"))
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), text.alias("text"))


def stage_status(found: DataFrame, expected: list[tuple[str, str]]) -> DataFrame:
    """pending, partial or done for each stage of (stage, file name) pairs."""
    want = found.sparkSession.createDataFrame(expected, "stage string, name string")
    per = want.join(found, "name", "left").groupBy("stage").agg(F.count("length").alias("have"), F.count(F.lit(1)).alias("want"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.max("modified").alias("modified"))
    status = F.when(F.col("have") == 0, "pending").when(F.col("have") == F.col("want"), "done").otherwise("partial")
    return per.select("stage", status.alias("status"), "bytes", "modified")


def documents(elements: DataFrame) -> DataFrame:
    """The element texts of each document joined by blank lines."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", F.coalesce("text", F.lit("")).alias("text"))))
    return elements.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda e: e["text"]), "\n\n").alias("markdown"))


def write_markdown(elements: DataFrame, folder: str) -> None:
    """A text file for the documents of each task, one document a row, in folders by doc_id."""
    documents(elements).select("doc_id", F.col("markdown").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(folder)


def write_jsonl(rows: DataFrame, path: str) -> int:
    """Writes JSON lines over what was there; the number of rows, counted as they are written."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def write_json(row: DataFrame, path: str) -> None:
    """The one row of a small DataFrame as a pretty JSON document, through Spark's own writer."""
    found = row.select(F.to_json(F.struct("*")).alias("j")).head(2)
    if len(found) != 1:
        raise ValueError(f"one row makes a document, not {len(found)}")
    text = json.dumps(json.loads(found[0]["j"]), indent=2, ensure_ascii=False)
    row.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def clear(spark: SparkSession, folders: list[str]) -> None:
    """Empties the folders of an earlier run, on whatever file system they are; missing ones are made."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.delete(path, True)
        system.mkdirs(path)


def append_cache(vectors: DataFrame, path: str) -> None:
    """Adds new vectors (model, key, embedding) to a cache that is only ever appended to."""
    vectors.write.mode("append").partitionBy("model").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "key string, embedding array<float>, model string")
