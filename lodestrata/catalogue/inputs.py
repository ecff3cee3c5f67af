"""Inputs made of the given tables, in SQL that Spark and DuckDB both read, and the tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LINE_ORDER = "l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
#: Elements made of order lines: a supplier is a document.
_ELEMENTS = f"""
SELECT l_suppkey AS doc_id,
  CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY {_LINE_ORDER}) - 1 AS INT) AS idx,
  CAST(1 + l_orderkey % 7 AS INT) AS page,
  CASE WHEN l_linenumber = 1 THEN 'SectionHeaderItem' WHEN l_linenumber = 4 THEN 'TableItem'
       WHEN l_linenumber = 3 THEN 'ListItem' ELSE 'TextItem' END AS type,
  CASE WHEN l_linenumber = 1 AND l_orderkey % 3 = 1 THEN concat(CAST(l_orderkey % 9 + 1 AS STRING), ' ', p_name)
       WHEN l_linenumber = 1 AND l_orderkey % 3 = 2 THEN concat(CAST(l_orderkey % 9 + 1 AS STRING), '.', CAST(l_partkey % 5 + 1 AS STRING), ' ', p_name)
       WHEN l_linenumber = 4 AND l_orderkey % 5 = 0 THEN '. . . . 1'
       WHEN l_linenumber = 5 AND l_orderkey % 11 = 0 THEN '' ELSE p_name END AS text
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey"""
#: Font spans: a supplier is a document, fifty blocks a page, an order line's number the line of the block.
_SPANS = f"""
SELECT l_suppkey AS doc_id, CAST(l_orderkey % 500 AS INT) AS block, CAST(l_orderkey % 500 DIV 50 + 1 AS INT) AS page, l_linenumber AS line,
  CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey % 500, {_LINE_ORDER}) AS INT) AS pos,
  CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS block_type, CAST(p_size AS DOUBLE) AS size,
  CASE WHEN CAST(l_quantity AS INT) % 2 = 0 THEN 16 ELSE 0 END AS flags, p_name AS text
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey"""
#: Units of segmentation: fifty documents with given vectors are one document. The heading of a unit is how its text begins.
_UNITS = """
SELECT CAST(floor(vec_id / 50) AS BIGINT) AS doc_id, vec_id AS k, embedding AS vector, n_chars, CAST(floor(vec_id % 50 / 9) AS STRING) AS major,
  substr(text, 1, 30) AS heading, CASE WHEN vec_id % 4 = 0 THEN '' ELSE concat('Part > ', substr(text, 1, 10)) END AS heading_path,
  {array}(CAST(vec_id % 3 AS INT), CAST(vec_id % 5 AS INT)) AS pages, vec_id % 7 = 0 AS contains_table, text
FROM {embeddings} JOIN {documents} ON doc_id = vec_id"""


def _bare(sql: str) -> str:
    for name in ("lineitem", "part", "embeddings", "documents"):
        sql = sql.replace("{" + name + "}", name)
    return sql.replace("{array}", "list_value").replace(" DIV ", " // ")


ELEMENTS, SPANS, UNITS = f"elements AS ({_bare(_ELEMENTS)})", f"spans AS ({_bare(_SPANS)})", f"units AS ({_bare(_UNITS)})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    known = {n: table(spark, sf_dir, n) for n in ("lineitem", "part", "embeddings", "documents") if "{" + n + "}" in sql}
    return spark.sql(sql.replace("{array}", "array"), **known)


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, _ELEMENTS)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, _SPANS)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, _UNITS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def plain(df: DataFrame, *times: str) -> DataFrame:
    return df.withColumns({t: F.col(t).cast("timestamp_ntz") for t in times})
