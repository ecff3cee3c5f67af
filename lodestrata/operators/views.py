"""Pages of chunks, archives, log lines, runs and comparisons."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import safe_name, short_number

MOST_ROWS, DEFAULT_ROWS, LOG_ROWS = 500, 50, 500
#: Fixed order of figures.
FIGURES = ["coarse_similarity.png", "adjacent_distance.png", "chunk_sizes.png", "umap_chunks.png", "umap_trajectory.png"]


def preview(text: Column, n: int = 160) -> Column:
    return F.substring(F.replace(text, F.lit("\n"), F.lit(" ")), 1, n)


def _known(rows: DataFrame, *names: str) -> Column:
    """The first of the named columns that has a value; null where the rows have none of them."""
    found = [F.col(n) for n in names if n in rows.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def element_list(elements: DataFrame) -> DataFrame:
    """Elements as rows of a list: id, n_chars, preview, type, page, heading_level."""
    text = F.coalesce("text", F.lit(""))
    return elements.select("doc_id", F.col("idx").alias("id"), F.length(text).alias("n_chars"), preview(text).alias("preview"), "type", "page", _known(elements, "heading_level").alias("heading_level"))


def chunk_list(chunks: DataFrame) -> DataFrame:
    """Chunks as rows of a list: id, n_chars, preview, heading, heading_path, pages, contains_table. Coarse chunks show their first heading."""
    text = F.coalesce("text", F.lit(""))
    table = F.coalesce(F.col("contains_table"), F.lit(False)) if "contains_table" in chunks.columns else F.lit(False)
    heading = _known(chunks, "heading", "heading_first")
    return chunks.select("doc_id", "id", F.coalesce(_known(chunks, "n_chars"), F.length(text)).alias("n_chars"), preview(text).alias("preview"), heading.alias("heading"), _known(chunks, "heading_path").alias("heading_path"), _known(chunks, "pages").alias("pages"), table.alias("contains_table"))


def page(rows: DataFrame, order: str, offset: int = 0, limit: int = DEFAULT_ROWS) -> DataFrame:
    """A page of rows in order: what is asked for, 500 rows at most; none for a limit of 0."""
    return rows.orderBy(order).offset(max(0, offset)).limit(max(0, min(limit, MOST_ROWS)))


def counted_page(rows: DataFrame, order: str, offset: int = 0, limit: int = DEFAULT_ROWS) -> DataFrame:
    """A page with the number of all rows in the column total; an empty page has no row to tell it (rows.count() does)."""
    return page(rows, order, offset, limit).join(rows.agg(F.count(F.lit(1)).alias("total")))


def by_id(rows: DataFrame, key: str, value: int) -> DataFrame:
    return rows.where(F.col(key) == value).limit(1)


def archive_entries(rows: DataFrame) -> DataFrame:
    """Name and body of a text file for each coarse chunk: two lines of header, a blank line, the text."""
    heading = F.coalesce(F.expr("nullif(heading_first, '')"), F.lit("chunk"))
    name = F.concat(F.lit("chunk_"), F.format_string("%02d", F.col("id")), F.lit("_"), safe_name(heading), F.lit(".txt"))
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    first = F.concat(F.lit("# chunk "), F.col("id").cast("string"), F.lit(" | pages "), listed("pages"), F.lit(" | structural ids "), listed("structural_ids"), F.lit(" | mean_internal_cosine "), short_number(F.col("mean_internal_cosine")))
    body = F.concat(first, F.lit("\n# heading: "), heading, F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return rows.select("doc_id", "id", name.alias("name"), body.alias("body"))


def archives(entries: DataFrame) -> DataFrame:
    """doc_id, n_files and zip (the bytes of an archive) for each document of archive_entries; a document's files meet in one task."""

    def pack(files: pd.DataFrame) -> pd.DataFrame:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            for row in files.sort_values("id").itertuples():
                # a date of its own keeps the bytes the same in every run
                archive.writestr(zipfile.ZipInfo(row.name, (1980, 1, 1, 0, 0, 0)), row.body, zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"doc_id": files["doc_id"].iloc[:1], "n_files": [len(files)], "zip": [buffer.getvalue()]})

    return entries.groupBy("doc_id").applyInPandas(pack, "doc_id long, n_files long, zip binary")


def severity(line: Column) -> Column:
    low = F.lower(line)
    return F.when(low.rlike("error|traceback|failed"), "err").when(low.contains("warn"), "warn").when(low.rlike("done|wrote| uploaded|complete"), "ok").otherwise("info")


def scrape(line: Column, pattern: str) -> Column:
    return F.regexp_extract(line, pattern, 1).try_cast("double")


def log_poll(events: DataFrame, order: list[str]) -> DataFrame:
    """The first 500 events of a log, in order."""
    return events.orderBy(*order).limit(LOG_ROWS)


def figure_order(names: DataFrame) -> DataFrame:
    """Figures (name) with their place: the known ones in their fixed order, then all others."""
    known = F.array_position(F.array(*map(F.lit, FIGURES)), F.col("name"))
    place = F.row_number().over(Window.orderBy(F.when(known > 0, known).otherwise(99), "name"))
    return names.withColumn("place", place)


def merged_status(log: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """The last known value of each field: an append log read as a merged record."""
    rank = F.struct(*order)
    return log.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), rank)).alias(f) for f in fields])


def job_status(asked: DataFrame, merged: DataFrame, key: str, status: str) -> DataFrame:
    """The status of every job asked for; unknown where the log has none."""
    return asked.select(key).join(merged, key, "left").withColumn(status, F.coalesce(status, F.lit("unknown")))


def transitions(log: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Rows where a key's state differs from the one before."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    return log.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col(state)))


def comparison(a: DataFrame, b: DataFrame, runs: DataFrame, on: list[str]) -> DataFrame:
    """Every combination of two option lists, with its runs' figures where it has run; the combinations are the result."""
    return a.crossJoin(b).join(runs, on, "left")


def markdown_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as a line of a markdown table; a missing value shows as a dash."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]
    return rows.withColumn("line", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")))
