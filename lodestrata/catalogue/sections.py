"""Queries on sections and structural chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import sections

from .elements import WS
from .inputs import ELEMENTS, documents, elements
from .registry import query

HEADINGS = ELEMENTS + rf""", h0 AS (
  SELECT *, nullif(regexp_extract(text, '^{WS}*(\d+(?:\.\d+)*)\.?{WS}+', 1), '') AS number, row_number() OVER (PARTITION BY doc_id ORDER BY idx)::INT AS section_id FROM elements WHERE type = 'SectionHeaderItem'
), h1 AS (
  SELECT *, len(string_split(number, '.')) AS own FROM h0
), h2 AS (
  SELECT *, count(own) OVER w AS island, coalesce(last_value(own IGNORE NULLS) OVER w, 0) AS base FROM h1 WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING)
), h AS (
  SELECT doc_id, section_id, idx, page, number, text, (base + sum((own IS NULL)::INT) OVER (PARTITION BY doc_id, island ORDER BY idx))::INT AS level FROM h2
)"""
PATHS = HEADINGS + """, par AS (
  SELECT a.*, coalesce((SELECT max(b.section_id) FROM h b WHERE b.doc_id = a.doc_id AND b.section_id < a.section_id AND b.level < a.level), 0) AS parent_id FROM h a
), sec AS (
  SELECT *, [section_id] AS path, text AS heading_path FROM par WHERE parent_id = 0
  UNION ALL
  SELECT p.*, list_append(s.path, p.section_id), s.heading_path || ' > ' || p.text FROM par p JOIN sec s ON s.doc_id = p.doc_id AND s.section_id = p.parent_id
)"""
PLACED = r"""placed AS (
  SELECT *, sum((type = 'SectionHeaderItem')::INT) OVER (PARTITION BY doc_id ORDER BY idx)::INT AS section_id FROM elements
  WHERE NOT (type = 'TableItem' AND length(text) - length(replace(text, '.', '')) > length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')))
    AND (type IN ('TableItem', 'SectionHeaderItem') OR text <> '')
)"""
CHUNKS = PATHS + ", " + PLACED + """, f AS (
  SELECT *, (type = 'SectionHeaderItem' OR type = 'TableItem' OR coalesce(lag(type) OVER w = 'TableItem', false))::INT AS cut,
    first_value(CASE type WHEN 'SectionHeaderItem' THEN 'new_heading' WHEN 'TableItem' THEN 'before_table' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next
  FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY idx)
), g AS (
  SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM f
), c AS (
  SELECT doc_id, section_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(idx)) - 1 AS id, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS text, list_sort(list(DISTINCT page)) AS pages,
    bool_or(type = 'TableItem') AS contains_table, max(next) AS next, list(idx ORDER BY idx) AS element_idxs
  FROM g WHERE type <> 'SectionHeaderItem' GROUP BY doc_id, section_id, run
), chunks AS (
  SELECT c.*, length(c.text) AS n_chars, CASE WHEN contains_table THEN 'table_atomic' ELSE coalesce(next, 'end') END AS flush_reason, number, sec.text AS heading, coalesce(level, 0) AS heading_level, coalesce(heading_path, '') AS heading_path
  FROM c LEFT JOIN sec USING (doc_id, section_id)
)"""
#: Chunks of `chunks` cut at missed headings, as `pieces`: a mark is put before each, texts have none of their own.
MISSED = rf"^{WS}*(\d+(?:\.\d+){{0,3}})\.?{WS}+([A-Z][A-Za-z0-9][^.\n|]{{1,120}}?)\.{WS}"


def split_sql(least: int) -> str:
    return rf"""cuts AS (
  SELECT *, n_chars >= {least} AND NOT contains_table AND regexp_matches(text, '(?m){MISSED}') AS large,
    CASE WHEN large THEN string_split(regexp_replace(text, '(?m)({MISSED})', chr(1) || '\1', 'g'), chr(1)) ELSE [text] END AS raws FROM chunks
), raw AS (
  SELECT * EXCLUDE (text, n_chars, id, raws), id AS old, unnest(raws) AS raw, generate_subscripts(raws, 1) AS place FROM cuts
), named AS (
  SELECT *, CASE WHEN large THEN nullif(regexp_extract(raw, '{MISSED}', 1), '') END AS num, regexp_extract(raw, '{MISSED}', 2) AS title,
    CASE WHEN large THEN regexp_replace(raw, '^{WS}+|{WS}+$', '', 'g') ELSE raw END AS text FROM raw
), pieces AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY old, place) - 1 AS id, section_id, pages, element_idxs, contains_table, text, length(text) AS n_chars,
    coalesce(num, number) AS number, CASE WHEN num IS NULL THEN heading ELSE num || ' ' || title END AS heading,
    CASE WHEN num IS NULL THEN heading_path ELSE concat_ws(' > ', coalesce(nullif(heading_path, ''), nullif(heading, '')), num || ' ' || title) END AS heading_path,
    CASE WHEN num IS NULL THEN heading_level ELSE greatest(heading_level, 1) + 1 END AS heading_level,
    CASE WHEN NOT large THEN flush_reason WHEN num IS NULL THEN 'post_split_preamble' ELSE 'post_split_missed_heading' END AS flush_reason
  FROM named WHERE NOT large OR text <> ''
)"""


_OUT = """doc_id, id::INT AS id, section_id, number, heading, heading_level::INT AS heading_level, heading_path, array_to_string(pages, ',') AS pages,
  array_to_string(element_idxs, ',') AS element_idxs, n_chars::INT AS n_chars, text, contains_table, flush_reason"""


def _flat(chunks):
    return chunks.withColumns({c: F.array_join(c, ",") for c in ("pages", "element_idxs")}).drop("strategy", "n_rows", "n_cols")


@query(f"WITH {HEADINGS} SELECT doc_id, section_id, number, text, level FROM h")
def heading_levels(s, d):
    return sections.sections(elements(s, d)).select("doc_id", "section_id", "number", "text", "level")


@query(f"WITH RECURSIVE {PATHS} SELECT doc_id, section_id, parent_id, array_to_string(path, '/') AS path, heading_path FROM sec")
def section_path(s, d):
    return sections.sections(elements(s, d)).select("doc_id", "section_id", "parent_id", F.array_join("path", "/").alias("path"), "heading_path")


_TREE = f"""{PATHS}, {PLACED}, own AS (
  SELECT doc_id, section_id, sum(CASE WHEN type = 'SectionHeaderItem' THEN 0 ELSE length(text) END)::BIGINT AS n, list(DISTINCT page) AS p,
    string_agg(idx, ',' ORDER BY idx) FILTER (type = 'TextItem') AS paragraphs, string_agg(idx, ',' ORDER BY idx) FILTER (type = 'ListItem') AS lists,
    string_agg(idx, ',' ORDER BY idx) FILTER (type = 'TableItem') AS tables FROM placed GROUP BY ALL
), allsec AS (
  SELECT doc_id, section_id, parent_id, number, text, level, path FROM sec
  UNION ALL SELECT DISTINCT doc_id, 0, NULL, NULL, NULL, 0, []::INT[] FROM elements
), r AS (
  SELECT a.*, coalesce(n, 0) AS n, p, paragraphs, lists, tables FROM allsec a LEFT JOIN own USING (doc_id, section_id)
), up AS (
  SELECT doc_id, unnest(list_prepend(0, path)) AS section_id, n, p FROM r
), tot AS (
  SELECT doc_id, section_id, sum(n)::BIGINT AS n_chars_total, list_sort(list_distinct(flatten(list(coalesce(p, []))))) AS pages FROM up GROUP BY ALL
), tree AS (
  SELECT r.doc_id, r.section_id, parent_id, number, text, level, n AS n_chars_self, n_chars_total, pages, paragraphs, lists, tables FROM r JOIN tot USING (doc_id, section_id)
)"""


@query(f"""WITH RECURSIVE {_TREE} SELECT doc_id, section_id, parent_id, number, text, level, n_chars_self, n_chars_total, array_to_string(pages, ',') AS pages,
  coalesce(paragraphs, '') AS paragraphs, coalesce(lists, '') AS lists, coalesce(tables, '') AS tables FROM tree""")
def section_rollup(s, d):
    ids = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x["idx"]), ","), F.lit("")).alias(c)
    tree = sections.section_tree(elements(s, d))
    return tree.select("doc_id", "section_id", "parent_id", "number", "text", "level", "n_chars_self", "n_chars_total", F.array_join("pages", ",").alias("pages"), *map(ids, ("paragraphs", "lists", "tables")))


@query(f"""WITH RECURSIVE {_TREE} SELECT doc_id, arg_min(text, section_id) FILTER (parent_id = 0) AS title, count(*) - 1 AS n_sections,
  (max(len(pages)) FILTER (section_id = 0))::INT AS n_pages, max(n_chars_total) FILTER (section_id = 0) AS tree_chars FROM tree GROUP BY doc_id""")
def doc_summary(s, d):
    return sections.summary(sections.section_tree(elements(s, d)))


@query(f"WITH RECURSIVE {CHUNKS} SELECT {_OUT} FROM chunks")
def structural_chunks(s, d):
    return _flat(sections.structural_chunks(elements(s, d)))


@query(f"""WITH RECURSIVE {_TREE}, {CHUNKS.split(PLACED + ", ")[1]}, st AS (
  SELECT doc_id, count(*) AS n_chunks, count_if(contains_table)::BIGINT AS n_tables, count_if(n_chars > 1200)::BIGINT AS n_large, sum(n_chars)::BIGINT AS chars,
    round_even(avg(n_chars), 1) AS mean_chars, min(n_chars)::INT AS min_chars, max(n_chars)::INT AS max_chars FROM chunks GROUP BY doc_id
) SELECT doc_id, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_tables, 0) AS n_tables, coalesce(n_large, 0) AS n_large, coalesce(chars, 0) AS chars, coalesce(mean_chars, 0.0::DOUBLE) AS mean_chars,
  coalesce(min_chars, 0) AS min_chars, coalesce(max_chars, 0) AS max_chars, n_sections, tree_chars
FROM (SELECT doc_id, count(*) - 1 AS n_sections, max(n_chars_total) FILTER (section_id = 0) AS tree_chars FROM tree GROUP BY doc_id) LEFT JOIN st USING (doc_id)""")
def structural_stats(s, d):
    found = elements(s, d)
    return sections.structural_stats(sections.structural_chunks(found), sections.section_tree(found))


@query(rf"""WITH chunks AS (
  SELECT doc_id, 0 AS id, 0 AS section_id, NULL::VARCHAR AS number, CASE WHEN doc_id % 2 = 0 THEN 'Top' END AS heading, (doc_id % 2 * 3)::INT AS heading_level, '' AS heading_path,
    []::INT[] AS pages, []::INT[] AS element_idxs, doc_id % 11 = 0 AS contains_table, replace(text, chr(10), chr(10) || doc_id || '.1 ') AS text, length(replace(text, chr(10), chr(10) || doc_id || '.1 ')) AS n_chars, 'end' AS flush_reason FROM documents
), {split_sql(1000)} SELECT doc_id, id::INT AS id, number, heading, heading_path, heading_level::INT AS heading_level, n_chars::INT AS n_chars, flush_reason, md5(text) AS text_md5 FROM pieces""")
def missed_headings(s, d):
    text = F.replace("text", F.lit("\n"), F.concat(F.lit("\n"), F.col("doc_id").cast("string"), F.lit(".1 ")))
    chunks = documents(s, d).select(
        "doc_id", F.lit(0).alias("id"), F.lit(None).cast("string").alias("number"), F.when(F.col("doc_id") % 2 == 0, "Top").alias("heading"), F.lit("").alias("heading_path"),
        (F.col("doc_id") % 2 * 3).cast("int").alias("heading_level"), F.length(text).alias("n_chars"), F.lit("end").alias("flush_reason"), (F.col("doc_id") % 11 == 0).alias("contains_table"), text.alias("text"))
    return sections.split_missed_headings(chunks, 1000).drop("contains_table").withColumn("text_md5", F.md5("text")).drop("text")


SENTENCES = rf"""list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), '([.?!]){WS}+([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g'), chr(1) || '|\n{{2,}}'),
  lambda s: regexp_replace(s, '^{WS}+|{WS}+$', '', 'g')), lambda s: s <> '')"""


@query(f"""WITH x AS (SELECT doc_id, {SENTENCES} AS s FROM documents)
SELECT doc_id, (generate_subscripts(s, 1) - 1)::INT AS i, md5(unnest(s)) AS sentence_md5 FROM x""")
def sentences(s, d):
    return documents(s, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "s")).select("doc_id", "i", F.md5("s").alias("sentence_md5"))
