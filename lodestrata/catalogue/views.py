"""Queries on views: lists, pages, archives, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import segment, views
from lodestrata.sources import files

from .inputs import ELEMENTS, UNITS, documents, elements, table, units
from .registry import query
from .segments import COSTS


@query("SELECT doc_id, n_chars, substr(replace(text, chr(10), ' '), 1, 160) AS preview, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY doc_id LIMIT 50 OFFSET 10")
def chunk_view_page(s, d):
    return views.counted_page(documents(s, d).select("doc_id", "n_chars", views.preview(F.col("text")).alias("preview")), "doc_id", 10, 50)


@query(f"WITH {ELEMENTS} SELECT doc_id, idx AS id, length(text)::INT AS n_chars, substr(text, 1, 160) AS preview, type, page, NULL::VARCHAR AS heading_level FROM elements")
def element_list_view(s, d):
    return views.element_list(elements(s, d))


@query(f"""WITH RECURSIVE {UNITS}, {COSTS}, tx AS (SELECT doc_id, id, string_agg(text, chr(10) || chr(10) ORDER BY k) AS text FROM cd GROUP BY ALL)
SELECT doc_id, id, n_chars, substr(replace(text, chr(10), ' '), 1, 160) AS preview, heading_first AS heading, NULL::VARCHAR AS heading_path, pages, contains_table FROM cc JOIN tx USING (doc_id, id)""")
def chunk_list_view(s, d):
    return views.chunk_list(segment.coarse_chunks(segment.solved(units(s, d)))).withColumn("pages", F.array_join("pages", ","))


@query("SELECT doc_id, lang, text FROM documents WHERE doc_id = 42")
def chunk_by_id(s, d):
    return views.by_id(documents(s, d).select("doc_id", "lang", "text"), "doc_id", 42)


@query(r"""WITH x AS (SELECT doc_id, (doc_id % 150)::INT AS id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE substr(text, 1, 80) END AS heading, text FROM documents),
y AS (SELECT *, coalesce(nullif(heading, ''), 'chunk') AS h FROM x), z AS (SELECT *, substr(regexp_replace(regexp_replace(h, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 50) AS safe FROM y)
SELECT doc_id, id, 'chunk_' || printf('%02d', id) || '_' || CASE WHEN safe = '' THEN 'chunk' ELSE safe END || '.txt' AS name,
  md5('# chunk ' || id || ' | pages [1, 2] | structural ids [' || doc_id || '] | mean_internal_cosine ' || CASE id % 3 WHEN 0 THEN '1.0' WHEN 1 THEN '0.25' ELSE '0.0001' END || chr(10) || '# heading: ' || h || chr(10) || chr(10) || text) AS body_md5 FROM z""")
def zip_entries(s, d):
    id_ = (F.col("doc_id") % 150).cast("int")
    cosine = F.when(id_ % 3 == 0, 1.0).when(id_ % 3 == 1, 0.25).otherwise(0.0001)
    heading = F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.substring("text", 1, 80))
    rows = documents(s, d).select("doc_id", id_.alias("id"), heading.alias("heading_first"), F.array(F.lit(1), F.lit(2)).alias("pages"), F.array("doc_id").alias("structural_ids"), cosine.alias("mean_internal_cosine"), "text")
    return views.archive_entries(rows).select("doc_id", "id", "name", F.md5("body").alias("body_md5"))


@query()
def zip_archives(s, d):
    """Archives of the coarse chunks; tests open them."""
    found = segment.coarse_chunks(segment.solved(units(s, d)))
    return views.archives(views.archive_entries(found)).select("doc_id", "n_files", F.length("zip").alias("n_bytes"))


@query("""SELECT event_id, CASE WHEN regexp_matches(l, 'error|traceback|failed') THEN 'err' WHEN contains(l, 'warn') THEN 'warn' WHEN regexp_matches(l, 'done|wrote| uploaded|complete') THEN 'ok' ELSE 'info' END AS severity
FROM (SELECT event_id, lower(event_type || ' ' || ['step failed', 'a warning', 'wrote file', 'idle'][event_id % 4 + 1]) AS l FROM events)""")
def log_classify(s, d):
    said = F.element_at(F.array(*map(F.lit, ["step failed", "a warning", "wrote file", "idle"])), (F.col("event_id") % 4 + 1).cast("int"))
    return table(s, d, "events").select("event_id", views.severity(F.concat_ws(" ", "event_type", said)).alias("severity"))


@query(r"""SELECT event_id, try_cast(regexp_extract(props, '"k": (\d+)', 1) AS DOUBLE) AS k FROM events""")
def log_scrape(s, d):
    return table(s, d, "events").select("event_id", views.scrape(F.col("props"), r'"k": (\d+)').alias("k"))


@query("SELECT event_id, event_type FROM events ORDER BY ts, event_id LIMIT 500")
def log_poll(s, d):
    return views.log_poll(table(s, d, "events"), ["ts", "event_id"]).select("event_id", "event_type")


@query("""SELECT name, (row_number() OVER (ORDER BY CASE name WHEN 'coarse_similarity.png' THEN 1 WHEN 'adjacent_distance.png' THEN 2 WHEN 'chunk_sizes.png' THEN 3 WHEN 'umap_chunks.png' THEN 4
  WHEN 'umap_trajectory.png' THEN 5 ELSE 99 END, name))::INT AS place FROM (SELECT DISTINCT event_type || '.png' AS name FROM events UNION ALL SELECT unnest(['umap_chunks.png', 'chunk_sizes.png', 'coarse_similarity.png']))""")
def figure_order(s, d):
    names = table(s, d, "events").select(F.concat("event_type", F.lit(".png")).alias("name")).distinct()
    more = s.createDataFrame([("umap_chunks.png",), ("chunk_sizes.png",), ("coarse_similarity.png",)], "name string")
    return views.figure_order(names.union(more))


_COMPARED = """SELECT l.lang, s.source, r.n, r.mean FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (SELECT DISTINCT source FROM documents) s
LEFT JOIN (SELECT lang, source, count(*) AS n, round(avg(n_chars), 6) AS mean FROM documents GROUP BY ALL) r ON r.lang = l.lang AND r.source = s.source"""


@query(_COMPARED)
def comparison_matrix(s, d):
    docs = documents(s, d)
    runs = docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"))
    return views.comparison(docs.select("lang").distinct(), docs.select("source").distinct(), runs, ["lang", "source"])


@query(f"SELECT '| ' || concat_ws(' | ', lang, source, coalesce(n::VARCHAR, '-')) || ' |' AS line FROM ({_COMPARED})")
def comparison_markdown(s, d):
    return views.markdown_rows(comparison_matrix(s, d), ["lang", "source", "n"]).select("line")


@query("SELECT * FROM (VALUES ('text', 'done'), ('vectors', 'partial'), ('figures', 'pending')) t(stage, status)")
def stage_status(s, d):
    want = [("text", "documents.parquet"), ("text", "pages.parquet"), ("vectors", "embeddings.parquet"), ("vectors", "none.npy"), ("figures", "none.png")]
    return files.stage_status(files.artifacts(s, d, "*.parquet"), want).select("stage", "status")
