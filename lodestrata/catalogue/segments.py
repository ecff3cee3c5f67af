"""Queries on segmentation into coarse chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import segment
from lodestrata.plans import coarse

from .inputs import UNITS, elements, units
from .registry import query
from .sections import CHUNKS, SENTENCES, split_sql

#: The exact recurrence over a table `units`, up to segments `seg` and their units `cd`.
COSTS = """u AS (
  SELECT *, row_number() OVER w AS p, coalesce(major <> lag(major) OVER w, false)::INT AS crossing FROM units WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), t AS (
  SELECT doc_id, count(*) AS n, greatest(12, least(30, round_even(sum(n_chars) / 2000.0::DOUBLE, 0)::INT)) AS target_k, sum(n_chars)::DOUBLE / target_k AS tc FROM u GROUP BY doc_id HAVING sum(n_chars) > 0
), d AS (
  SELECT doc_id, p, generate_subscripts(vector, 1) AS d, unnest(vector)::DOUBLE AS x FROM u
), ps AS (
  SELECT doc_id, p, list(s ORDER BY d) AS s FROM (
    SELECT doc_id, p, d, sum(x) OVER (PARTITION BY doc_id, d ORDER BY p) AS s FROM d UNION ALL SELECT DISTINCT doc_id, 0, d, 0.0::DOUBLE FROM d
  ) GROUP BY ALL
), n2 AS (
  SELECT a.doc_id, a.p AS i, b.p AS j, list_distance(a.s, b.s) ** 2 AS q FROM ps a JOIN ps b ON a.doc_id = b.doc_id AND a.p < b.p
), cs AS (
  SELECT doc_id, p, sum(n_chars) OVER w AS len, sum(crossing) OVER w AS cr FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY p) UNION ALL SELECT doc_id, 0, 0, 0 FROM t
), cost AS (
  SELECT n2.doc_id, n2.i, n2.j, CASE WHEN n2.j - n2.i > 1 THEN 1 - (q - (n2.j - n2.i)) / ((n2.j - n2.i) * (n2.j - n2.i - 1)) ELSE 0 END
    + ((e.len - b.len - tc) / tc) ** 2 + 0.3::DOUBLE * (e.cr - f.cr) AS c
  FROM n2 JOIN cs b ON b.doc_id = n2.doc_id AND b.p = n2.i JOIN cs e ON e.doc_id = n2.doc_id AND e.p = n2.j JOIN cs f ON f.doc_id = n2.doc_id AND f.p = n2.i + 1 JOIN t ON t.doc_id = n2.doc_id
), cl AS (
  SELECT doc_id, j, list(c ORDER BY i) AS cl FROM cost GROUP BY ALL
), dp AS (
  SELECT doc_id, list_reduce(list({'best': []::DOUBLE[], 'par': []::BIGINT[], 'c': cl} ORDER BY j), lambda a, x: list_transform([list_transform(list_zip(a.best, x.c), lambda y: round(y[1] + y[2], 12))],
    lambda z: {'best': list_append(a.best, list_min(z)), 'par': list_append(a.par, (list_position(z, list_min(z)) - 1)::BIGINT), 'c': []::DOUBLE[]})[1], {'best': [0.0::DOUBLE], 'par': []::BIGINT[], 'c': []::DOUBLE[]}) AS r FROM cl GROUP BY doc_id
), fin AS (
  SELECT doc_id, r.best AS best, r.par AS par, t.target_k, t.tc, t.n FROM dp JOIN t USING (doc_id)
), bt AS (
  SELECT doc_id, par, par[n] AS first, n - 1 AS last FROM fin
  UNION ALL
  SELECT doc_id, par, par[first], first - 1 FROM bt WHERE first > 0
), seg AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1)::INT AS id, first::INT AS first, last::INT AS last FROM bt
), cd AS (
  SELECT seg.doc_id, seg.id, u.* EXCLUDE (doc_id) FROM seg JOIN u ON u.doc_id = seg.doc_id AND u.p - 1 BETWEEN seg.first AND seg.last
), cv AS (
  SELECT doc_id, id, sum(s * s) AS q FROM (SELECT doc_id, id, d, sum(x) AS s FROM (SELECT doc_id, id, generate_subscripts(vector, 1) AS d, unnest(vector)::DOUBLE AS x FROM cd) GROUP BY ALL) GROUP BY ALL
), cc AS (
  SELECT doc_id, id, string_agg(k, ',' ORDER BY k) AS structural_ids, count(*)::INT AS n_structural, (sum(n_chars) + 2 * (count(*) - 1))::BIGINT AS n_chars,
    first(coalesce(nullif(heading_path, ''), nullif(heading, '')) ORDER BY k) AS heading_first, last(coalesce(nullif(heading_path, ''), nullif(heading, '')) ORDER BY k) AS heading_last,
    array_to_string(list_sort(list_distinct(flatten(list(pages)))), ',') AS pages, bool_or(contains_table) AS contains_table, md5(string_agg(text, chr(10) || chr(10) ORDER BY k)) AS text_md5
  FROM cd GROUP BY ALL
), coarse AS (
  SELECT cc.*, round_even(CASE WHEN n_structural > 1 THEN (q - n_structural) / (n_structural * (n_structural - 1)) ELSE 1.0 END, 4) AS mean_internal_cosine FROM cc JOIN cv USING (doc_id, id)
)"""
_OUT = "doc_id, id, structural_ids, n_structural, n_chars, mean_internal_cosine, heading_first, heading_last, pages, contains_table, text_md5"
_GIVEN = f"WITH RECURSIVE {UNITS}, {COSTS}"


def _flat(chunks):
    lists = {c: F.array_join(c, ",") for c in ("structural_ids", "pages")}
    return chunks.withColumns(lists | {"text_md5": F.md5("text")}).drop("strategy", "text")


@query(f"WITH {UNITS} SELECT doc_id, sum(n_chars)::BIGINT AS total, greatest(12, least(30, round_even(sum(n_chars) / 2000.0::DOUBLE, 0)::INT)) AS k FROM units GROUP BY doc_id")
def target_k(s, d):
    return units(s, d).groupBy("doc_id").agg(F.sum("n_chars").alias("total")).select("doc_id", "total", segment.target_k(F.col("total")).alias("k"))


@query(f"WITH {UNITS} SELECT doc_id, k, coalesce(major <> lag(major) OVER (PARTITION BY doc_id ORDER BY k), false)::INT AS crossing FROM units")
def major_crossings(s, d):
    return segment.crossings(units(s, d)).select("doc_id", "k", "crossing")


@query("SELECT conv_id AS doc_id, 'no characters' AS reason FROM conversations GROUP BY conv_id HAVING sum(length(text) * (conv_id % 2)) = 0")
def rejected_documents(s, d):
    turns = s.read.parquet(f"{d}/conversations.parquet")
    return segment.rejected(turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("k"), (F.length("text") * (F.col("conv_id") % 2)).alias("n_chars")))


@query(f"{_GIVEN} SELECT doc_id, id, first, last FROM seg")
def dp_segments(s, d):
    return segment.segments(segment.solved(units(s, d).select("doc_id", "k", "vector", "n_chars", "major")))


@query(f"{_GIVEN} SELECT doc_id, target_k, round(tc, 6) AS target_chars, round(best[-1], 6) AS cost FROM fin")
def dp_total_cost(s, d):
    found = segment.solved(units(s, d).select("doc_id", "k", "vector", "n_chars", "major"))
    return found.select("doc_id", "target_k", F.round("target_chars", 6).alias("target_chars"), F.round("cost", 6).alias("cost"))


@query(f"{_GIVEN} SELECT {_OUT} FROM coarse")
def coarse_chunks(s, d):
    return _flat(segment.coarse_chunks(segment.solved(units(s, d))))


@query(f"""{_GIVEN} SELECT fin.doc_id, fin.n AS n_input, target_k, round_even(tc, 1) AS target_chars, 1.0::DOUBLE AS alpha, 0.3::DOUBLE AS beta, round_even(best[-1], 4) AS total_cost,
  count(*) AS n_chunks, round_even(avg(n_chars), 1) AS mean_chars, min(n_chars) AS min_chars, max(n_chars) AS max_chars FROM fin JOIN cc USING (doc_id) GROUP BY ALL""")
def coarse_stats(s, d):
    return segment.coarse_stats(segment.solved(units(s, d).select("doc_id", "k", "vector", "n_chars", "major")))


@query(f"""{_GIVEN} SELECT doc_id, target_k, round(tc, 6) AS target_chars, round(best[-1], 6) AS total_cost,
  (SELECT string_agg(seg.id || ':' || first || '-' || last || ':' || n_structural || ':' || n_chars, ',' ORDER BY seg.id) FROM seg JOIN cc ON cc.doc_id = seg.doc_id AND cc.id = seg.id WHERE seg.doc_id = fin.doc_id) AS segments FROM fin""")
def coarse_trace(s, d):
    found = segment.trace(segment.solved(units(s, d).select("doc_id", "k", "vector", "n_chars", "major")))
    told = F.transform("segments", lambda x: F.concat_ws(":", x["id"].cast("string"), F.array_join(x["range"], "-"), x["n_structural"].cast("string"), x["n_chars"].cast("string")))
    return found.select("doc_id", "target_k", F.round("target_chars", 6).alias("target_chars"), F.round("total_cost", 6).alias("total_cost"), F.array_join(told, ",").alias("segments"))


#: Units of the whole way: chunks cut at missed headings, sentences hashed and pooled.
WHOLE = rf"""{CHUNKS}, {split_sql(10_240)}, ss AS (
  SELECT doc_id, id, unnest(s) AS t, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, id, {SENTENCES} AS s FROM pieces)
), sw AS (
  SELECT doc_id, id, i, unnest(string_split_regex(lower(t), '[^a-z0-9]+')) AS w FROM ss
), sc AS (
  SELECT doc_id, id, i, (('0x' || substr(md5(w), 1, 8))::BIGINT % 32)::INT AS b, count(*)::DOUBLE AS c FROM sw WHERE w <> '' GROUP BY ALL
), sv AS (
  SELECT doc_id, id, b, sum(x) AS x FROM (SELECT doc_id, id, b, c / sqrt(sum(c * c) OVER (PARTITION BY doc_id, id, i)) AS x FROM sc) GROUP BY ALL
), sx AS (
  SELECT doc_id, id, b, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id, id)) AS x FROM sv
), sd AS (
  SELECT p.doc_id, p.id, list(coalesce(x, 0.0::DOUBLE) ORDER BY r.b) AS vector FROM pieces p CROSS JOIN (SELECT unnest(range(32))::INT AS b) r LEFT JOIN sx ON sx.doc_id = p.doc_id AND sx.id = p.id AND sx.b = r.b GROUP BY ALL
), units AS (
  SELECT doc_id, id AS k, vector, n_chars, split_part(number, '.', 1) AS major, heading, heading_path, pages, contains_table, text FROM pieces JOIN sd USING (doc_id, id)
)"""


@query(f"WITH RECURSIVE {WHOLE}, {COSTS} SELECT {_OUT} FROM coarse")
def coarse_end_to_end(s, d):
    return _flat(coarse.coarse(elements(s, d)))
