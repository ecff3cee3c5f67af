"""Queries on the quality of chunks and the data of figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import elements as E
from lodestrata.operators import evaluate, segment, vectors
from lodestrata.plans import coarse

from .elements import LINES
from .inputs import UNITS, documents, elements, table, units
from .registry import query
from .sections import CHUNKS, SENTENCES
from .segments import COSTS


def _sizes(by: str, rows: str) -> str:
    return f"""SELECT {by}, count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std, min(n_chars) AS least, round(quantile_cont(n_chars, 0.1), 6) AS p10,
  round(quantile_cont(n_chars, 0.5), 6) AS median, round(quantile_cont(n_chars, 0.9), 6) AS p90, max(n_chars) AS most FROM {rows} GROUP BY {by}"""


@query(_sizes("lang", "documents"))
def size_stats(s, d):
    return evaluate.size_stats(documents(s, d), ["lang"], "n_chars")


@query(f"WITH x AS (SELECT lang, unnest({SENTENCES}) AS s FROM documents), y AS (SELECT lang, length(s)::INT AS n_chars FROM x) {_sizes('lang', 'y')}")
def sentence_size_stats(s, d):
    return coarse.sentence_sizes(documents(s, d))


# every ninth group keeps one unit, so that groups without pairs are there
_FEW = f"WITH {UNITS}, few AS (SELECT * FROM units WHERE doc_id % 9 <> 0 OR k % 50 = 0)"


def _few(s, d):
    return units(s, d).where("doc_id % 9 <> 0 OR k % 50 = 0")


@query(f"""{_FEW}, x AS (SELECT doc_id, major, k, generate_subscripts(vector, 1) AS d, unnest(vector)::DOUBLE AS x FROM few),
s AS (SELECT doc_id, major, d, sum(x) AS s, count(*) AS n FROM x GROUP BY ALL), p AS (SELECT doc_id, major, CASE WHEN n > 1 THEN (sum(s * s) - n) / (n * (n - 1)) END AS m FROM s GROUP BY doc_id, major, n)
SELECT doc_id, round(coalesce(avg(m), 0), 6) AS coherence FROM p GROUP BY doc_id""")
def intra_coherence(s, d):
    return evaluate.intra_coherence(_few(s, d), ["doc_id", "major"], "vector").select("doc_id", F.round("coherence", 6).alias("coherence"))


_ADJ = f"{_FEW}, adj AS (SELECT doc_id, k, list_dot_product(vector::DOUBLE[], lead(vector) OVER (PARTITION BY doc_id ORDER BY k)::DOUBLE[]) AS c FROM few)"


@query(f"{_ADJ} SELECT doc_id, round(coalesce(avg(c), 0), 6) AS similarity FROM adj GROUP BY doc_id")
def inter_adjacent(s, d):
    return evaluate.inter_adjacent(_few(s, d), "doc_id", "k", "vector").select("doc_id", F.round("similarity", 6).alias("similarity"))


@query(f"""{_ADJ}, x AS (SELECT doc_id, k, round(1 - c, 6) AS distance FROM adj WHERE c IS NOT NULL), q AS (SELECT doc_id, quantile_cont(distance, 0.9) AS t FROM x GROUP BY doc_id)
SELECT doc_id, k, distance FROM x JOIN q USING (doc_id) WHERE distance >= t - 1e-9""")
def adjacent_peaks(s, d):
    return evaluate.peaks(_few(s, d), "doc_id", "k", "vector")


_RANKED = f"""WITH {UNITS}, rk AS (
  SELECT a.doc_id, a.k AS qid, b.k AS id, a.major AS want, b.major, row_number() OVER (PARTITION BY a.doc_id, a.k ORDER BY round(list_dot_product(a.vector::DOUBLE[], b.vector::DOUBLE[]), 9) DESC, b.k)::INT AS rank
  FROM units a JOIN units b ON a.doc_id = b.doc_id
), fr AS (SELECT doc_id, qid, min(rank) FILTER (major = want AND id <> qid) AS first_rank FROM rk GROUP BY ALL)"""


def _asked(s, d):
    """Every unit asks; a unit of the same major section, but itself, is relevant."""
    u = units(s, d)
    return u.select("doc_id", F.col("k").alias("qid"), F.col("vector").alias("qv"), F.col("major").alias("want")), u.select("doc_id", F.col("k").alias("id"), F.col("vector").alias("v"), "major")


def _first(s, d):
    asked, chunks = _asked(s, d)
    return evaluate.first_relevant(asked, chunks, "doc_id", lambda c: (c["major"] == F.col("want")) & (c["id"] != F.col("qid")))


@query(f"{_RANKED} SELECT doc_id, qid, id, rank FROM rk")
def retrieval_rank(s, d):
    return evaluate.ranks(*_asked(s, d), "doc_id").select("doc_id", "qid", "id", "rank")


@query(f"{_RANKED} SELECT doc_id, qid, first_rank FROM fr")
def first_relevant(s, d):
    return _first(s, d).select("doc_id", "qid", "first_rank")


_RECALL = ", ".join(f"round_even(avg(coalesce(first_rank <= {k}, false)::INT), 3) AS recall_{k}" for k in (1, 3, 5))


@query(f"{_RANKED} SELECT doc_id, count(*) AS n_queries, {_RECALL} FROM fr GROUP BY doc_id")
def recall_at_k(s, d):
    return evaluate.recall(_first(s, d), ["doc_id"])


@query(f"WITH RECURSIVE {CHUNKS} SELECT doc_id, heading AS query, id::INT AS gt FROM chunks WHERE length(heading) >= 4")
def heading_queries(s, d):
    return evaluate.queries(coarse.structural(elements(s, d)))


@query(f"""WITH RECURSIVE {UNITS}, {COSTS} SELECT 'coarse' AS strategy, doc_id, id::BIGINT AS id, structural_ids AS covers FROM cc
UNION ALL SELECT 'fine', doc_id, k, (k // 2)::VARCHAR FROM units WHERE k % 3 = 0 UNION ALL SELECT 'structural', doc_id, k, k::VARCHAR FROM units""")
def coverage(s, d):
    u = units(s, d)
    told = [("coarse", segment.coarse_chunks(segment.solved(u)))]
    told.append(("fine", u.where("k % 3 = 0").select("doc_id", F.col("k").alias("id"), F.floor(F.col("k") / 2).alias("parent_structural_id"))))
    told.append(("structural", u.select("doc_id", F.col("k").alias("id"))))
    parts = [evaluate.covered(c).select(F.lit(n).alias("strategy"), "doc_id", F.col("id").cast("long").alias("id"), F.array_join("covers", ",").alias("covers")) for n, c in told]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _strategy(name: str) -> str:
    return f"""SELECT '{name}' AS strategy, z.*, round_even(coalesce(i.coherence, 0), 4) AS coherence, round_even(a.similarity, 4) AS similarity, coalesce(r.n_queries, 0) AS n_queries,
  coalesce(recall_1, 0.0) AS recall_1, coalesce(recall_3, 0.0) AS recall_3, coalesce(recall_5, 0.0) AS recall_5, sample
FROM (SELECT * FROM ({_sizes('doc_id', f'{name}_c')})) z
LEFT JOIN (SELECT doc_id, avg(m) AS coherence FROM (SELECT doc_id, id, CASE WHEN n > 1 THEN (sum(s * s) - n) / (n * (n - 1)) END AS m FROM
  (SELECT doc_id, id, d, sum(x) AS s, count(*) AS n FROM {name}_x GROUP BY ALL) GROUP BY doc_id, id, n) GROUP BY doc_id) i USING (doc_id)
JOIN (SELECT doc_id, coalesce(avg(c), 0) AS similarity FROM (SELECT doc_id, list_dot_product(v, lead(v) OVER (PARTITION BY doc_id ORDER BY id)) AS c FROM {name}_c) GROUP BY doc_id) a USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_queries, {_RECALL}, string_agg(gt || ':' || coalesce((first_rank - 1)::VARCHAR, 'none') || ':' || query, '|' ORDER BY gt) FILTER (o <= 5) AS sample
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY gt) AS o FROM (
    SELECT doc_id, gt, any_value(query) AS query, min(rank) FILTER (list_contains(covers, gt)) AS first_rank FROM (
      SELECT q.doc_id, gt, query, covers, row_number() OVER (PARTITION BY q.doc_id, gt ORDER BY round(list_dot_product(qv, v), 9) DESC, id) AS rank FROM asked q JOIN {name}_c c ON c.doc_id = q.doc_id
    ) GROUP BY doc_id, gt)) GROUP BY doc_id) r USING (doc_id)"""


@query(f"""WITH RECURSIVE {UNITS}, {COSTS}, asked AS (
  SELECT doc_id, k AS gt, substr(heading, 1, 60) AS query, vector::DOUBLE[] AS qv FROM units WHERE length(heading) >= 4
), structural_c AS (
  SELECT doc_id, k AS id, n_chars, vector::DOUBLE[] AS v, [k] AS covers FROM units
), structural_x AS (
  SELECT doc_id, id, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM structural_c
), coarse_x AS (
  SELECT doc_id, id, generate_subscripts(vector, 1) AS d, unnest(vector)::DOUBLE AS x FROM cd
), coarse_s AS (
  SELECT doc_id, id, list(s ORDER BY d) AS s, sqrt(sum(s * s)) AS norm FROM (SELECT doc_id, id, d, sum(x) AS s FROM coarse_x GROUP BY ALL) GROUP BY ALL
), coarse_k AS (
  SELECT doc_id, id, list(k ORDER BY k) AS covers FROM cd GROUP BY ALL
), coarse_c AS (
  SELECT doc_id, id, n_chars, list_transform(s, lambda x: x / norm) AS v, covers FROM cc JOIN coarse_s USING (doc_id, id) JOIN coarse_k USING (doc_id, id)
) {_strategy('structural')} UNION ALL {_strategy('coarse')}""")
def strategy_report(s, d):
    u = units(s, d)
    asked = evaluate.queries(u.withColumnRenamed("k", "id")).join(u.select("doc_id", F.col("k").alias("gt"), F.col("vector").alias("qv")), ["doc_id", "gt"])
    fine = u.select("doc_id", F.col("k").alias("id"), "n_chars", F.col("vector").alias("v"))
    found = segment.coarse_chunks(segment.solved(u))
    members = found.select("doc_id", "id", F.explode("structural_ids").alias("k")).join(u.select("doc_id", "k", "vector"), ["doc_id", "k"])
    pooled = vectors.mean_pool(members, ["doc_id", "id"], "vector").withColumnRenamed("centroid", "v")
    rows = evaluate.strategy("structural", evaluate.covered(fine), fine.select("doc_id", "id", F.col("v").alias("vector")), asked)
    rows = rows.unionByName(evaluate.strategy("coarse", evaluate.covered(found.join(pooled, ["doc_id", "id"])), members, asked)).drop("_error")
    told = F.transform("sample", lambda x: F.concat_ws(":", x["gt_sid"].cast("string"), F.coalesce(x["first_rel_rank"].cast("string"), F.lit("none")), x["q"]))
    return rows.withColumn("sample", F.array_join(told, "|"))


@query()
def coarse_report(s, d):
    """The report over the whole way, with a strategy that has no chunks; tests hold it against a plain restatement."""
    return coarse.whole_report(elements(s, d), ("structural", "semantic_coarse", "semantic_fine"))


@query("""WITH e AS (SELECT lang, min(n_chars) AS low, (max(n_chars) - min(n_chars)) / 20.0::DOUBLE AS w FROM documents GROUP BY lang)
SELECT lang, (CASE WHEN w > 0 THEN least(19, floor((n_chars - low) / w)) ELSE 0 END)::INT AS bin, count(*) AS n FROM documents JOIN e USING (lang) GROUP BY ALL""")
def size_histogram(s, d):
    return evaluate.histogram(documents(s, d), "lang", "n_chars")


@query(f"""WITH {LINES}, x AS (SELECT doc_id, idx, {SENTENCES} AS s FROM el), y AS (SELECT doc_id, idx::INT AS chunk, (generate_subscripts(s, 1) - 1)::INT AS p FROM x)
SELECT doc_id, chunk, p, p = 0 AS opens, row_number() OVER (PARTITION BY doc_id ORDER BY chunk, p)::INT AS step FROM y QUALIFY count(*) OVER (PARTITION BY doc_id) >= 5""")
def sentence_trajectory(s, d):
    said = E.from_lines(documents(s, d)).select("doc_id", "idx", F.posexplode(T.sentences(F.col("text"))).alias("p", "s"))
    return evaluate.trajectory(said.select("doc_id", F.col("idx").alias("chunk"), "p"), "doc_id", ["chunk", "p"], F.col("p") == 0)


@query()
def pca_projection(s, d):
    """Two dimensions of the vectors: stands in for another projection, so there is nothing to compare it with."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = table(s, d, "embeddings").select("vec_id", array_to_vector("embedding").alias("v"))
    found = PCA(k=2, inputCol="v", outputCol="p").fit(rows).transform(rows).select("vec_id", vector_to_array("p").alias("p"))
    return found.select("vec_id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
