"""Queries on vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import vectors

from .inputs import UNITS, documents, table, units
from .registry import query
from .sections import SENTENCES

_KEY = "sha1(encode('model' || chr(0) || text))"


@query(f"SELECT doc_id, {_KEY} AS key FROM documents")
def embed_key(s, d):
    return documents(s, d).select("doc_id", vectors.cache_key("model", F.col("text")).alias("key"))


@query(f"SELECT DISTINCT {_KEY} AS key FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0)")
def cache_misses(s, d):
    keyed = documents(s, d).select("doc_id", vectors.cache_key("model", F.col("text")).alias("key"))
    return vectors.missing(keyed, keyed.where("doc_id % 3 = 0"))


_HASHED = r"""w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS w FROM documents),
c AS (SELECT doc_id, (('0x' || substr(md5(w), 1, 8))::BIGINT % 32)::INT AS b, count(*)::DOUBLE AS c FROM w WHERE w <> '' GROUP BY ALL),
v AS (SELECT doc_id, b, c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)) AS x FROM c)"""


@query(f"WITH {_HASHED} SELECT doc_id, b, round(x, 6) AS x FROM v")
def hashed_embedding(s, d):
    found = documents(s, d).select("doc_id", F.posexplode(vectors.hashed_vector(F.col("text"))).alias("b", "x"))
    return found.where("x <> 0").select("doc_id", "b", F.round("x", 6).alias("x"))


@query(f"""WITH {_HASHED}, known AS (SELECT DISTINCT text FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id, b, CASE WHEN text IN (SELECT text FROM known) THEN -1.0::DOUBLE ELSE round(x::FLOAT::DOUBLE, 5) END AS x
FROM documents JOIN v USING (doc_id) WHERE b < 4""")
def cached_encode(s, d):
    docs = documents(s, d).select("doc_id", "text")
    old = docs.where("doc_id % 3 = 0").select(vectors.cache_key("model", F.col("text")).alias("key"), "text").dropDuplicates(["key"])
    cache = old.select("key", F.transform(vectors.hashed_vector(F.col("text")), lambda x: F.when(x != 0, F.lit(-1.0)).otherwise(0.0)).cast("array<float>").alias("embedding"))
    rows, _ = vectors.cached_encode(docs, cache, "model", vectors.hashed_encoder())
    found = rows.select("doc_id", F.posexplode("embedding").alias("b", "x")).where("x <> 0 AND b < 4")
    return found.select("doc_id", "b", F.round(F.col("x").cast("double"), 5).alias("x"))


@query(rf"""WITH s AS (SELECT doc_id, {SENTENCES} AS s FROM documents), t AS (SELECT doc_id, unnest(s) AS t, generate_subscripts(s, 1) AS i FROM s),
w AS (SELECT doc_id, i, unnest(string_split_regex(lower(t), '[^a-z0-9]+')) AS w FROM t),
c AS (SELECT doc_id, i, (('0x' || substr(md5(w), 1, 8))::BIGINT % 32)::INT AS b, count(*)::DOUBLE AS c FROM w WHERE w <> '' GROUP BY ALL),
v AS (SELECT doc_id, b, sum(x) AS x FROM (SELECT doc_id, i, b, c / sqrt(sum(c * c) OVER (PARTITION BY doc_id, i)) AS x FROM c) GROUP BY ALL)
SELECT doc_id, b, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS x FROM v""")
def sentence_embedding(s, d):
    found = documents(s, d).select("doc_id", F.posexplode(vectors.pooled_vector(F.col("text"))).alias("b", "x"))
    return found.where("x <> 0").select("doc_id", "b", F.round("x", 6).alias("x"))


_DIMS = """dims AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS d, unnest(embedding)::DOUBLE AS x, vec_id FROM embeddings),
sums AS (SELECT label, d, sum(x) AS s FROM dims GROUP BY ALL)"""


@query(f"WITH {_DIMS} SELECT label, d::INT AS d, round(s / sqrt(sum(s * s) OVER (PARTITION BY label)), 6) AS x FROM sums")
def mean_pool(s, d):
    found = vectors.mean_pool(table(s, d, "embeddings"), ["label"], "embedding").select("label", F.posexplode("centroid").alias("d", "x"))
    return found.select("label", "d", F.round("x", 6).alias("x"))


@query(f"""WITH {_DIMS}, n AS (SELECT label, count(*) AS k FROM embeddings GROUP BY label)
SELECT label, k, round(CASE WHEN k > 1 THEN (sum(s * s) - k) / (k * (k - 1)) ELSE 1 END, 6) AS mean_cosine FROM sums JOIN n USING (label) GROUP BY label, k""")
def pairwise_cosine(s, d):
    return vectors.pairwise_mean(table(s, d, "embeddings"), ["label"], "embedding").select("label", "k", F.round("mean_cosine", 6).alias("mean_cosine"))


@query(f"""WITH {UNITS} SELECT a.doc_id, a.k AS i, b.k AS j, '#' || printf('%02d', a.k) || ' ' || substr(a.heading, 1, 30) AS label_i, '#' || printf('%02d', b.k) || ' ' || substr(b.heading, 1, 30) AS label_j,
  round(least(1.0, greatest(0.0, list_dot_product(a.vector::DOUBLE[], b.vector::DOUBLE[]))), 5) AS cosine FROM units a JOIN units b ON a.doc_id = b.doc_id""")
def similarity_matrix(s, d):
    found = vectors.similarity_matrix(units(s, d), "doc_id", "k", "vector", "heading")
    return found.withColumn("cosine", F.round("cosine", 5))
