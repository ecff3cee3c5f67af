"""The whole way from elements to coarse chunks and their evaluation, lazily."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import evaluate, sections, segment, vectors

DIM = 32


def structural(elements: DataFrame, least: int = 10_240) -> DataFrame:
    """Structural chunks, with the headings that extraction has missed in chunks of so many characters."""
    return sections.split_missed_headings(sections.structural_chunks(elements), least)


def units(chunks: DataFrame, dim: int = DIM) -> DataFrame:
    """Structural chunks as units of segmentation, with the embeddings of their sentences pooled."""
    carried = ["heading", "heading_path", "pages", "contains_table", "text"]
    return chunks.select("doc_id", F.col("id").alias("k"), vectors.pooled_vector(F.col("text"), dim).alias("vector"), "n_chars", F.substring_index("number", ".", 1).alias("major"), *carried)


def solved(elements: DataFrame, least: int = 10_240) -> DataFrame:
    """Segmentation of documents of elements."""
    return segment.solved(units(structural(elements, least)))


def coarse(elements: DataFrame, least: int = 10_240) -> DataFrame:
    """Coarse chunks of documents of elements."""
    return segment.coarse_chunks(solved(elements, least))


def report(fine: DataFrame, strategies: dict[str, DataFrame | None], dim: int = DIM) -> DataFrame:
    """The report on every strategy's chunks (doc_id, id, text, n_chars and, of coarse ones, structural_ids); a strategy without chunks has an error.

    Queries are the headings of the structural chunks `fine`.
    """
    asked = evaluate.queries(fine).withColumn("qv", vectors.hashed_vector(F.col("query"), dim))
    out = []
    for name, chunks in strategies.items():
        if chunks is None:
            out.append(evaluate.missing_strategy(asked, name))
            continue
        each = chunks.select("doc_id", "id", F.explode(T.sentences(F.col("text"))).alias("sentence"))
        said = each.select("doc_id", "id", vectors.hashed_vector(F.col("sentence"), dim).alias("vector"))
        known = evaluate.covered(chunks).withColumn("v", vectors.pooled_vector(F.col("text"), dim))
        out.append(evaluate.strategy(name, known, said, asked))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


_MEASURES = [(n, pa.int64()) if k == "bigint" else (n, pa.float64()) for n, k in (m.split(" ") for m in evaluate.MEASURES.split(", ")[:-1])]
_MEASURES += [("sample", pa.list_(pa.struct([("gt_sid", pa.int64()), ("q", pa.string()), ("first_rel_rank", pa.int32())])))]


def _compared(names: tuple[str, str], dim: int):
    """Rows of the report on the structural and the coarse chunks of documents (doc_id, target, c: id, n_chars, major, heading, said)."""

    def strategies(ids, n_chars, crossing, target, heads, said, n_said):
        asked = [i for i, h in enumerate(heads) if h is not None and len(h) >= evaluate.LEAST_HEADING]
        own, query = np.array(asked, dtype=np.int64), [heads[i] for i in asked]
        gt, qv = [int(ids[i]) for i in asked], vectors.hashed_array(query, dim)
        v = vectors.unit_rows(vectors.sum_rows(said, n_said))
        yield names[0], evaluate.measured(n_chars, v, said, n_said, own, gt, query, qv)
        if n_chars.sum() > 0:
            starts = np.array(segment.solve(v, n_chars.astype(float), crossing, target)[0])
            size, held = np.diff(np.append(starts, len(ids))), np.add.reduceat(n_said, starts)
            chars = np.add.reduceat(n_chars, starts) + 2 * (size - 1)
            v = vectors.unit_rows(vectors.sum_rows(said, held))
            yield names[1], evaluate.measured(chars, v, said, held, np.searchsorted(starts, own, side="right") - 1, gt, query, qv)

    def run(batches):
        for batch in batches:
            chunks = batch.column(2).flatten()
            ids, n_chars, major, heads, texts = chunks.flatten()
            edge = batch.column(2).offsets.to_numpy() - batch.column(2).offsets[0].as_py()
            ids, n_chars, n_said = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (ids, n_chars, pc.list_value_length(texts)))
            major, heads, texts, said_edge = major.to_pylist(), heads.to_pylist(), texts.flatten(), np.append(0, np.cumsum(n_said))
            crossing = np.array([a is not None and b is not None and a != b for a, b in zip([None, *major], major, strict=False)], dtype=np.int64)
            found = {"doc_id": [], "rows": []}
            for i, (first, last) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                at, changes = slice(first, last), crossing[first:last].copy()
                changes[:1] = 0
                begin, end = int(said_edge[first]), int(said_edge[last])
                said = vectors.hashed_array(texts.slice(begin, end - begin).to_pylist(), dim)
                for name, told in strategies(ids[at], n_chars[at], changes, batch.column(1)[i].as_py(), heads[at], said, n_said[at]):
                    found["doc_id"].append(i)
                    found["rows"].append({"strategy": name} | told)
            rows = pa.RecordBatch.from_pylist(found["rows"], schema=pa.schema([("strategy", pa.string()), *_MEASURES]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found["doc_id"], pa.int64())), *rows.columns], names=["doc_id", *rows.schema.names])

    return run


def whole_report(elements: DataFrame, names: tuple[str, str, str], least: int = 10_240, dim: int = DIM) -> DataFrame:
    """report() on the structural chunks of documents of elements, on their coarse chunks and on a strategy without chunks, under these names.

    A document's chunks meet in one row and go through one Arrow UDF, so nothing is made or shuffled twice; queries meet
    the chunks of their document in blocks. A coarse chunk has the sentences of its units, as texts of structural chunks
    have no white space at their ends and blank lines end a sentence. Elements without a doc_id are no document's, as in
    report().
    """
    # pages are not told, and the join with the outline drops null ids on its side: with both sides alike, dealt elements are used twice
    known = elements.where("doc_id IS NOT NULL").select("doc_id", "idx", F.lit(None).cast("int").alias("page"), "type", "text")
    fine = structural(known, least)
    own = F.struct("id", "n_chars", F.substring_index("number", ".", 1).alias("major"), "heading", F.coalesce(T.sentences(F.col("text")), F.array().cast("array<string>")).alias("said"))
    rows = fine.groupBy("doc_id").agg(F.array_sort(F.collect_list(own)).alias("c"), F.sum("n_chars").alias("total"))
    rows = rows.select("doc_id", (F.col("total") / segment.target_k(F.col("total"))).alias("target"), "c")
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = evaluate.told(rows.mapInArrow(_compared(names[:2], dim), f"doc_id {kind}, strategy string, {evaluate.MEASURES}")).withColumn("_error", F.lit(None).cast("string"))
    # one pass more only adds rows: that of the missing strategy stands beside the first one
    none = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in found.columns[2:-1]]
    missing = F.struct("doc_id", F.lit(names[2]).alias("strategy"), *none, F.lit(f"missing {names[2]}").alias("_error"))
    asked = (F.col("strategy") == names[0]) & (F.col("n_queries") > 0)
    each = F.when(asked, F.array(F.struct(*found.columns), missing)).otherwise(F.array(F.struct(*found.columns)))
    return found.select(F.inline(each))


def sentence_sizes(docs: DataFrame) -> DataFrame:
    """Size statistics of the sentences of each document's lines, by language."""
    lines = docs.select("lang", F.explode(T.sentences(F.col("text"))).alias("s")).select("lang", F.length("s").alias("n_chars"))
    return evaluate.size_stats(lines, ["lang"], "n_chars")
