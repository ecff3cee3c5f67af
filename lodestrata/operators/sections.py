"""Sections and structural chunks of ordered elements (doc_id, idx, page, type, text and, of tables, n_rows and n_cols).

All windows and groupings run within doc_id, so elements that are dealt by document once need no other shuffle. Texts are
taken without white space at their ends; a null text counts as empty. Section 0 is the document itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T

from .elements import HEADER, ITEM, TABLE

_RUN = 64
_STACK = "array<struct<level:int,section_id:int,path:array<int>,heading_path:string>>"
_SECTION = "array<struct<section_id:int,idx:int,page:int,number:string,text:string,level:int,parent_id:int,path:array<int>,heading_path:string>>"


def _order():
    return Window.partitionBy("doc_id").orderBy("idx")


def _clean(elements: DataFrame) -> DataFrame:
    tables = [F.col(c).cast("int").alias(c) if c in elements.columns else F.lit(None).cast("int").alias(c) for c in ("n_rows", "n_cols")]
    return elements.select("doc_id", "idx", "page", "type", T.strip(F.coalesce("text", F.lit(""))).alias("text"), *tables)


def _nested(h: Column) -> Column:
    """The sections of a document's headings (idx, page, number, text, own), in order.

    A fold keeps the stack of open sections. A heading without a number lies below what stands before it; sections of
    lower level than a heading are its ancestors. The fold runs over slices of the headings, so that what it has made is
    not copied for each of them.
    """

    def step(a: Column, x: Column) -> Column:
        def below(above: Column, level: Column) -> Column:
            top = F.try_element_at(above, F.lit(-1))
            number = a["n"] + F.size(a["out"]) + 1
            path = F.concat(F.coalesce(top["path"], F.array().cast("array<int>")), F.array(number))
            fields = [number.alias("section_id"), *[x[c].alias(c) for c in ("idx", "page", "number", "text")], level.alias("level")]
            made = F.struct(*fields, F.coalesce(top["section_id"], F.lit(0)).alias("parent_id"), path.alias("path"), F.concat_ws(" > ", top["heading_path"], x["text"]).alias("heading_path"))
            own = lambda m: F.struct(*[m[c].alias(c) for c in ("level", "section_id", "path", "heading_path")])
            return T.let(made, lambda m: F.struct(F.concat(above, F.array(own(m))).alias("stack"), a["n"].alias("n"), F.concat(a["out"], F.array(m)).alias("out")))

        before = F.coalesce(F.try_element_at(a["stack"], F.lit(-1))["level"], F.lit(0))
        return T.let(F.coalesce(x["own"], before + 1), lambda level: T.let(F.filter(a["stack"], lambda s: s["level"] < level), lambda above: below(above, level)))

    def run(a: Column, first: Column) -> Column:
        begin = F.struct(a["stack"].alias("stack"), first.alias("n"), F.array().cast(_SECTION).alias("out"))
        done = F.aggregate(F.slice(h, first + 1, F.lit(_RUN)), begin, step)
        return T.let(done, lambda d: F.struct(d["stack"].alias("stack"), F.concat(a["out"], F.array(d["out"])).alias("out")))

    begin = F.struct(F.array().cast(_STACK).alias("stack"), F.array().cast(f"array<{_SECTION}>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(h) - 1, F.lit(_RUN)), begin, run, lambda a: F.flatten(a["out"]))


def _outline(elements: DataFrame) -> DataFrame:
    """doc_id and the array of its sections; documents without headings are absent."""
    number = T.heading_number(F.col("text"))
    rows = _clean(elements).where(F.col("type") == HEADER).select("doc_id", F.col("idx").cast("int").alias("idx"), F.col("page").cast("int").alias("page"), "text", number.alias("number"))
    heading = F.struct("idx", "page", "text", "number", T.number_level(F.col("number")).alias("own"))
    per = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(heading)).alias("h"))
    return per.select("doc_id", _nested(F.col("h")).alias("sections"))


def sections(elements: DataFrame) -> DataFrame:
    """Headings with section_id, number, level, parent, path and heading_path."""
    return _outline(elements).select("doc_id", F.inline("sections"))


def placed(elements: DataFrame) -> DataFrame:
    """Elements that count for chunks, with the section they stand in; contents tables and empty texts are gone."""
    table, head = F.col("type") == TABLE, F.col("type") == HEADER
    kept = _clean(elements).where(~(table & T.is_contents_table(F.col("text")))).where(table | head | (F.col("text") != ""))
    return kept.withColumn("section_id", F.sum(F.when(head, 1).otherwise(0)).over(_order()).cast("int"))


def structural_chunks(elements: DataFrame) -> DataFrame:
    """Runs of elements between headings and tables, in order; a table is a chunk of its own."""
    rows = placed(elements)
    head, table = F.col("type") == HEADER, F.col("type") == TABLE
    bound = F.when(head, F.lit("new_heading")).when(table, F.lit("before_table"))
    after = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    cut = F.when(head | table | F.coalesce(F.lag(table).over(_order()), F.lit(False)), 1).otherwise(0)
    rows = rows.withColumn("next", F.first(bound, ignorenulls=True).over(after)).withColumn("cut", cut)
    rows = rows.withColumn("run", F.sum("cut").over(_order())).where(~head)
    chunks = rows.groupBy("doc_id", "section_id", "run").agg(
        F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("o"),
        F.array_sort(F.collect_set("page")).alias("pages"),
        F.max(table).alias("contains_table"),
        F.first("next").alias("next"),
        F.min("idx").alias("first"),
        F.max("n_rows").alias("n_rows"),
        F.max("n_cols").alias("n_cols"),
    )
    reason = F.when(F.col("contains_table"), F.lit("table_atomic")).otherwise(F.coalesce("next", F.lit("end")))
    text = F.array_join(F.transform("o", lambda x: x["text"]), "\n\n")
    # the outline is one row for each document, and a chunk takes its own section out of it
    own = F.get("sections", F.col("section_id") - 1)
    named = [("number", "number"), ("text", "heading"), ("level", "heading_level"), ("heading_path", "heading_path")]
    out = chunks.join(_outline(elements), "doc_id", "left")
    return out.select(
        "doc_id",
        (F.row_number().over(Window.partitionBy("doc_id").orderBy("first")) - 1).alias("id"),
        F.lit("structural").alias("strategy"),
        "section_id",
        *[(F.coalesce(own[c], F.lit(0 if c == "level" else "")) if c in ("level", "heading_path") else own[c]).alias(a) for c, a in named],
        "pages",
        F.transform("o", lambda x: x["idx"]).alias("element_idxs"),
        F.length(text).alias("n_chars"),
        text.alias("text"),
        "contains_table",
        F.when(F.col("contains_table"), F.col("n_rows")).alias("n_rows"),
        F.when(F.col("contains_table"), F.col("n_cols")).alias("n_cols"),
        reason.alias("flush_reason"),
    )


def split_missed_headings(chunks: DataFrame, least: int = 10_240) -> DataFrame:
    """Chunks of text of at least so many characters cut where a line begins like a numbered heading; all are renumbered.

    What stands before the first such line stays under the chunk's own heading; the other pieces get the heading they
    begin with, one level below the chunk's. Every other column stays.
    """
    whole = F.struct(F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("title"), F.col("text").alias("text"), F.lit(None).cast("string").alias("reason"))

    def piece(raw: Column) -> Column:
        number, title = T.missed_heading(raw)
        reason = F.when(number.isNotNull(), "post_split_missed_heading").otherwise("post_split_preamble")
        return F.struct(number.alias("number"), title.alias("title"), T.strip(raw).alias("text"), reason.alias("reason"))

    large = (F.length("text") >= least) & ~F.coalesce("contains_table", F.lit(False)) & F.col("text").rlike(f"(?Udm){T.MISSED_HEADING}")
    pieces = F.filter(F.transform(T.missed_headings(F.col("text")), piece), lambda p: p["text"] != "")
    rows = chunks.withColumn("__pieces", F.when(large, pieces).otherwise(F.array(whole)))
    rows = rows.select(*[c for c in rows.columns if c != "__pieces"], F.posexplode("__pieces").alias("__at", "__p"))
    p, found = F.col("__p"), F.col("__p.number").isNotNull()
    heading = F.concat_ws(" ", p["number"], p["title"])
    base = F.coalesce(F.expr("nullif(heading_path, '')"), F.expr("nullif(heading, '')"))
    new = {
        "id": F.row_number().over(Window.partitionBy("doc_id").orderBy("id", "__at")) - 1,
        "number": F.when(found, p["number"]).otherwise(F.col("number")),
        "heading": F.when(found, heading).otherwise(F.col("heading")),
        "heading_path": F.when(found, F.concat_ws(" > ", base, heading)).otherwise(F.col("heading_path")),
        "heading_level": F.when(found, F.when(F.coalesce("heading_level", F.lit(0)) == 0, 1).otherwise(F.col("heading_level")) + 1).otherwise(F.col("heading_level")),
        "text": p["text"],
        "n_chars": F.length(p["text"]),
        "flush_reason": F.coalesce(p["reason"], F.col("flush_reason")),
    }
    return rows.select(*[(new.get(c, F.col(c))).alias(c) for c in chunks.columns])


def section_tree(elements: DataFrame) -> DataFrame:
    """Every section, the document itself (section 0) too: own and total characters, pages of its subtree, what stands in it.

    paragraphs, lists and tables hold the elements that stand directly in a section; pictures and the like are paragraphs.
    A document without headings has section 0 alone.
    """
    rows = placed(elements)
    head = F.col("type") == HEADER
    typed = lambda test, *more: F.array_sort(F.collect_list(F.when(test, F.struct("idx", "page", *more, "text"))))
    own = rows.groupBy("doc_id", "section_id").agg(
        F.coalesce(F.sum(F.when(~head, F.length("text"))), F.lit(0)).alias("n_chars_self"),
        F.collect_set("page").alias("own_pages"),
        typed(~head & ~F.col("type").isin(ITEM, TABLE)).alias("paragraphs"),
        typed(F.col("type") == ITEM).alias("lists"),
        typed(F.col("type") == TABLE, "n_rows", "n_cols").alias("tables"),
    )
    # section 0 has no row of its own where nothing stands before the first heading
    each = sections(elements).select("doc_id", "section_id", "parent_id", "number", "text", "level", "path")
    top = elements.select("doc_id").distinct().select("doc_id", F.lit(0).alias("section_id"), F.lit(None).cast("int").alias("parent_id"), F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("level"), F.array().cast("array<int>").alias("path"))
    all_ = each.unionByName(top).join(own, ["doc_id", "section_id"], "left").withColumn("n_chars_self", F.coalesce("n_chars_self", F.lit(0)))
    none = F.array().cast("array<int>")
    up = all_.select("doc_id", F.explode(F.concat(F.array(F.lit(0)), "path")).alias("section_id"), "n_chars_self", F.coalesce("own_pages", none).alias("p"))
    total = up.groupBy("doc_id", "section_id").agg(F.sum("n_chars_self").alias("n_chars_total"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("p")))).alias("pages"))
    return all_.drop("own_pages").join(total, ["doc_id", "section_id"])


def summary(tree: DataFrame) -> DataFrame:
    """Title (the first top section), sections and pages of each document of section_tree."""
    title = F.min_by("text", F.when(F.col("parent_id") == 0, F.col("section_id")))
    root = F.col("section_id") == 0
    return tree.groupBy("doc_id").agg(title.alias("title"), (F.count(F.lit(1)) - 1).alias("n_sections"), F.max(F.when(root, F.size("pages"))).alias("n_pages"), F.max(F.when(root, F.col("n_chars_total"))).alias("tree_chars"))


def structural_stats(chunks: DataFrame, tree: DataFrame) -> DataFrame:
    """Sizes of a document's chunks beside its sections and the characters of its tree; a document without chunks has zeros."""
    sizes = chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.count_if("contains_table").alias("n_tables"), F.count_if(F.col("n_chars") > 1200).alias("n_large"), F.sum("n_chars").alias("chars"),
        F.bround(F.avg("n_chars"), 1).alias("mean_chars"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"))
    rows = summary(tree).select("doc_id", "n_sections", "tree_chars").join(sizes, "doc_id", "left")
    return rows.select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in sizes.columns[1:]], "n_sections", "tree_chars")
