"""Elements: ordered rows (doc_id, idx, page, type, text) of documents, from lines, HTML or font spans."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Collection
from html.entities import html5

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lodestrata.functions import text as T

HEADER, ITEM, TEXT, TABLE = "SectionHeaderItem", "ListItem", "TextItem", "TableItem"


def from_lines(docs: DataFrame) -> DataFrame:
    """Non-blank lines of each document, numbered in order."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.col("text"), "\n")).alias("idx", "line"))
    return lines.select("doc_id", "idx", T.strip(F.col("line")).alias("text")).where("text <> ''")


_TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>|<[!?/][^<>]*+>""", re.S)
_KINDS = {"li": ITEM, "p": TEXT} | {f"h{i}": HEADER for i in range(1, 7)}
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form header hgroup html main menu nav ol pre section summary table tbody td tfoot th thead tr ul".split()) | {*_KINDS}
_HEADS = frozenset(f"h{i}" for i in range(1, 7))
_CELLS = frozenset("table thead tbody tfoot tr td th".split())
#: An opening tag ends the open elements on the right, looked for up to the nearest of the stops.
_ENDS = {"li": ({"li"}, _BLOCKS - {"li", "address", "div", "p"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr"}, {"table"})}
_ENDS |= {tag: ({"dd", "dt"}, _BLOCKS - {"dd", "dt", "address", "div", "p"}) for tag in ("dd", "dt")}


_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")


def _closed(text: str) -> str:
    """The text with those references decoded that a semicolon ends; others stay as they are written."""
    return _REFERENCE.sub(lambda m: entities.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


def html_texts(page: str | None, open_references: bool = True) -> list[tuple[str, str]]:
    """Type and text of every heading, list item and paragraph of a page, in order of their opening tags.

    Text belongs to the innermost of them that holds it, whatever tags stand between; an unclosed one ends where HTML
    ends it. References are decoded, those without a semicolon as in HTML (`&amp` is `&`) unless open_references is
    false; white space becomes one space; scripts, styles and comments are no text.
    """
    decode = entities.unescape if open_references else _closed
    found: list[tuple[str, list[str]]] = []
    stack: list[tuple[str, int]] = []  # open blocks, each with the place of the element its text belongs to
    page = page or ""
    at = 0

    n_open: Counter[str] = Counter()

    def say(text: str) -> None:
        if stack and stack[-1][1] >= 0:
            found[stack[-1][1]][1].append(text)

    def close(tags: Collection[str], stops: Collection[str]) -> None:
        """Ends the nearest open block of tags and all within it, unless one of stops is nearer."""
        if not any(map(n_open.__getitem__, tags)):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                n_open.subtract(t for t, _ in stack[i:])
                del stack[i:]
            if i == len(stack) or stack[i][0] in stops:
                return

    while True:
        m = _TOKEN.search(page, at)
        say(decode(page[at : m.start() if m else len(page)]))
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not m[1] and tag in ("script", "style", "textarea", "title"):
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I).search(page, at)
            if tag in ("textarea", "title"):
                say(decode(page[at : stop.start() if stop else len(page)]))
            at = stop.end() if stop else len(page)
        elif tag in ("br", "hr") or tag in _BLOCKS:
            say(" ")
            like = _HEADS if tag in _HEADS else {tag}
            if m[1]:
                if tag not in ("body", "html"):
                    close(like, {"table"} if tag in _CELLS else {"td", "th", "ul", "ol", "menu"} if tag == "li" else {"td", "th"})
            elif tag != "br":
                if stack and (stack[-1][0] == "p" or tag in _HEADS and stack[-1][0] in _HEADS):
                    close({stack[-1][0]}, ())
                if tag in _ENDS:
                    close(*_ENDS[tag])
                place = stack[-1][1] if stack else -1
                if tag in _KINDS:
                    place = len(found)
                    found.append((_KINDS[tag], []))
                if tag != "hr":
                    stack.append((tag, place))
                    n_open[tag] += 1
            say(" ")
    return [(kind, " ".join("".join(parts).split())) for kind, parts in found]


def from_html(pages: DataFrame, open_references: bool = True) -> DataFrame:
    """Headings, list items and paragraphs of each page, in order, with their whole text; empty ones are left out.

    open_references as in `html_texts`.
    """

    @F.pandas_udf(ArrayType(StructType([StructField("type", StringType()), StructField("text", StringType())])))
    def texts(pages: pd.Series) -> pd.Series:
        return pd.Series([[{"type": k, "text": t} for k, t in html_texts(p, open_references)] for p in pages], dtype=object)

    rows = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(texts(F.col("html"))).alias("idx", "e"))
    return rows.select("doc_id", "idx", "e.type", "e.text").where("text <> ''")


def type_counts(elements: DataFrame) -> DataFrame:
    return elements.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def extract_stats(elements: DataFrame) -> DataFrame:
    """Elements, pages, characters, characters of the joined text and counts by type (a map) of each document."""
    per = elements.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.collect_set("page").alias("pages"))
    out = per.groupBy("doc_id").agg(
        F.sum("n").alias("n_elements"),
        F.size(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("n_pages"),
        F.sum("chars").alias("chars"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("type_counts"),
    )
    return out.withColumn("markdown_chars", F.col("chars") + 2 * (F.col("n_elements") - 1))


def page_text_stats(pages: DataFrame) -> DataFrame:
    """Pages, characters of their joined text and mean of each document of pages (doc_id, page, text); null pages of text count as empty."""
    n = F.count(F.lit(1))
    chars = F.sum(F.length(F.coalesce("text", F.lit("")))) + 2 * (n - 1)
    return pages.groupBy("doc_id").agg(n.alias("n_pages"), chars.alias("total_chars"), F.bround(chars / n, 1).alias("mean_chars_per_page"))


def font_histogram(spans: DataFrame) -> DataFrame:
    """Characters by font size (rounded to 0.1) of a document's text spans."""
    size = F.bround("size", 1)
    found = spans.where("block_type = 0").groupBy("doc_id", size.alias("size"))
    return found.agg(F.sum(F.length("text")).alias("chars"), F.min("pos").alias("first")).where("size > 0")


def fonts(histogram: DataFrame) -> DataFrame:
    """One row for each document: body (the size of most characters; of equal ones, the first met) and heading_sizes.

    Heading sizes are the four largest sizes well above the body's that have five characters, largest first.
    """
    sizes = F.collect_list(F.struct("size", "chars"))
    per = histogram.groupBy("doc_id").agg(F.max_by("size", F.struct("chars", -F.col("first"))).alias("body"), sizes.alias("sizes"))
    large = F.transform(F.filter("sizes", lambda s: (s["size"] > F.col("body") * 1.05) & (s["chars"] >= 5)), lambda s: s["size"])
    return per.select("doc_id", "body", F.slice(F.sort_array(large, asc=False), 1, 4).alias("heading_sizes"))


def unreadable(spans: DataFrame) -> DataFrame:
    """Documents that have spans but no text of any size (scans, say), with the reason: they have no blocks."""
    has_text = F.max(F.when((F.col("block_type") == 0) & (F.bround("size", 1) > 0), 1).otherwise(0))
    return spans.groupBy("doc_id").agg(has_text.alias("readable")).where("readable = 0").select("doc_id", F.lit("no text").alias("reason"))


def blocks(spans: DataFrame) -> DataFrame:
    """Text, largest size and boldness of each block (doc_id, page, block); spans of a line meet without a space, lines with one."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line", F.coalesce("text", F.lit("")).alias("text"))))
    out = (
        spans.where("block_type = 0")
        .groupBy("doc_id", "page", "block")
        .agg(ordered.alias("o"), F.max(F.bround("size", 1)).alias("max_size"), F.max(F.col("flags").bitwiseAND(16) != 0).alias("bold"))
    )
    breaks = lambda i: (i > 0) & ~F.get(F.col("o"), i - 1)["line"].eqNullSafe(F.get(F.col("o"), i)["line"])
    parts = F.transform("o", lambda s, i: F.concat(F.when(breaks(i), F.lit(" ")).otherwise(F.lit("")), s["text"]))
    out = out.select("doc_id", "page", "block", T.collapse(F.array_join(parts, "")).alias("text"), "max_size", "bold", F.col("o")[0]["pos"].alias("first"))
    return out.where("text <> ''")


def classify(blocks_: DataFrame, fonts_: DataFrame) -> DataFrame:
    """Type and level of each block by font: exact size, then short bold text, then list markers."""
    rows = blocks_.join(fonts_, "doc_id")
    by_size = F.array_position("heading_sizes", F.col("max_size")).cast("int")
    short_bold = F.col("bold") & (F.length("text") <= 120) & (F.col("max_size") >= F.col("body"))
    level = F.when(by_size > 0, by_size).when(short_bold, F.greatest(F.lit(2), F.size("heading_sizes")) + 1).otherwise(F.lit(0))
    rows = rows.withColumn("level", level)
    kind = F.when((F.col("level") >= 1) & (F.length("text") <= 250), HEADER).when(T.is_list_item(F.col("text")), ITEM).otherwise(TEXT)
    return rows.select("doc_id", "page", "block", "first", "text", "max_size", "level", kind.alias("type"))


def from_spans(spans: DataFrame) -> DataFrame:
    """Elements (doc_id, idx, page, type, level, text, heading_level) of spans (doc_id, page, block, line, pos, block_type, size, flags, text).

    Spans are dealt by document once; the histogram, the blocks and the numbering all work on that. Documents without any
    text are not here but in `unreadable`.
    """
    dealt = spans.repartition("doc_id")
    rows = classify(blocks(dealt), fonts(font_histogram(dealt)))
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("first")) - 1
    heading_level = F.when(F.col("type") == HEADER, F.greatest("level", F.lit(1)))
    return rows.select("doc_id", idx.alias("idx"), "page", "type", F.lit(1).alias("level"), "text", heading_level.alias("heading_level"))


def parent_heading(elements: DataFrame) -> DataFrame:
    """Text of the last header before each element."""
    before = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return elements.withColumn("parent_heading", F.last(F.when(F.col("type") == HEADER, F.col("text")), ignorenulls=True).over(before))
