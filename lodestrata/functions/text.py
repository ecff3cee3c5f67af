"""Text expressions of the document operators; all are Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns. White space is Unicode's and the four separators U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]"
NUMBER = rf"(?U)^{SPACE}*(\d+(?:\.\d+)*)\.?{SPACE}+"
LIST_MARKER = rf"(?U)^{SPACE}*(?:[•·\-*◦▪▫‣⁃]|\d+[.)]|\([a-z0-9]+\)|[ivx]+\.){SPACE}+[A-Za-z0-9]"
SENTENCE_END = rf"(?U)(?<=[.?!]){SPACE}+(?=[A-Z0-9\"'(])|\n{{2,}}"
MISSED_HEADING = rf"^{SPACE}*(\d+(?:\.\d+){{0,3}})\.?{SPACE}+([A-Z][A-Za-z0-9][^.\n|]{{1,120}}?)\.{SPACE}"
INTEGER = rf"(?U)^{SPACE}*[+-]?\d+(?:_\d+)*{SPACE}*\z"


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value worked out once however often it is used: higher-order functions don't share expressions."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def strip(text: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def collapse(text: Column) -> Column:
    """Stripped, with every run of white space as one space."""
    return F.regexp_replace(strip(text), rf"(?U){SPACE}+", " ")


def to_int(text: Column) -> Column:
    """The whole number that a text says, or null where it says none: "3.5" and "x" give null."""
    return F.when(text.rlike(INTEGER), F.replace(strip(text), F.lit("_"), F.lit("")).try_cast("long"))


def heading_number(text: Column) -> Column:
    """The leading number of a heading, or null."""
    found = F.regexp_extract(text, NUMBER, 1)
    return F.when(found != "", found)


def number_level(number: Column) -> Column:
    return F.size(F.split(number, r"\.")).cast("int")


def is_list_item(text: Column) -> Column:
    return text.rlike(LIST_MARKER)


def is_contents_table(text: Column) -> Column:
    """Tables with more dots than letters and digits are tables of contents."""
    dots = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    solid = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    return (dots > 0) & (dots > solid)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(strip(text), SENTENCE_END), strip), lambda s: s != "")


def missed_headings(text: Column) -> Column:
    """The text cut before every line that begins like a numbered heading; pieces are not stripped."""
    return F.split(text, f"(?Udm)(?={MISSED_HEADING})")


def missed_heading(piece: Column) -> tuple[Column, Column]:
    """Number and title that a piece begins with; null where it doesn't begin like a heading."""
    number, title = (F.regexp_extract(piece, rf"(?Ud)\A{MISSED_HEADING[1:]}", i) for i in (1, 2))
    return F.when(number != "", number), F.when(number != "", strip(title))


def safe_name(text: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    name = F.substring(name, 1, 50)
    return F.when(name == "", F.lit("chunk")).otherwise(name)


def short_number(value: Column) -> Column:
    """A number of four places without trailing zeros, but with one place at least."""
    return F.regexp_replace(F.format_string("%.4f", value), r"(\.\d+?)0+$", "$1")
