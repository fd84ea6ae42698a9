"""Column expressions on text. White space means what Unicode calls white space, and U+001C to U+001F."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"(?U)[\s\x1c-\x1f]"
#: A header of an article at the start of a line, any white space around its number; flags: case-insensitive, Unicode, only \n ends a line.
HEADER = r"^[ \t]*(?:ART[ÍI]CULO|ART\.)[\s\x1c-\x1f]*(\d+)[\s\x1c-\x1f]*[°º]?[\s\x1c-\x1f]*[.\-–]"
HEADER_FLAGS = r"(?iumdU)"


def strip(c: Column) -> Column:
    """Without outer white space; null stays null."""
    return F.regexp_replace(c, rf"{WS}+\z|\A{WS}+", "")


def collapse(c: Column) -> Column:
    """Outer white space removed, inner runs as one blank; null stays null."""
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def normalize_text(c: Column) -> Column:
    """Lines stripped and collapsed; blank lines and lines with dot leaders (four dots or more) dropped.

    Null stays null; a text without any line left gives an empty text.
    """
    lines = F.transform(F.split(c, "\n"), lambda x: collapse(x))
    kept = F.filter(lines, lambda x: (x != "") & ~x.contains("...."))
    return F.when(c.isNotNull(), F.array_join(kept, "\n"))


def words(c: Column) -> Column:
    """Runs of letters and digits in lower case, in order; null gives an empty list."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def snippet(c: Column, n: int = 200) -> Column:
    """The first n characters of the collapsed text."""
    return F.substring(collapse(c), 1, n)


def citation_label(country: Column, norm: Column, article: Column) -> Column:
    """"{country} {norm} art. {article}"; the last part only where there is an article."""
    return F.concat_ws(" ", country, norm, F.when(article.isNotNull() & (article != ""), F.concat(F.lit("art. "), article)))


def chunk_id(country: Column, agency: Column, norm: Column, variant: Column, strategy: Column, idx: Column) -> Column:
    """{country}_{agency}_{norm}[_{variant}]#{strategy}#{idx}; null and empty variants are left out."""
    return F.concat_ws("#", F.concat_ws("_", country, agency, norm, F.when(variant != "", variant)), strategy, idx.cast("string"))
