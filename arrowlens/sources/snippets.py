"""Pieces of source texts by spans of lines, all as column expressions on files (file, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_SPAN = r"^(?:(.*):)?(\d+):(\d+)-(\d+):(\d+)$"


def element_spans(elem: DataFrame) -> DataFrame:
    """(elem_id, file, start_line, end_line) of elements (id, module, span) whose span can be read; the file is the
    span's path or, without one, the module."""
    part = lambda i: F.regexp_extract("span", _SPAN, i)
    file = F.when(part(1) != "", part(1)).otherwise(F.col("module"))
    rows = elem.where(F.col("span").rlike(_SPAN)).select(F.col("id").alias("elem_id"), file.alias("file"), part(2).cast("int").alias("start_line"), part(4).cast("int").alias("end_line"))
    return rows.where("file IS NOT NULL")


def cut(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last (1-based) of a text, as far as it has them."""
    lines = F.split(text, "\n")
    return F.array_join(F.slice(lines, first, F.greatest(F.lit(0), F.least(F.size(lines), last) - first + 1)), "\n")


def snippet(files: DataFrame, spans: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """(elem_id, snippet): lines of the span (file, start_line, end_line) with some context."""
    first = F.greatest(F.lit(1), F.col("start_line") - before)
    have = F.size(F.split("text", "\n")) >= F.col("start_line")
    return spans.join(files, "file").where(have).select("elem_id", cut(F.col("text"), first, F.col("end_line") + after).alias("snippet"))


def focused(files: DataFrame, spans: DataFrame, most: int) -> DataFrame:
    """(elem_id, snippet): of spans longer than `most` lines the first half and the last, with a line `…` between."""
    half = most // 2
    n = F.col("end_line") - F.col("start_line") + 1
    whole = cut(F.col("text"), F.col("start_line"), F.col("end_line"))
    ends = F.concat_ws("\n", cut(F.col("text"), F.col("start_line"), F.col("start_line") + half - 1), F.lit("…"), cut(F.col("text"), F.col("end_line") - (most - half) + 1, F.col("end_line")))
    return spans.join(files, "file").where(F.size(F.split("text", "\n")) >= F.col("start_line")).select("elem_id", F.when(n <= most, whole).otherwise(ends).alias("snippet"))


def signature(snip: Column) -> Column:
    """Text before the first brace, semicolon or line end."""
    return F.trim(F.regexp_extract(snip, r"^[^{;\n]*", 0))


def body(snip: Column) -> Column:
    """What stands between the first brace and the last; null without braces."""
    inner = F.regexp_extract(snip, r"(?s)^[^{]*\{(.*)\}[^}]*$", 1)
    return F.when(snip.rlike(r"(?s)\{.*\}"), inner)


def import_block(text: Column) -> Column:
    """The import lines of a text (TypeScript imports, a Clojure ns form's first lines), as they stand."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*import\b|^\s*\(:?(require|import|ns)\b"))
    return F.array_join(lines, "\n")
