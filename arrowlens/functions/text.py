"""Normal forms of names, JSON values and spans, as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Unicode white space and format marks that may stand around a value.
_OUTER = r"^[\s\p{Z}\x{FEFF}\x{200B}]+|[\s\p{Z}\x{FEFF}\x{200B}]+$"


def trim_blank(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, _OUTER, "")


def alnum_key(c: Column) -> Column:
    """Letters and digits only, in one letter case (lower of upper, so that ß and SS agree)."""
    return F.lower(F.upper(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")))


def plain_kind(c: Column) -> Column:
    """Letter case and outer blanks removed."""
    return F.lower(trim_blank(c))


def canonical_json(c: Column) -> Column:
    """One text for each JSON value whatever its layout and key order; null stays null.

    Keys come sorted, numbers as they read (1 and 1.0 agree; with an exponent they compare as doubles). A text that
    is no JSON, or repeats a key within one object, stands for itself without outer blanks, marked `raw:`.
    """
    parsed = F.to_json(F.try_parse_json(c))
    return F.when(c.isNotNull(), F.coalesce(parsed, F.concat(F.lit("raw:"), trim_blank(c))))


def span_numbers(c: Column) -> Column:
    """`startline:startcol-endline:endcol` with or without a path before it, leading zeros removed.

    Other text stands for itself without outer blanks; null stays null.
    """
    pattern = r"(?:^|:)\s*0*(\d+):0*(\d+)\s*-\s*0*(\d+):0*(\d+)\s*$"
    hit = F.regexp_extract(c, pattern, 1) != ""
    parts = [F.regexp_extract(c, pattern, i) for i in (1, 2, 3, 4)]
    return F.when(c.isNull(), None).when(hit, F.concat_ws(":", *parts)).otherwise(F.concat(F.lit("raw:"), trim_blank(c)))


def value_hash(c: Column) -> Column:
    """64-bit hash that tells null from every text; for comparing two values of one key, not for identifying rows."""
    return F.xxhash64(F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), c)))


def wide_hash(c: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes with different seeds: 128 bits that stand for a text in shuffles and distinct counts."""
    v = F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), c))
    return F.xxhash64(v), F.xxhash64(F.lit("second"), v)
