"""Registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from arrowlens.llm import copies, packing, quality, tokens
from arrowlens.llm.spread import dealt
from arrowlens.plans.data_queries import CANON
from arrowlens.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copy_pairs(table(spark, sf_dir, "olog_elem"))


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.collapse(table(spark, sf_dir, "olog_elem"))


def p2_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of copies of each record."""
    return p2_records(spark, sf_dir).select("id", "copies", "ids")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_documents(table(spark, sf_dir, "documents"))


def p8_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.document_sizes(table(spark, sf_dir, "documents"))
    return packing.pack(sizes, table(spark, sf_dir, "token_window"))


def p8_bins_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other rule: bins by weighted dot-product of item and residual."""
    sizes = tokens.document_sizes(table(spark, sf_dir, "documents"))
    return packing.pack(sizes, table(spark, sf_dir, "token_window"), rule="dot")


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts encoded and decoded again: (doc_id, tokens, same)."""
    ids = tokens.token_ids(F.col("text"))
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", ids.alias("ids"))
    return docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), (tokens.token_text(F.col("ids")) == F.coalesce("text", F.lit(""))).alias("same"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p8_bins(spark, sf_dir), table(spark, sf_dir, "token_window"))


def p9_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    common = quality.common_words(table(spark, sf_dir, "common_word"))
    return quality.with_form(quality.statistics(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")), common))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_stats(spark, sf_dir).where("form <> 'prose'").select("doc_id", "form")


def p9_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_stats(spark, sf_dir).select("doc_id", "n_chars", "n_words", "n_lines")


QUERIES = {"p2_found": p2_found, "p2_records": p2_records, "p2_copies": p2_copies, "p7_ids": p7_ids, "p8_bins": p8_bins, "p8_fill": p8_fill, "p8_bins_dot": p8_bins_dot, "p7_round_trip": p7_round_trip, "p9_found": p9_found, "p9_stats": p9_stats, "p9_counts": p9_counts}
_LETTERS = r"lower(upper(regexp_replace({c}, '[^\p{L}\p{N}]', '', 'g')))"
_P2_FORMS = f"""
WITH f AS (SELECT e.id, {_LETTERS.replace('{c}', 'e.kind')} AS kind, {_LETTERS.replace('{c}', 'e.name')} AS name, e.module, {CANON.replace('{c}', 'e.attrs')} AS attrs FROM olog_elem e),
g AS (SELECT kind, name, module, attrs, min(id) AS first, count(*) AS copies, count(DISTINCT id) AS ids FROM f GROUP BY ALL)
"""
_P2 = _P2_FORMS + "SELECT DISTINCT g.first AS elem_id_a, f.id AS elem_id_b FROM f JOIN g ON f.kind IS NOT DISTINCT FROM g.kind AND f.name IS NOT DISTINCT FROM g.name AND f.module IS NOT DISTINCT FROM g.module AND f.attrs IS NOT DISTINCT FROM g.attrs WHERE f.id <> g.first"
_P9_COUNTS = r"""
SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+')), 0) AS n_words,
  coalesce(len(list_filter(regexp_split_to_array(text, '[\n\r\x0B\x0C\x{85}\x{2028}\x{2029}]+'), lambda x: regexp_matches(x, '[^\s\x0B\x1C-\x1F\p{Z}]'))), 0) AS n_lines FROM documents"""

ORACLES: dict[str, str] = {"p2_found": _P2, "p9_counts": _P9_COUNTS, "p2_copies": _P2_FORMS + "SELECT first AS id, copies, ids FROM g", "p7_round_trip": "SELECT doc_id, coalesce(length(text), 0) AS n_chars, true AS same FROM documents"}
