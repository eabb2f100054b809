"""Registered queries of the general table operators, and their SQL where it can be said in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from arrowlens.operators import hierarchy, hotkeys, nested, snapshots, wide
from arrowlens.sources.tables import table


def p1_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.attributes_to_wide(table(spark, sf_dir, "olog_attr"), table(spark, sf_dir, "attr_def"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.wide_cells(p1_wide(spark, sf_dir))


def p3_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, sf_dir, "olog_elem_snap"), table(spark, sf_dir, "commit_log"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_changes(spark, sf_dir).select("commit_sha", "elem_id", "change_kind")


def p4_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotkeys.element_summary(table(spark, sf_dir, "olog_arr"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotkeys.dominant_keys(table(spark, sf_dir, "olog_arr")).select("side", "elem_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, sf_dir, "olog_arr")).positions()


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, sf_dir, "olog_arr")).paths().drop("pre")


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with each node below it."""
    return hierarchy.hierarchy(table(spark, sf_dir, "olog_arr")).descendants()


def p5_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, sf_dir, "olog_arr")).cycles()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.all_items(table(spark, sf_dir, "olog_domain_session"), table(spark, sf_dir, "olog_elem"))


QUERIES = {"p1_found": p1_found, "p1_wide": p1_wide, "p3_found": p3_found, "p3_changes": p3_changes, "p4_found": p4_found, "p4_elements": p4_elements, "p5_found": p5_found, "p5_paths": p5_paths, "p5_cycles": p5_cycles, "p5_descendants": p5_descendants, "p6_found": p6_found}

_P4 = """
WITH arrows AS (SELECT DISTINCT id, src_id, dst_id FROM olog_arr),
ends AS (SELECT 'dst' AS side, dst_id AS elem_id, id FROM arrows UNION ALL SELECT 'src', src_id, id FROM arrows)
SELECT side, elem_id FROM ends GROUP BY side, elem_id
HAVING count(*) * 100 >= (SELECT count(DISTINCT id) FROM olog_arr)
"""

_P4_ELEMENTS = """
WITH ends AS (
  SELECT 'dst' AS side, dst_id AS elem_id, id, src_id AS other, lower(trim(kind)) AS kind FROM olog_arr
  UNION ALL SELECT 'src', src_id, id, dst_id, lower(trim(kind)) FROM olog_arr)
SELECT side, elem_id, count(DISTINCT id) AS arrows, count(DISTINCT other) AS neighbours, count(DISTINCT kind) AS kinds
FROM ends GROUP BY side, elem_id
"""

_P1 = r"""
WITH keyed AS (
  SELECT a.elem_id, d.attr_key, d.attr_type, trim(a.value) AS v, a.recorded_at,
         row_number() OVER (PARTITION BY a.elem_id, d.attr_key ORDER BY a.recorded_at DESC NULLS LAST, a.value DESC NULLS LAST) AS rn
  FROM olog_attr a JOIN attr_def d
    ON lower(regexp_replace(a.key, '[^A-Za-z0-9]', '', 'g')) = lower(regexp_replace(d.attr_key, '[^A-Za-z0-9]', '', 'g'))
  WHERE a.elem_id IS NOT NULL),
last AS (SELECT * FROM keyed WHERE rn = 1 AND v IS NOT NULL AND v <> ''),
vals AS (
  SELECT elem_id, attr_key, CASE attr_type
    WHEN 'str' THEN v
    WHEN 'bool' THEN CASE WHEN lower(v) IN ('true','t','yes','y','on','1') THEN 'true' WHEN lower(v) IN ('false','f','no','n','off','0') THEN 'false' END
    WHEN 'int' THEN CASE WHEN regexp_matches(v, '^[+-]?([0-9]+|[0-9]{1,3}([,_][0-9]{3})+)([.]0*)?$')
      THEN cast(try_cast(regexp_replace(regexp_replace(v, '[.]0*$', ''), '[^0-9-]', '', 'g') AS bigint) AS varchar) END
    WHEN 'dec' THEN CASE WHEN regexp_matches(v, '^[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+) *%?$')
      THEN cast(cast(round(try_cast(replace(regexp_replace(v, ' *%$', ''), ',', '.') AS decimal(30,12)) * (CASE WHEN v LIKE '%\%' ESCAPE '\' THEN 0.01 ELSE 1.00 END), 3) AS decimal(18,3)) AS varchar) END
    WHEN 'ts' THEN CASE WHEN regexp_matches(v, '^[0-9]{10}$') THEN cast(cast(v AS bigint) * 1000 AS varchar)
      WHEN regexp_matches(v, '^[0-9]{13}$') THEN cast(cast(v AS bigint) AS varchar)
      WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN cast(epoch_ms(try_cast(v AS timestamp)) AS varchar)
      WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.]+$') THEN cast(epoch_ms(try_cast(v AS timestamp)) AS varchar)
      WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.]+(Z|[+-][0-9]{2}:[0-9]{2})$') THEN cast(epoch_ms(try_cast(v AS timestamptz)) AS varchar) END
    END AS attr_value
  FROM last)
SELECT elem_id, attr_key, attr_value FROM vals WHERE attr_value IS NOT NULL
"""

_LINKS = """
WITH RECURSIVE links AS (
  SELECT DISTINCT CASE WHEN lower(trim(kind)) = 'memberof' THEN src_id ELSE dst_id END AS child,
         CASE WHEN lower(trim(kind)) = 'memberof' THEN dst_id ELSE src_id END AS parent
  FROM olog_arr WHERE lower(trim(kind)) IN ('memberof', 'contains')),
nodes AS (SELECT child AS id FROM links UNION SELECT parent FROM links),
"""

_P5 = (
    _LINKS
    + """
down AS (
  SELECT id AS elem_id, id AS root_id, 0::bigint AS depth FROM nodes WHERE id NOT IN (SELECT child FROM links)
  UNION ALL SELECT l.child, d.root_id, d.depth + 1 FROM down d JOIN links l ON l.parent = d.elem_id),
loose AS (SELECT id FROM nodes WHERE id NOT IN (SELECT elem_id FROM down)),
walk AS (
  SELECT id AS start, id AS at FROM loose
  UNION SELECT w.start, l.parent FROM walk w JOIN links l ON l.child = w.at),
on_cycle AS (SELECT DISTINCT w.start AS id FROM walk w JOIN links l ON l.child = w.at WHERE l.parent = w.start),
looped AS (SELECT w.start AS elem_id, min(w.at) AS root_id FROM walk w JOIN on_cycle c ON c.id = w.at GROUP BY w.start)
SELECT elem_id, root_id, depth FROM down UNION ALL SELECT elem_id, root_id, -1 FROM looped
"""
)

_P5_DOWN = (
    _LINKS
    + """
down AS (
  SELECT id AS elem_id, id AS root_id, 0::bigint AS depth, id AS path, [id] AS above FROM nodes WHERE id NOT IN (SELECT child FROM links)
  UNION ALL SELECT l.child, d.root_id, d.depth + 1, d.path || ' > ' || l.child, list_append(d.above, l.child) FROM down d JOIN links l ON l.parent = d.elem_id),
pairs AS (SELECT unnest(above[:-2]) AS elem_id, elem_id AS descendant_id FROM down)
"""
)
_P5_PATHS = _P5_DOWN + "SELECT d.elem_id, d.root_id, d.depth, d.path, coalesce(n.n, 0) AS descendants FROM down d LEFT JOIN (SELECT elem_id, count(*) AS n FROM pairs GROUP BY 1) n ON n.elem_id = d.elem_id"
_P5_CYCLES = _P5[: _P5.index("SELECT elem_id, root_id, depth FROM down UNION ALL")].rstrip() + """,
every AS (SELECT w.start, min(l.root_id) AS root_id, max(CASE WHEN w.start IN (SELECT id FROM on_cycle) THEN 1 ELSE 0 END) AS is_on FROM walk w JOIN looped l ON l.elem_id = w.at WHERE w.at IN (SELECT id FROM on_cycle) GROUP BY 1)
SELECT root_id, count(*) FILTER (WHERE is_on = 1) AS on_cycle, count(*) FILTER (WHERE is_on = 0) AS below FROM every GROUP BY 1"""

#: The columns of the wide table, as attr_def states them.
_WIDE = {
    "arity": "int", "branch_coverage": "dec", "byte_size": "int", "churn_ratio": "dec", "comment_ratio": "dec", "complexity_score": "dec", "cyclomatic": "int", "doc_summary": "str", "fan_in": "int", "first_seen": "ts", "has_docs": "bool", "is_async": "bool", "is_deprecated": "bool", "is_exported": "bool", "is_generated": "bool", "last_touched": "ts", "layer": "str", "line_coverage": "dec", "loc": "int", "owner_team": "str", "return_type": "str", "reviewed_at": "ts", "test_count": "int", "visibility": "str",
}
_CASTS = {"int": "CAST(attr_value AS BIGINT)", "bool": "CAST(attr_value AS BOOLEAN)", "dec": "CAST(attr_value AS DECIMAL(18,3))", "ts": "make_timestamp(CAST(attr_value AS BIGINT) * 1000)", "str": "attr_value"}
_P1_WIDE = "SELECT e.elem_id, " + ", ".join(f'max(CASE WHEN attr_key = \'{k}\' THEN {_CASTS[t]} END) AS "{k}"' for k, t in _WIDE.items()) + f" FROM (SELECT DISTINCT elem_id FROM olog_attr WHERE elem_id IS NOT NULL) e LEFT JOIN ({_P1}) v ON v.elem_id = e.elem_id GROUP BY 1"

#: One text for each JSON value: its nodes by path, numbers as doubles; other text stands for itself.
CANON = r"""CASE WHEN json_valid({c}) THEN (SELECT string_agg(t.fullkey || '=' || CASE WHEN t.type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'N' || CAST(CAST(t.atom AS DOUBLE) AS VARCHAR) ELSE t.type || coalesce(CAST(t.atom AS VARCHAR), '') END, chr(1) ORDER BY t.fullkey) FROM json_tree({c}) t) ELSE 'raw:' || trim({c}) END"""
_SPAN = r"""CASE WHEN regexp_matches(span, '(?:^|:)\s*0*(\d+):0*(\d+)\s*-\s*0*(\d+):0*(\d+)\s*$') THEN regexp_replace(span, '^(?:.*:)?\s*0*(\d+):0*(\d+)\s*-\s*0*(\d+):0*(\d+)\s*$', '\1:\2:\3:\4') ELSE 'raw:' || trim(span) END"""
_P3_ROWS = f"""
WITH c AS (SELECT lower(trim(commit_sha)) AS sha, row_number() OVER (ORDER BY committed_at, commit_sha) AS seq FROM commit_log),
r AS (SELECT s.id, c.seq, max_by(struct_pack(kind := s.kind, name := s.name, module := s.module, span := {_SPAN}, attrs := {CANON.replace('{c}', 's.attrs')}), s.delivered_at) AS v FROM olog_elem_snap s JOIN c ON starts_with(c.sha, lower(trim(s.commit_sha))) WHERE s.id IS NOT NULL GROUP BY 1, 2),
p AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.seq, b.seq + 1) AS seq, b.v AS old, a.v AS new FROM r a FULL JOIN r b ON a.id = b.id AND a.seq = b.seq + 1),
x AS (SELECT *, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'changed' END AS change_kind FROM p WHERE seq > 1 AND seq <= (SELECT count(*) FROM c) AND old IS DISTINCT FROM new)
"""
_P3 = _P3_ROWS + "SELECT c.sha AS commit_sha, x.id AS elem_id, x.change_kind FROM x JOIN c ON c.seq = x.seq"

ORACLES = {"p5_found": _P5, "p5_paths": _P5_PATHS, "p5_cycles": _P5_CYCLES, "p5_descendants": _P5_DOWN + "SELECT elem_id, descendant_id FROM pairs", "p1_found": _P1, "p1_wide": _P1_WIDE, "p3_found": _P3, "p4_found": _P4, "p4_elements": _P4_ELEMENTS}
