"""Deeply nested JSON records into flat tables that keep parent and place.

One SQL projection over VARIANT makes an array of rows per target table: nested `transform` calls carry ancestor keys
and indices down and `flatten` joins the arrays of all parents. The arrays are stored once, so that every document is
read and parsed once, and one `inline` per target table emits its rows from its own column. Key spelling (letter case,
underscores and other signs) makes no difference, nor does wrapping: a document written as a JSON string, an object
that wraps the list under its own name, a list of one item written without its list.

Defined results: null, empty or unreadable JSON gives no rows. A bridge that is a list gives a row for each item. Items that are null give no row but keep their place
in the numbering; an item without its id has a null item_id. Of records delivered several times, sessions keep the row
with the latest time (null is earliest, ties go to the greater texts) and elements the greatest item list. Rows
without id and columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arrowlens.runtime import Scratch

_ROW = "array<struct<parent_id:string,item_id:string,pos:bigint>>"
_fresh = iter(range(10**9))


def _v() -> str:
    return f"v{next(_fresh)}"


def keyed(v: str) -> str:
    """array<struct<k, v>>: the fields of an object, keys as their letters and digits in lower case; null if it is no
    object. Keys are normalised here once, whatever number of fields is read."""
    e = _v()
    entries = f"map_entries(CASE WHEN schema_of_variant({v}) LIKE 'OBJECT%' THEN CAST({v} AS map<string,variant>) END)"
    return f"transform({entries}, {e} -> named_struct('k', lower(regexp_replace({e}.key, '[^\\\\p{{L}}\\\\p{{N}}]', '')), 'v', {e}.value))"


def field(o: str, name: str) -> str:
    """A field of a keyed object; null if absent, null or no object."""
    e = _v()
    return f"get(filter({o}, {e} -> {e}.k = '{name}' AND NOT is_variant_null({e}.v)), 0).v"


def text(v: str) -> str:
    return f"try_variant_get({v}, '$', 'string')"


def let(v: str, body) -> str:
    """body(name) with `v` evaluated once."""
    x = _v()
    return f"get(transform(array({v}), {x} -> {body(x)}), 0)"


def opened(v: str) -> str:
    """A JSON document written as a JSON string is opened; anything else stays."""
    return let(v, lambda x: f"CASE WHEN schema_of_variant({x}) = 'STRING' AND {text(x)} RLIKE '^\\\\s*[\\\\[{{\"]' THEN coalesce(try_parse_json({text(x)}), {x}) ELSE {x} END")


def items(v: str, wrapper: str | None = None) -> str:
    """array<variant>: the items of a list, of a wrapped list, or of a single value without its list."""
    none = "CAST(array() AS array<variant>)"

    def plain(x: str, inner: str) -> str:
        return f"CASE WHEN {x} IS NULL OR is_variant_null({x}) THEN {none} WHEN schema_of_variant({x}) LIKE 'ARRAY%' THEN CAST({x} AS array<variant>) ELSE {inner} END"

    if wrapper is None:
        return let(opened(v), lambda x: plain(x, f"array({x})"))

    def unwrapped(o: str, x: str) -> str:
        e = _v()
        inner = let(opened(field(o, wrapper)), lambda y: plain(y, f"array({y})"))
        return f"CASE WHEN coalesce(exists({o}, {e} -> {e}.k = '{wrapper}'), false) THEN {inner} ELSE array({x}) END"

    return let(opened(opened(v)), lambda x: plain(x, let(keyed(x), lambda o: unwrapped(o, x))))


def rows(of: str, item, parent) -> str:
    """array<struct<parent_id, item_id, pos>> of the items that are not null; item(x) and parent give the texts."""
    x, i, r = _v(), _v(), _v()
    made = f"transform({of}, ({x}, {i}) -> named_struct('parent_id', {parent}, 'item_id', CASE WHEN {x} IS NOT NULL AND NOT is_variant_null({x}) THEN {item(x)} END, 'pos', CAST({i} AS bigint), 'there', {x} IS NOT NULL AND NOT is_variant_null({x})))"
    return f"CAST(transform(filter({made}, {r} -> {r}.there), {r} -> named_struct('parent_id', {r}.parent_id, 'item_id', {r}.item_id, 'pos', {r}.pos)) AS {_ROW})"


def objects(of: str) -> str:
    """array<struct<o, there>>: items as keyed objects; there is false for null items."""
    x = _v()
    return f"transform({of}, {x} -> named_struct('o', {keyed(x)}, 'there', {x} IS NOT NULL AND NOT is_variant_null({x})))"


def object_rows(of: str, item, parent) -> str:
    """`rows` of keyed objects."""
    x, i, r = _v(), _v(), _v()
    made = f"transform({of}, ({x}, {i}) -> named_struct('parent_id', {parent}, 'item_id', {item(f'{x}.o')}, 'pos', CAST({i} AS bigint), 'there', {x}.there))"
    return f"CAST(transform(filter({made}, {r} -> {r}.there), {r} -> named_struct('parent_id', {r}.parent_id, 'item_id', {r}.item_id, 'pos', {r}.pos)) AS {_ROW})"


def within(of: str, body) -> str:
    """Concatenates body(o) over the keyed objects that are there."""
    x = _v()
    return f"flatten(transform({of}, {x} -> CASE WHEN {x}.there THEN {body(f'{x}.o')} ELSE CAST(array() AS {_ROW}) END))"


def session_targets() -> dict[str, str]:
    """Target table -> SQL of its rows, over columns root_id, cands and eqs (keyed objects)."""
    own = lambda o: text(field(o, "id"))
    of_item = lambda x: let(keyed(x), own)

    def under(name: str, item):
        return within("cands", lambda o: let(own(o), lambda p: rows(items(field(o, name)), item, p)))

    def steps(side: str) -> str:
        return within("eqs", lambda o: let(own(o), lambda p: rows(items(let(keyed(opened(field(o, side))), lambda s: field(s, "arrows"))), text, p)))

    return {
        "candidate": object_rows("cands", own, "root_id"),
        "arrow": under("proposedarrows", of_item),
        "bridge": under("bridgearrow", of_item),
        "question": under("questions", text),
        "equation": object_rows("eqs", own, "root_id"),
        "lhs_step": steps("lhs"),
        "rhs_step": steps("rhs"),
    }


def element_targets() -> dict[str, str]:
    """Over columns root_id and params (keyed objects)."""
    name = lambda o: text(field(o, "name"))
    return {
        "param": object_rows("params", name, "root_id"),
        "type_ref": within("params", lambda o: let(name(o), lambda n: rows(items(field(o, "typerefs")), text, n))),
    }


def _emit(arrays: DataFrame, targets: dict[str, str]) -> dict[str, DataFrame]:
    """One inline per target table over the stored arrays, of which each table reads its own column."""
    return {t: arrays.selectExpr("root_id", f"inline({t})").selectExpr("root_id", "parent_id", "item_id", "pos") for t in targets}


def session_arrays(sessions: DataFrame) -> DataFrame:
    """(root_id, an array of rows per target table): the one projection, over each session's last row."""
    last = sessions.where("id is not null").selectExpr("id AS root_id", "struct(updated_at, candidates_json, equations_json) AS m").groupBy("root_id").agg(F.max("m").alias("m"))
    parsed = last.selectExpr("root_id", "try_parse_json(m.candidates_json) AS c", "try_parse_json(m.equations_json) AS e")
    lists = parsed.selectExpr("root_id", f"{objects(items('c', 'candidates'))} AS cands", f"{objects(items('e', 'equations'))} AS eqs")
    return lists.selectExpr("root_id", *(f"{sql} AS {t}" for t, sql in session_targets().items()))


def element_arrays(elems: DataFrame) -> DataFrame:
    parsed = elems.where("id is not null").selectExpr("id AS root_id", f"{opened('try_parse_json(attrs)')} AS a")
    signature = let(keyed("a"), lambda o: let(keyed(opened(field(o, "signature"))), lambda s: field(s, "params")))
    lists = parsed.selectExpr("root_id", f"{objects(items(signature))} AS params").where("size(params) > 0")
    arrays = lists.selectExpr("root_id", *(f"{sql} AS {t}" for t, sql in element_targets().items()))
    return arrays.selectExpr("root_id", "struct(param, type_ref) AS m").groupBy("root_id").agg(F.max("m").alias("m")).selectExpr("root_id", "m.param", "m.type_ref")


def session_tables(sessions: DataFrame) -> dict[str, DataFrame]:
    """candidate, arrow, bridge, question, equation, lhs_step, rhs_step: (root_id, parent_id, item_id, pos)."""
    return _emit(Scratch(sessions.sparkSession, "nested").write(session_arrays(sessions), "sessions"), session_targets())


def element_tables(elems: DataFrame) -> dict[str, DataFrame]:
    """param and type_ref: (root_id, parent_id, item_id, pos)."""
    return _emit(Scratch(elems.sparkSession, "nested").write(element_arrays(elems), "elements"), element_targets())


def all_items(sessions: DataFrame, elems: DataFrame) -> DataFrame:
    """(root_id, entity, parent_id, item_id, pos): the union of all target tables."""
    out = None
    for name, df in {**session_tables(sessions), **element_tables(elems)}.items():
        rows_ = df.selectExpr("root_id", f"'{name}' AS entity", "parent_id", "item_id", "pos")
        out = rows_ if out is None else out.unionByName(rows_)
    return out
