"""Plans as edits of source text: one task row per file and operation by joins, one pass over each file.

rename edits the declaration, imports of the name elsewhere and the calls in elements that call it; move cuts the
declaration out, puts it into the other file behind its imports and points importers at it; add_symbol writes a stub,
add_reexport a line at the end; remove_symbol cuts the declaration and takes the name out of imports; amend_type adds
a property (interface, class) or a union member (type). Arrows and bodies leave no edits: rewrite_body is handed on as
work to do, and the stub of a symbol in a module with a rewritten body is left to that work.

Spans are `file:l:c-l:c` or `l:c-l:c`. What cannot be rendered gives a warning row instead of an edit. Edits whose
ranges overlap are all dropped and reported. A file that does not exist is created by its first insertion.
"""

from __future__ import annotations

import posixpath
import re
from bisect import bisect_right

from pyspark.sql import DataFrame, functions as F

from arrowlens.operators.graph import Graph, one_row
from arrowlens.operators.plan import apply, apply_edits, edit_conflicts, symbol_id, validate
from arrowlens.runtime import Scratch

TASK = "file string, ord int, op string, what string, name string, new string, kind string, path string, other string, first int, last int"
EDIT = "ord int, op string, edit_id string, file string, label string, old_text string, new_text string, start_line int, start_col int, end_line int, end_col int, warning string"

# paths and imports -----------------------------------------------------------------------------------------------


def without_extension(path: str) -> str:
    return re.sub(r"\.[cm]?[jt]sx?$", "", path)


def relative_import(from_file: str, to_module: str) -> str:
    """How a file imports a module: relative, with slashes, without extension."""
    rel = posixpath.relpath(without_extension(to_module), posixpath.dirname(from_file) or ".")
    return rel if rel.startswith(".") else "./" + rel


def imported_module(from_file: str, specifier: str) -> str:
    """The module that a relative specifier of a file means, without extension; other specifiers stay."""
    if not specifier.startswith("."):
        return specifier
    return without_extension(posixpath.normpath(posixpath.join(posixpath.dirname(from_file), specifier)))


_IMPORT = re.compile(r"""^[ \t]*(import|export)\s+(type\s+)?(?:(\w+)\s*,?\s*)?(?:\*\s+as\s+(\w+)\s*)?(?:\{([^}]*)\}\s*)?from\s*(['"])([^'"]+)\6[ \t]*;?""", re.M)


def parse_imports(text: str) -> list[dict]:
    """Import and re-export statements: where they stand and what they take from where."""
    out = []
    for m in _IMPORT.finditer(text):
        names = [n.strip() for n in (m[5] or "").split(",") if n.strip()]
        out.append({"word": m[1], "start": m.start() + len(m[0]) - len(m[0].lstrip()), "end": m.end(), "type": bool(m[2]), "default": m[3], "all": m[4], "names": names, "path": m[7]})
    return out


def format_import(i: dict, names: list[str] | None = None, path: str | None = None) -> str:
    names = i["names"] if names is None else names
    parts = [x for x in (i["default"], i["all"] and f"* as {i['all']}", "{ " + ", ".join(names) + " }" if names else None) if x]
    return f"{i['word']} {'type ' if i['type'] else ''}{', '.join(parts)} from '{path or i['path']}';"


def merge_imports(text: str, name: str, path: str) -> str:
    """The text with a name imported from a path: in the statement that imports from it already, else in a new one."""
    for i in parse_imports(text):
        if i["word"] == "import" and i["path"] == path and not i["all"]:
            if name in (n.split(" as ")[0] for n in i["names"]):
                return text
            return text[: i["start"]] + format_import(i, [*i["names"], name]) + text[i["end"] :]
    at = insertion_line(text)
    lines = text.split("\n")
    return "\n".join([*lines[: at - 1], f"import {{ {name} }} from '{path}';", *lines[at - 1 :]])


def insertion_line(text: str) -> int:
    """1-based line behind the last import of the head of a file; 1 if there is none."""
    last = 0
    for i in parse_imports(text):
        if i["word"] == "import":
            last = text.count("\n", 0, i["end"]) + 1
    return last + 1


def enclosing_declaration(text: str, line: int) -> tuple[int, int] | None:
    """(first, last) 1-based lines of the declaration that begins on a line: to the brace that closes it, or to the
    line that ends it."""
    lines, depth, opened = text.split("\n"), 0, False
    if not 1 <= line <= len(lines):
        return None
    for n in range(line - 1, len(lines)):
        code = re.sub(r"//.*$|'[^'\n]*'|\"[^\"\n]*\"|`[^`\n]*`", "", lines[n])
        depth += sum(code.count(c) for c in "{([") - sum(code.count(c) for c in "})]")
        opened = opened or "{" in code
        if depth <= 0 and (opened or code.rstrip().endswith(";") or n + 1 == len(lines) or not lines[n + 1].startswith((" ", "\t", "|"))):
            return line, n + 1
    return line, len(lines)


_TS_STUBS = {
    "function": "export function {0}() {{\n  throw new Error('{0} is a stub');\n}}", "method": "{0}() {{\n  throw new Error('{0} is a stub');\n}}",
    "class": "export class {0} {{}}", "interface": "export interface {0} {{}}", "type": "export type {0} = never;", "enum": "export enum {0} {{}}",
    "const": "export const {0} = undefined;", "var": "export var {0}: any;",
}
_CLJ_STUBS = {"function": "(defn {0} [])", "method": "(defn {0} [this])", "class": "(defrecord {0} [])", "interface": "(defprotocol {0})", "type": "(defrecord {0} [])", "const": "(def {0} nil)", "var": "(def ^:dynamic {0} nil)"}


def stub(file: str, kind: str, name: str) -> str | None:
    """Text of a new symbol in the file's language; null for kinds without one."""
    form = (_CLJ_STUBS if re.search(r"\.clj[cs]?$", file) else _TS_STUBS).get(kind)
    return form and form.format(name)


# one file --------------------------------------------------------------------------------------------------------


def edits_of_file(file: str, text: str | None, tasks: list[dict]) -> list[tuple]:
    """Edit and warning rows (EDIT) of the tasks of one file."""
    source, out = text or "", []
    starts = [0, *(m.end() for m in re.finditer("\n", source))]
    lines = source.split("\n")

    def place(offset: int) -> tuple[int, int]:
        line = bisect_right(starts, offset)
        return line, offset - starts[line - 1] + 1

    def add(t: dict, label: str, start: int, end: int, new: str) -> None:
        (a, b), (c, d) = place(start), place(end)
        old = source[start:end] if end > start else None
        out.append((t["ord"], t["op"], f"{t['ord']}:{file}:{a}:{b}", file, label, old, new, a, b, c, d, None))

    def warn(t: dict, why: str) -> None:
        out.append((t["ord"], t["op"], f"{t['ord']}:{file}", file, t["what"], None, None, None, None, None, None, why))

    def line_start(n: int) -> int:
        return starts[n - 1] if n <= len(starts) else len(source)

    def insert_line(t: dict, label: str, n: int, new: str) -> None:
        """Whole lines before line n; behind the text if it ends before."""
        at = line_start(n)
        add(t, label, at, at, new + "\n" if at < len(source) or source.endswith("\n") or not source else "\n" + new)

    for t in sorted(tasks, key=lambda t: (t["ord"], t["what"], t["first"] or 0, t["name"] or "")):
        what, name, first, last = t["what"], t["name"], t["first"], t["last"]
        if text is None and what not in ("stub", "reexport", "insert"):
            warn(t, "no such file")
        elif what in ("rename", "rename_calls"):
            a, b = line_start(first), line_start((last or first) + 1)
            calls = r"(?=\s*(?:<[^<>()]*>)?\()" if what == "rename_calls" else ""
            hits = list(re.finditer(rf"(?<![\w$]){re.escape(name)}(?![\w$]){calls}", source[a:b]))
            for m in hits[: None if calls else 1]:
                add(t, what, a + m.start(), a + m.end(), t["new"])
            if not hits and not calls:
                warn(t, "the name does not stand there")
        elif what == "cut":
            found = enclosing_declaration(source, first)
            if found is None:
                warn(t, "the span lies behind the end of the file")
            else:
                add(t, "cut", line_start(found[0]), line_start(found[1] + 1), "")
        elif what == "insert":  # name holds the moved text
            insert_line(t, "insert", insertion_line(source), name)
        elif what == "stub":
            made = stub(file, t["kind"] or "", name)
            if made is None:
                warn(t, f"no stub for kind {t['kind']}")
            else:
                at = len(starts) + 1 if re.search(r"\.clj[cs]?$", file) and source else insertion_line(source)
                insert_line(t, "stub", at, made)
        elif what == "reexport":
            insert_line(t, "reexport", len(starts) + (0 if source.endswith("\n") else 1), f"export {{ {name} }} from '{relative_import(file, t['path'])}';")
        elif what == "repoint":
            for i in parse_imports(source):
                if imported_module(file, i["path"]) == without_extension(t["path"]) and name in (n.split(" as ")[0] for n in i["names"]):
                    rest, path = [n for n in i["names"] if n.split(" as ")[0] != name], relative_import(file, t["other"])
                    moved = format_import({**i, "default": None, "all": None}, [n for n in i["names"] if n not in rest], path)
                    kept = format_import(i, rest) + "\n" if rest or i["default"] or i["all"] else ""
                    add(t, "repoint", i["start"], i["end"], kept + moved)
        elif what == "unimport":
            for i in parse_imports(source):
                if i["path"] and name in (n.split(" as ")[0] for n in i["names"]):
                    rest = [n for n in i["names"] if n.split(" as ")[0] != name]
                    gone = not rest and not i["default"] and not i["all"]
                    end = i["end"] + (1 if gone and source[i["end"] : i["end"] + 1] == "\n" else 0)
                    add(t, "unimport", i["start"], end, "" if gone else format_import(i, rest))
        elif what == "amend":
            found = enclosing_declaration(source, first)
            a, b = (line_start(found[0]), line_start(found[1] + 1)) if found else (0, 0)
            mark = "}" if t["kind"] in ("interface", "class") else ";"
            at = source.rfind(mark, a, b)
            if at < 0:
                warn(t, "the declaration has no end")
            elif mark == "}":
                before = "" if source[at - 1] == "\n" else "\n"
                add(t, "amend", at, at, f"{before}  {name.rstrip(';')};\n")
            else:
                add(t, "amend", at, at, f" | {name.lstrip('| ')}")
        elif what == "callers":
            warn(t, f"still called by {t['other']}")
    return out


# plans -----------------------------------------------------------------------------------------------------------


def _tasks(g: Graph, files: DataFrame, ops: DataFrame) -> DataFrame:
    part = lambda i: F.try_element_at(F.regexp_extract_all("span", F.lit(r"(\d+):\d+-(\d+):\d+$"), F.lit(i)), F.lit(1)).cast("int")
    e = g.elem.select("id", F.col("kind").alias("e_kind"), F.col("name").alias("e_name"), F.col("module").alias("e_module"), part(1).alias("first"), part(2).alias("last"))
    null = lambda t="string": F.lit(None).cast(t)

    def task(df: DataFrame, file, what: str, name, new=None, kind=None, path=None, other=None, first=None, last=None) -> DataFrame:
        or_null = lambda c, t="string": null(t) if c is None else c
        cols = [file.alias("file"), F.col("ord"), F.col("op"), F.lit(what).alias("what"), name.alias("name"), or_null(new).alias("new"), or_null(kind).alias("kind"), or_null(path).alias("path"), or_null(other).alias("other"), or_null(first, "int").alias("first"), or_null(last, "int").alias("last")]
        return df.select(*cols).where("file IS NOT NULL")

    c = F.col
    own = ops.select("ord", "op", "target", c("name").alias("new"), c("module").alias("to"), "text").join(e, c("target") == c("id"))
    there = own.where("first IS NOT NULL")
    on = lambda df, op: df.where(c("op") == op)
    imports = e.where("e_kind = 'import'").select(c("e_name").alias("i_name"), c("e_module").alias("i_module"), c("first").alias("i_first"), c("last").alias("i_last"))
    near = own.join(imports, (c("e_name") == c("i_name")) & (c("e_module") != c("i_module")))
    ends = g.arr.where("kind IN ('callerOf', 'calleeOf')").select(F.when(c("kind") == "callerOf", c("dst_id")).otherwise(c("src_id")).alias("target"), F.when(c("kind") == "callerOf", c("src_id")).otherwise(c("dst_id")).alias("caller")).distinct()
    callers = e.select(c("id").alias("caller"), c("e_module").alias("c_module"), c("e_name").alias("c_name"), c("first").alias("c_first"), c("last").alias("c_last"))
    called = own.where("op IN ('rename', 'remove_symbol')").join(ends, "target").join(callers, "caller")

    moved = on(there, "move").join(files.select(c("file").alias("e_module"), "text_of"), "e_module")
    cut = F.udf(_declaration, "string", useArrow=True)("text_of", "first")
    stubs = ops.where("op = 'add_symbol'").join(on(own, "rewrite_body").select(c("e_module").alias("module")).distinct(), "module", "left_anti")
    rows = [
        task(on(there, "rename"), c("e_module"), "rename", c("e_name"), c("new"), first=c("first"), last=c("last")),
        task(on(near, "rename"), c("i_module"), "rename", c("e_name"), c("new"), first=c("i_first"), last=c("i_last")),
        task(on(called, "rename").where("c_first IS NOT NULL"), c("c_module"), "rename_calls", c("e_name"), c("new"), first=c("c_first"), last=c("c_last")),
        task(on(there, "move"), c("e_module"), "cut", c("e_name"), first=c("first"), last=c("last")),
        task(moved, c("to"), "insert", cut),
        task(on(near, "move").where("i_module <> to"), c("i_module"), "repoint", c("e_name"), path=c("e_module"), other=c("to")),
        task(stubs, c("module"), "stub", c("name"), kind=c("kind")),
        task(ops.where("op = 'add_reexport'"), c("module"), "reexport", c("name"), path=c("src")),
        task(on(there, "remove_symbol").where("e_kind <> 'import'"), c("e_module"), "cut", c("e_name"), first=c("first"), last=c("last")),
        task(on(near, "remove_symbol"), c("i_module"), "unimport", c("e_name")),
        task(on(own, "remove_symbol").where("e_kind = 'import'"), c("e_module"), "unimport", c("e_name")),
        task(on(called, "remove_symbol"), c("c_module"), "callers", c("e_name"), other=c("c_name")),
        task(on(there, "amend_type"), c("e_module"), "amend", c("text"), kind=c("e_kind"), first=c("first"), last=c("last")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.distinct()


def _declaration(text: str | None, line: int | None) -> str | None:
    found = enclosing_declaration(text, line) if text is not None and line is not None else None
    return None if found is None else "\n".join(text.split("\n")[found[0] - 1 : found[1]])


def render(g: Graph, files: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits, warnings) of a plan over files (file, text): edits with ord, op and the columns that apply_edits takes;
    warnings (ord, op, file, warning). All edits that overlap another are dropped and warned of.

    An edit of one place asked for by several tasks counts once.
    """
    scratch = Scratch(g.spark, "render")
    texts = files.select("file", F.col("text").alias("text_of"))
    tasks = _tasks(g, texts, ops)
    packed = tasks.groupBy("file").agg(F.collect_list(F.struct(*(c.split()[0] for c in TASK.split(", ")[1:]))).alias("tasks"))

    def run(batches):
        import pandas as pd

        names = [c.split()[0] for c in EDIT.split(", ")]
        for pdf in batches:
            rows = []
            for file, text, todo in zip(pdf["file"], pdf["text_of"], pdf["tasks"]):
                plain = [{k: None if v is None or v != v else int(v) if k in ("ord", "first", "last") else v for k, v in (x if isinstance(x, dict) else x.asDict()).items()} for x in todo]
                rows += edits_of_file(file, text, plain)
            yield pd.DataFrame(rows, columns=names).astype({n: "Int32" for n in ("start_line", "start_col", "end_line", "end_col")})

    made = packed.join(texts, "file", "left").select("file", "text_of", "tasks").mapInPandas(run, EDIT)
    made = scratch.write(made, "made")
    edits = one_row(made.where("warning IS NULL"), "edit_id")
    same = ["file", "start_line", "start_col", "end_line", "end_col", "old_text", "new_text"]
    rest = [x for x in edits.columns if x not in same]
    empty = (F.col("start_line") == F.col("end_line")) & (F.col("start_col") == F.col("end_col"))
    edits = edits.withColumn("_e", F.when(empty, F.col("ord")).otherwise(-1))  # insertions stand side by side
    edits = edits.groupBy(*same, "_e").agg(F.min(F.struct("ord", *(x for x in rest if x != "ord"))).alias("m")).select(*same, *(F.col(f"m.{x}").alias(x) for x in rest)).select(made.columns).drop("warning")
    edits = scratch.write(edits, "edits")
    pairs = edit_conflicts(edits)
    clash = pairs.select(F.explode(F.array("e1", "e2")).alias("edit_id")).distinct()
    dropped = edits.join(clash, "edit_id", "left_semi").select("ord", "op", "file", F.lit("overlaps another edit").alias("warning"))
    warned = made.where("warning IS NOT NULL").select("ord", "op", "file", "warning").unionByName(dropped).distinct()
    return edits.join(clash, "edit_id", "left_anti"), warned


def pending_bodies(g: Graph, ops: DataFrame) -> DataFrame:
    """(ord, target, module, text): bodies that a plan leaves to be written."""
    return ops.where("op = 'rewrite_body'").select("ord", "target", "text").join(g.elem.select(F.col("id").alias("target"), "module"), "target").select("ord", "target", "module", "text")


def verify(g: Graph, ops: DataFrame) -> DataFrame:
    """(ord, op, fault): operations whose effect a graph does not show."""
    e = g.elem.select("id", F.col("name").alias("e_name"), F.col("module").alias("e_module"))
    ids, arrows = e.select("id"), g.arr.select("id")
    own = ops.where("op IN ('rename', 'move', 'remove_symbol', 'amend_type')").select("ord", "op", F.col("target").alias("id"), "name", "module").join(e, "id", "left")
    here = F.col("e_name").isNotNull() | F.col("e_module").isNotNull()
    fault = (
        F.when((F.col("op") == "rename") & here & (F.col("e_name") != F.col("name")), F.concat(F.lit("is still called "), "e_name"))
        .when((F.col("op") == "move") & here & ~F.col("e_module").eqNullSafe(F.col("module")), F.concat(F.lit("still lies in "), F.coalesce("e_module", F.lit("no module"))))
        .when((F.col("op") == "remove_symbol") & here, F.lit("is still there"))
        .when((F.col("op") == "amend_type") & ~here, F.lit("is gone"))
    )
    out = own.select("ord", "op", fault.alias("fault")).where("fault IS NOT NULL")
    named = ops.where("op IN ('add_symbol', 'add_reexport')").join(e.select(F.col("e_name").alias("name"), F.col("e_module").alias("module")).distinct(), ["name", "module"], "left_anti")
    ends = ops.where("op = 'add_arrow'").select("ord", "op", F.explode(F.array("src", "dst")).alias("id")).join(ids, "id", "left_anti")
    gone = ops.where("op = 'remove_arrow'").select("ord", "op", F.coalesce("target", F.concat_ws(":", "src", "kind", "dst")).alias("id")).join(arrows, "id", "left_semi")
    for df, why in ((named, "was not added"), (ends, "an end does not exist"), (gone, "is still there")):
        out = out.unionByName(df.select("ord", "op", F.lit(why).alias("fault")))
    return out.distinct()


def apply_with_edits(g: Graph, files: DataFrame, ops: DataFrame) -> dict:
    """Renders, edits and applies a plan as a whole: {ok, graph, files, faults, warnings, bodies, unmet}.

    If validation finds a fault (other than arrows that survive a removal) or any file's edits fail, everything stays
    as it was and ok is false. unmet lists operations that the new graph does not show.
    """
    scratch = Scratch(g.spark, "applied")
    ops = scratch.write(ops, "ops")
    edits, warnings = render(g, files, ops)
    created = edits.select("file").distinct().join(files.select("file"), "file", "left_anti").withColumn("text", F.lit(""))
    done = scratch.write(apply_edits(files.select("file", "text").unionByName(created), edits), "files")
    failed = done.where("fault IS NOT NULL").select(F.lit(None).cast("int").alias("ord"), F.lit("edit").alias("op"), "fault", F.col("file").alias("detail"))
    faults = scratch.write(validate(g, ops).where("fault <> 'arrow survives'").unionByName(failed), "faults")
    bodies = pending_bodies(g, ops)
    if not faults.isEmpty():
        return {"ok": False, "graph": g, "files": files, "faults": faults, "warnings": warnings, "bodies": bodies, "unmet": None}
    after, _ = apply(g, ops)
    return {"ok": True, "graph": after, "files": done.select("file", "text"), "faults": faults, "warnings": warnings, "bodies": bodies, "unmet": verify(after, ops)}
