"""Plans: ordered graph edits that are projected, checked, applied and revised without touching what is stored.

Operations are rows; a plan of any length folds into a few joins. Columns: ord, op, target, name, module, kind, src,
dst, text. op is one of rename, move, add_symbol, remove_symbol, add_arrow, remove_arrow, amend_type, rewrite_body,
add_reexport.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from arrowlens.operators.constraints import one_per
from arrowlens.operators.graph import Graph, arrow_id
from arrowlens.runtime import Scratch

OPS = "ord int, op string, target string, name string, module string, kind string, src string, dst string, text string"
_FIELDS = ("target", "name", "module", "kind", "src", "dst", "text")


def plan_hash(operations: Sequence[dict]) -> str:
    return hashlib.sha256(json.dumps(list(operations), separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def plan_rows(spark: SparkSession, operations: Iterable[dict]) -> DataFrame:
    return spark.createDataFrame([(i, o["op"], *(o.get(f) for f in _FIELDS)) for i, o in enumerate(operations)], OPS)


def symbol_id():
    """The id that an added symbol has in projection and after applying alike."""
    return F.concat_ws(":", F.lit("manual"), F.coalesce("module", F.lit("")), F.lit("0"), F.lit("0"), F.coalesce("kind", F.lit("other")), "name")


def project(g: Graph, ops: DataFrame) -> Graph:
    """The graph as it would be: the last rename and move of an element count, removals beat everything."""
    last = lambda op, col, new: one_per(ops.where(F.col("op") == op).select(F.col("target").alias("id"), F.col(col).alias(new), "ord"), ["id"], [F.desc("ord")]).drop("ord")
    removed = ops.where("op = 'remove_symbol'").select(F.col("target").alias("id")).distinct()
    made = ops.where(F.col("op").isin("add_symbol", "add_reexport")).select(symbol_id().alias("id"), F.coalesce("kind", F.lit("other")).alias("kind"), "name", "module", F.lit(None).cast("string").alias("span"), F.lit("{}").alias("attrs")).dropDuplicates(["id"])
    e = g.elem.unionByName(made.join(g.elem.select("id"), "id", "left_anti").select(g.elem.columns)).join(removed, "id", "left_anti")
    e = e.join(last("rename", "name", "new_name"), "id", "left").join(last("move", "module", "new_module"), "id", "left")
    e = e.withColumn("name", F.coalesce("new_name", "name")).withColumn("module", F.coalesce("new_module", "module")).select(g.elem.columns)
    gone = ops.where("op = 'remove_arrow'").select(F.coalesce("target", arrow_id(F.col("src"), F.col("kind"), F.col("dst"))).alias("id")).distinct()
    added = ops.where("op = 'add_arrow'").select(arrow_id(F.col("src"), F.col("kind"), F.col("dst")).alias("id"), "kind", F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), F.lit("{}").alias("attrs")).dropDuplicates(["id"])
    a = g.arr.join(gone, "id", "left_anti").select(g.arr.columns)
    a = a.unionByName(added.join(g.arr.select("id"), "id", "left_anti").select(g.arr.columns))
    return Graph(e, a, g.prov)


def name_conflicts(g: Graph, ops: DataFrame) -> DataFrame:
    """(module, name, n): names that a plan gives to several elements of one module."""
    p = project(g, ops)
    named = ops.where(F.col("op").isin("rename", "move", "add_symbol", "add_reexport"))
    ids = named.select(F.when(F.col("op").isin("rename", "move"), F.col("target")).otherwise(symbol_id()).alias("id")).distinct()
    touched = p.elem.join(ids, "id", "left_semi").select("module", "name").distinct()
    t = touched.select(F.col("module").alias("m"), F.col("name").alias("n0"))
    return p.elem.join(t, F.col("module").eqNullSafe(F.col("m")) & (F.col("name") == F.col("n0"))).groupBy("module", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def surviving_arrows(g: Graph, ops: DataFrame) -> DataFrame:
    """(target, arr_id): arrows of the projection that still touch a removed element."""
    removed = ops.where("op = 'remove_symbol'").select("target").distinct()
    ends = project(g, ops).arr.select(F.col("id").alias("arr_id"), F.explode(F.array_distinct(F.array("src_id", "dst_id"))).alias("target"))
    return ends.join(removed, "target").select("target", "arr_id")


def validate(g: Graph, ops: DataFrame) -> DataFrame:
    """(ord, op, fault, detail): one row per fault of a plan."""
    ops = Scratch(g.spark, "plan").write(ops, "ops")
    p = project(g, ops)
    stored, after = g.elem.select(F.col("id")), p.elem.select(F.col("id"))

    def missing(rows: DataFrame, key: str, ids: DataFrame, fault: str) -> DataFrame:
        k = rows.select("ord", "op", F.col(key).alias("id")).where("id IS NOT NULL")
        return k.join(ids, "id", "left_anti").select("ord", "op", F.lit(fault).alias("fault"), F.col("id").alias("detail"))

    on = lambda *names: ops.where(F.col("op").isin(*names))
    out = missing(on("rename", "move", "remove_symbol", "amend_type", "rewrite_body"), "target", stored, "no such element")
    out = out.unionByName(missing(on("add_arrow"), "src", after, "no such source")).unionByName(missing(on("add_arrow"), "dst", after, "no such destination"))
    rm = on("remove_arrow").withColumn("gone", F.coalesce("target", arrow_id(F.col("src"), F.col("kind"), F.col("dst"))))
    out = out.unionByName(missing(rm, "gone", g.arr.select("id"), "no such arrow"))
    modules = g.elem.where("module IS NOT NULL").select(F.col("module").alias("id")).distinct()
    out = out.unionByName(missing(on("add_reexport"), "module", modules, "no such module"))
    no_span = on("rewrite_body").select("ord", "op", F.col("target").alias("id")).join(g.elem.where("span IS NULL").select("id"), "id", "left_semi").select("ord", "op", F.lit("no span").alias("fault"), F.col("id").alias("detail"))
    both = on("rewrite_body").select("ord", "op", F.col("target").alias("id")).join(on("rename", "remove_symbol").select(F.col("target").alias("id")).distinct(), "id", "left_semi").select("ord", "op", F.lit("rewritten and renamed or removed").alias("fault"), F.col("id").alias("detail"))
    named = on("rename", "move", "add_symbol", "add_reexport").select("ord", "op", F.when(F.col("op").isin("rename", "move"), F.col("target")).otherwise(symbol_id()).alias("id")).join(p.elem.select("id", F.col("module").alias("m"), F.col("name").alias("n0")), "id")
    clash = named.join(name_conflicts(g, ops), F.col("m").eqNullSafe(F.col("module")) & (F.col("n0") == F.col("name"))).select("ord", "op", F.lit("name is taken").alias("fault"), F.col("name").alias("detail"))
    left = on("remove_symbol").select("ord", "op", "target").join(surviving_arrows(g, ops), "target").select("ord", "op", F.lit("arrow survives").alias("fault"), F.col("arr_id").alias("detail"))
    for x in (no_span, both, clash, left):
        out = out.unionByName(x)
    return out


def did_you_mean(g: Graph, faults: DataFrame, most: int = 10) -> DataFrame:
    """(ord, detail, candidates): ids of elements that bear the name at the end of a missing id."""
    f = faults.where(F.col("fault").like("no such %")).select("ord", "detail", F.element_at(F.split("detail", ":"), -1).alias("name"))
    return f.join(g.elem.select("name", "id"), "name").groupBy("ord", "detail").agg(F.slice(F.array_sort(F.collect_set("id")), 1, most).alias("candidates"))


def apply(g: Graph, ops: DataFrame, at: int = 0) -> tuple[Graph, DataFrame]:
    """(new graph, faults): operations with faults are left out, the others applied. Removed elements take their
    arrows along; amend_type adds {"amended": text} to attrs; added symbols get manual provenance."""
    scratch = Scratch(g.spark, "plan")  # a plan is small; projecting it again and again is not
    ops = scratch.write(ops, "ops")
    faults = scratch.write(validate(g, ops), "faults")
    ok = ops.join(faults.where("fault <> 'arrow survives'").select("ord").distinct(), "ord", "left_anti").select(ops.columns)
    p = project(g, ok)
    amended = one_per(ok.where("op = 'amend_type'").select(F.col("target").alias("id"), "text", "ord"), ["id"], [F.desc("ord")]).drop("ord")
    merged = F.to_json(F.map_concat(F.from_json("attrs", "map<string,string>"), F.create_map(F.lit("amended"), F.col("text"))))
    elem = p.elem.join(amended, "id", "left").withColumn("attrs", F.when(F.col("text").isNotNull(), F.coalesce(merged, F.to_json(F.struct(F.col("text").alias("amended"))))).otherwise(F.col("attrs"))).select(g.elem.columns)
    ids = elem.select("id")
    arr = p.arr.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi").select(g.arr.columns)
    made = ids.join(g.elem.select("id"), "id", "left_anti")
    prov = made.select(F.col("id").alias("elem_id"), F.lit("manual").alias("source"), F.lit("").alias("commit_sha"), F.lit(at).cast("long").alias("ingested_at"), F.lit("resolved").alias("confidence"))
    kept = g.prov.join(ids.withColumnRenamed("id", "elem_id"), "elem_id", "left_semi").select(g.prov.columns)
    return Graph(elem, arr, kept.unionByName(prov.select(g.prov.columns))), faults


def revise(ops: DataFrame, links: DataFrame, delta: DataFrame) -> DataFrame:
    """(ord, op, verdict): rollback if an operation touches what the brief removed, redirect if modified, else keep.

    links: (elem_id, brief_id); delta: (brief_id, name, change) with change removed, modified or added. Symbols that
    a plan adds are touched by name.
    """
    by_id = ops.select("ord", F.explode(F.array("target", "src", "dst")).alias("elem_id")).where("elem_id IS NOT NULL").join(links, "elem_id").join(delta, "brief_id").select("ord", "change")
    by_name = ops.where("op = 'add_symbol'").select("ord", "name").join(delta.select("name", "change"), "name").select("ord", "change")
    hit = by_id.unionByName(by_name).groupBy("ord").agg(F.max(F.when(F.col("change") == "removed", 2).when(F.col("change") == "modified", 1).otherwise(0)).alias("p"))
    return ops.select("ord", "op").join(hit, "ord", "left").select("ord", "op", F.when(F.col("p") == 2, "rollback").when(F.col("p") == 1, "redirect").otherwise("keep").alias("verdict"))


def relevant(config_table: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Rows whose config text contains any of the target kinds or modules."""
    hit = F.lit(False)
    for t in targets:
        hit = hit | F.col("config").contains(t)
    return config_table.where(hit)


EDITS = "edit_id string, file string, old_text string, new_text string, start_line int, start_col int, end_line int, end_col int"


def edit_conflicts(edits: DataFrame, block: int = 64) -> DataFrame:
    """(file, e1, e2): edits of one file whose half-open ranges overlap, e1 before e2 by id.

    Only edits that touch the same block of lines are compared, in the block where the later of them begins.
    """
    pos = edits.select("file", "edit_id", F.struct("start_line", "start_col").alias("s"), F.struct("end_line", "end_col").alias("e"))
    pos = pos.withColumn("block", F.explode(F.sequence(F.floor(F.col("s.start_line") / block), F.floor(F.greatest("s.start_line", "e.end_line") / block))))
    b = pos.select("file", "block", F.col("edit_id").alias("e2"), F.col("s").alias("s2"), F.col("e").alias("x2"))
    later = F.floor(F.greatest("s.start_line", "s2.start_line") / block)
    hit = (F.col("edit_id") < F.col("e2")) & (F.col("s") < F.col("x2")) & (F.col("s2") < F.col("e")) & (later == F.col("block"))
    return pos.join(b, ["file", "block"]).where(hit).select("file", F.col("edit_id").alias("e1"), "e2")


def line_starts(text: str) -> list[int]:
    return [0, *(i + 1 for i, c in enumerate(text) if c == "\n")]


def offset_at(text: str, line: int, col: int, starts: list[int] | None = None) -> int:
    """Character offset of a 1-based line and column; beyond the end of a line or text, its end."""
    starts = starts or line_starts(text)
    if line > len(starts):
        return len(text)
    end = starts[line] - 1 if line < len(starts) else len(text)
    return min(starts[line - 1] + max(col, 1) - 1, end)


def edit_text(text: str, edits: Sequence[dict]) -> tuple[str, str | None]:
    """(new text, fault): all edits of one file from its end to its start, or none of them."""
    out, starts = text, line_starts(text)
    for e in sorted(edits, key=lambda e: (e["start_line"], e["start_col"], e["edit_id"]), reverse=True):
        a, b = offset_at(text, e["start_line"], e["start_col"], starts), offset_at(text, e["end_line"], e["end_col"], starts)
        if e["old_text"] is not None and out[a:b] != e["old_text"]:
            return text, f"{e['edit_id']}: the text there is another"
        out = out[:a] + e["new_text"] + out[b:]
    return out, None


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(file, text, edited, fault): each file with its edits; a file with conflicting or failing edits stays as it is.

    files: (file, text). A file's edits travel to its text as one list; files without edits are not touched.
    """
    bad = edit_conflicts(edits).select("file").distinct().withColumn("clash", F.lit(True))
    packed = edits.groupBy("file").agg(F.collect_list(F.struct("edit_id", "old_text", "new_text", "start_line", "start_col", "end_line", "end_col")).alias("edits"))
    rows = files.join(packed, "file", "left").join(bad, "file", "left")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.edits is None:
                    out.append((r.file, r.text, False, None))
                elif r.clash is True or r.clash == True:  # noqa: E712
                    out.append((r.file, r.text, False, "edits overlap"))
                else:
                    t, fault = edit_text(r.text, [dict(e) if isinstance(e, dict) else e.asDict() for e in r.edits])
                    out.append((r.file, t, fault is None, fault))
            yield pd.DataFrame(out, columns=["file", "text", "edited", "fault"])

    return rows.select("file", "text", "edits", "clash").mapInPandas(run, "file string, text string, edited boolean, fault string")
