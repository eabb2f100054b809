"""Source files into staging rows and a resolved graph.

Files are read distributed as binary, texts go through an extractor by file extension in one Arrow pass, and names are
resolved by joins: within a file first, then across files where a name, or a name with its import's module, is unique.
The extractors are scanners, not full parsers (see `extractors`).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arrowlens.operators.constraints import one_per
from arrowlens.operators.graph import Graph, arrow_id
from arrowlens.sources.extractors import extract_clojure, extract_typescript
from arrowlens.runtime import Scratch

#: What discovery leaves out, and the largest file in bytes.
IGNORED = r"(^|/)(node_modules|dist|build|\.git)(/|$)|\.d\.ts$"
MAX_BYTES = 1_048_576

STAGED = "file string, seq int, row string, kind string, name string, line int, col int, end_line int, end_col int, src string, dst string, dst_module string, attrs string"

Extractor = Callable[[str, str], list[tuple]]


def read_files(spark: SparkSession, root: str, glob: str = "*.{ts,tsx,clj,cljs,cljc}", ignored: str = IGNORED, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """(file, text): files under a root that are not ignored; paths are relative to the root. A file of more than
    max_bytes (None: no bound) has a null text, from which `stage` makes an error row."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^\w+:/+", "/", root.rstrip("/")) + "/"  # schemes are written with one slash or three
    rel = F.element_at(F.split(F.regexp_replace("path", r"^\w+:/+", "/"), re.escape(base), 2), -1)
    text = F.decode("content", "UTF-8")
    files = raw.select(rel.alias("file"), (text if max_bytes is None else F.when(F.col("length") <= max_bytes, text)).alias("text"))
    return files.where(~F.col("file").rlike(ignored))


EXTRACTORS: dict[str, Extractor] = {".ts": extract_typescript, ".tsx": extract_typescript, ".clj": extract_clojure, ".cljs": extract_clojure, ".cljc": extract_clojure}


def stage(files: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """Staged rows of all files that have an extractor; a file that fails gives no rows but one of row 'error'."""
    by = dict(extractors or EXTRACTORS)

    def run(batches):
        import pandas as pd

        columns = [c.split()[0] for c in STAGED.split(", ")]
        for pdf in batches:
            rows = []
            for file, text in zip(pdf["file"], pdf["text"]):
                ext = "." + file.rsplit(".", 1)[-1]
                if text is None:
                    rows.append((file, 0, "error", None, "too large or unreadable", 0, 0, 0, 0, None, None, None, "{}"))
                elif ext in by:
                    try:
                        rows += by[ext](file, text)
                    except Exception as e:
                        rows.append((file, 0, "error", None, str(e)[:200], 0, 0, 0, 0, None, None, None, "{}"))
            yield pd.DataFrame(rows, columns=columns)

    return files.select("file", "text").mapInPandas(run, STAGED)


def resolve_specifier(file: Column, spec: Column) -> Column:
    """Path of a relative import against its file, `.js` read as `.ts`; other specifiers stay."""
    folder = F.slice(F.split(file, "/"), 1, F.size(F.split(file, "/")) - 1)
    up = lambda parts, p: F.when(p == "..", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).when(p == ".", parts).otherwise(F.concat(parts, F.array(p)))
    path = F.regexp_replace(F.array_join(F.aggregate(F.split(spec, "/"), folder, up), "/"), r"\.js(x?)$", ".ts$1")
    full = F.when(path.rlike(r"\.\w+$"), path).otherwise(F.concat(path, F.lit(".ts")))
    return F.when(spec.startswith("."), full).otherwise(spec)


def cross_file(pending: DataFrame, elems: DataFrame) -> DataFrame:
    """(pending_id, dst_id): pending (pending_id, name, hint) finds the one element of that name whose module ends
    with the hint, or, without a hint, the one element of that name at all; none or several find nothing."""
    known = elems.select("name", F.col("id").alias("dst_id"), F.col("module").alias("in_module"))
    only = known.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("dst_id").alias("dst_id")).where("n = 1").drop("n")
    bare = pending.where("hint IS NULL").select("pending_id", "name").join(only, "name").select("pending_id", "dst_id")
    # a hint is a suffix of a path: its last part joins, so that one common name does not meet all modules
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    far = pending.where("hint IS NOT NULL").withColumn("part", last("hint"))
    whole = far.where(F.col("hint").contains("/")).join(known.withColumn("part", last("in_module")), ["name", "part"])
    ends = far.where(~F.col("hint").contains("/")).select("pending_id", "name", "hint").join(known, "name")
    hit = whole.select("pending_id", "hint", "in_module", "dst_id").unionByName(ends.select("pending_id", "hint", "in_module", "dst_id"))
    ok = hit.where(F.col("in_module").endswith(F.col("hint"))).groupBy("pending_id").agg(F.count(F.lit(1)).alias("n"), F.min("dst_id").alias("dst_id")).where("n = 1")
    return bare.unionByName(ok.select("pending_id", "dst_id"))


def extraction_errors(staged: DataFrame) -> DataFrame:
    """(file, fault): files that gave nothing because they are too large, unreadable or made their extractor fail."""
    return staged.where("row = 'error'").select("file", F.col("name").alias("fault"))


def build_graph(staged: DataFrame, sha: str = "", at: int = 0) -> Graph:
    """The resolved graph of staged rows."""
    scratch = Scratch(staged.sparkSession, "code")  # extraction runs once; each table below is read several times
    staged = scratch.write(staged, "staged")
    e0 = staged.where("row IN ('elem', 'prop')")
    span = F.format_string("%s:%d:%d-%d:%d", "file", "line", "col", "end_line", "end_col")
    elem = e0.select("file", "seq", "row", F.concat_ws(":", F.lit("module"), "file", F.col("line").cast("string"), F.col("col").cast("string"), "kind", "name").alias("id"), "kind", "name", span.alias("span"), "attrs", F.col("src").alias("parent"))
    elem = scratch.write(elem, "elem")
    files = staged.where("row <> 'error'").select("file").distinct()
    file_elem = files.select(F.concat(F.lit("file:"), "file").alias("id"), F.lit("file").alias("kind"), F.element_at(F.split("file", "/"), -1).alias("name"), F.col("file").alias("module"), F.lit(None).cast("string").alias("span"), F.lit("{}").alias("attrs"))
    own = elem.select("id", "kind", "name", F.col("file").alias("module"), "span", "attrs")
    local = one_per(elem.where("row = 'elem'").select("file", "name", "id", "seq"), ["file", "name"], [F.col("seq")]).drop("seq")
    local = scratch.write(local, "local")

    defined = elem.where(F.col("kind").isin("function", "class", "interface", "type", "enum", "method")).select(F.col("id").alias("src_id"), F.lit("definedIn").alias("kind"), F.concat(F.lit("file:"), "file").alias("dst_id"))
    raw = staged.where("row = 'arrow' AND kind <> 'importsFrom'").select("file", "seq", "kind", "src", "dst", "dst_module")
    at_src = raw.join(local.select("file", F.col("name").alias("src"), F.col("id").alias("src_id")), ["file", "src"])
    inside = at_src.join(local.select("file", F.col("name").alias("dst"), F.col("id").alias("dst_id")), ["file", "dst"], "left")
    near = inside.where("dst_id IS NOT NULL AND dst_module IS NULL").select("src_id", "kind", "dst_id")
    far = inside.where("dst_id IS NULL OR dst_module IS NOT NULL")
    hint = F.when(F.col("dst_module").startswith("."), resolve_specifier(F.col("file"), F.col("dst_module"))).otherwise(F.col("dst_module"))
    waiting = far.select(F.concat_ws("\0", "src_id", "kind", "dst", F.coalesce(hint, F.lit(""))).alias("pending_id"), "src_id", "kind", F.col("dst").alias("name"), hint.alias("hint")).dropDuplicates(["pending_id"])
    found = cross_file(waiting.select("pending_id", "name", "hint"), own.where("kind <> 'import'"))
    across = waiting.join(found, "pending_id").where("src_id <> dst_id").select("src_id", "kind", "dst_id")

    imports = staged.where("row = 'arrow' AND kind = 'importsFrom'").withColumn("target", resolve_specifier(F.col("file"), F.col("dst_module"))).join(local.select("file", F.col("name").alias("src"), F.col("id").alias("src_id")), ["file", "src"])
    modules = imports.select(F.concat(F.lit("module:"), "target").alias("id"), F.lit("module").alias("kind"), F.col("target").alias("name"), F.col("target").alias("module"), F.lit(None).cast("string").alias("span"), F.lit("{}").alias("attrs")).dropDuplicates(["id"])
    import_arrows = imports.select("src_id", F.lit("importsFrom").alias("kind"), F.concat(F.lit("module:"), "target").alias("dst_id"))

    props = elem.where("row = 'prop'").join(local.select("file", F.col("name").alias("parent"), F.col("id").alias("parent_id")), ["file", "parent"])
    has = props.select(F.col("parent_id").alias("src_id"), F.lit("hasProperty").alias("kind"), F.col("id").alias("dst_id"))
    member = props.select(F.col("id").alias("src_id"), F.lit("memberOf").alias("kind"), F.col("parent_id").alias("dst_id"))
    refs = props.select("file", F.col("id").alias("src_id"), F.explode(F.from_json(F.get_json_object("attrs", "$.typeRefs"), "array<string>")).alias("name"))
    types = elem.where(F.col("kind").isin("class", "interface", "type", "enum"))
    here = one_per(types.select("file", "name", "id", "seq"), ["file", "name"], [F.col("seq")]).select("file", "name", F.col("id").alias("near_id"))
    anywhere = types.groupBy("name").agg(F.min(F.struct("file", "seq", "id")).alias("m")).select("name", F.col("m.id").alias("far_id"))
    typed = refs.join(here, ["file", "name"], "left").join(anywhere, "name", "left").select("src_id", F.lit("hasType").alias("kind"), F.coalesce("near_id", "far_id").alias("dst_id")).where("dst_id IS NOT NULL")

    pairs = near
    for x in (defined, across, import_arrows, has, member, typed):
        pairs = pairs.unionByName(x)
    pairs = scratch.write(pairs, "pairs")
    inverse = pairs.where("kind = 'callerOf'").select(F.col("dst_id").alias("src_id"), F.lit("calleeOf").alias("kind"), F.col("src_id").alias("dst_id"))
    arr = pairs.unionByName(inverse).select(arrow_id(F.col("src_id"), F.col("kind"), F.col("dst_id")).alias("id"), "kind", "src_id", "dst_id", F.lit("{}").alias("attrs")).dropDuplicates(["id"])
    all_elem = own.unionByName(file_elem).unionByName(modules).dropDuplicates(["id"])
    prov = all_elem.select(F.col("id").alias("elem_id"), F.lit("tree-sitter").alias("source"), F.lit(sha).alias("commit_sha"), F.lit(at).cast("long").alias("ingested_at"), F.lit("resolved").alias("confidence"))
    return Graph(all_elem, arr, prov)


def replace_extracted(old: Graph, new: Graph) -> Graph:
    """A full load: extracted facts are replaced, manual elements and their arrows stay where both ends exist."""
    manual = old.prov.where("source <> 'tree-sitter'").select(F.col("elem_id").alias("id")).distinct()
    kept = old.elem.join(manual, "id", "left_semi").join(new.elem.select("id"), "id", "left_anti")
    elem = new.elem.unionByName(kept.select(new.elem.columns))
    ids = elem.select("id")
    by_src = old.arr.join(manual.withColumnRenamed("id", "src_id"), "src_id", "left_semi").select(old.arr.columns)
    by_dst = old.arr.join(manual.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi").select(old.arr.columns)
    stay = by_src.unionByName(by_dst).dropDuplicates(["id"]).join(new.arr.select("id"), "id", "left_anti")
    stay = stay.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
    prov = old.prov.where("source <> 'tree-sitter'").join(ids.withColumnRenamed("id", "elem_id"), "elem_id", "left_semi")
    return Graph(elem, new.arr.unionByName(stay.select(new.arr.columns)), new.prov.unionByName(prov.select(new.prov.columns)))
