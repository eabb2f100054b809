"""Typed multi-hop traversal in the two senses that matter: everything passed (closure) and where it ends (endpoint)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from arrowlens.operators.graph import Graph

#: (arrow kind, 'out' or 'in')
Step = tuple[str, str]


def _step(g: Graph, frontier: DataFrame, step: Step, derived: bool, confidence: str | None) -> DataFrame:
    """(arrow columns, here, there): arrows that leave the frontier (column id) along a step."""
    kind, direction = step
    a = g.arrows_of(kind, derived)
    if confidence:
        held = g.prov.where(F.col("confidence") == confidence).select(F.col("elem_id").alias("src_id")).distinct()
        a = a.join(held, "src_id", "left_semi")
    here, there = ("src_id", "dst_id") if direction == "out" else ("dst_id", "src_id")
    return a.withColumn("here", F.col(here)).withColumn("there", F.col(there)).join(frontier.select(F.col("id").alias("here")), "here", "left_semi")


def traverse(g: Graph, seeds: DataFrame, steps: Sequence[Step], derived: bool = False, confidence: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Closure: (elements passed with the first level they occur on, arrows passed).

    The elements are the seeds and all that any hop reaches, each once; the arrows are a bag with their level, so that
    one crossed on two steps is listed twice.
    """
    frontier = seeds.select("id").distinct()
    levels, arrows = [frontier.withColumn("level", F.lit(0))], []
    for n, step in enumerate(steps, 1):
        crossed = _step(g, frontier, step, derived, confidence)
        arrows.append(crossed.select("id", "kind", "src_id", "dst_id", F.lit(n).alias("level")))
        frontier = crossed.select(F.col("there").alias("id")).distinct()
        levels.append(frontier.withColumn("level", F.lit(n)))
    seen, passed = levels[0], arrows[0] if arrows else g.arr.limit(0).select("id", "kind", "src_id", "dst_id", F.lit(0).alias("level"))
    for x in levels[1:]:
        seen = seen.unionByName(x)
    for x in arrows[1:]:
        passed = passed.unionByName(x)
    first = seen.groupBy("id").agg(F.min("level").alias("first_level"))
    return g.elem.join(first, "id"), passed


def reach(g: Graph, seeds: DataFrame, kinds: Sequence[str], derived: bool = False) -> DataFrame:
    """Endpoint: (seed, id), the set that each seed reaches at the end of a path of outgoing kinds; only elements that
    exist. The empty path reaches the seed itself. Sets are made distinct after every hop."""
    now = seeds.select(F.col("id").alias("seed"), "id").distinct()
    for kind in kinds:
        a = g.arrows_of(kind, derived).select(F.col("src_id").alias("id"), "dst_id")
        now = now.join(a, "id").select("seed", F.col("dst_id").alias("id")).distinct()
    return now.join(g.elem.select("id"), "id", "left_semi").select("seed", "id")


def path_relation(g: Graph, kinds: Sequence[str]) -> DataFrame:
    """(seed, id) for all seeds at once, composed from the right: where the last arrow has few ends, distinct suffixes
    stay far smaller than distinct prefixes."""
    rel: DataFrame | None = None
    for kind in reversed(kinds):
        a = g.arr.where(F.col("kind") == kind).select(F.col("src_id").alias("seed"), F.col("dst_id").alias("mid"))
        rel = a.select("seed", F.col("mid").alias("id")).distinct() if rel is None else a.join(rel.withColumnRenamed("seed", "mid"), "mid").select("seed", "id").distinct()
    if rel is None:
        return g.elem.select(F.col("id").alias("seed"), "id")
    return rel


def related(g: Graph, ids: DataFrame, kinds: Sequence[str], direction: str = "out", once: bool = False) -> DataFrame:
    """(from_id, via, element columns): one hop by kinds, 'out', 'in' or 'both', resolved to elements."""
    ends = {"out": [("src_id", "dst_id")], "in": [("dst_id", "src_id")], "both": [("src_id", "dst_id"), ("dst_id", "src_id")]}[direction]
    pairs = F.array(*(F.struct(F.col(a).alias("from_id"), F.col(b).alias("id")) for a, b in ends))
    hops = g.arr.where(F.col("kind").isin(list(kinds))).select(F.col("kind").alias("via"), F.inline(pairs))
    hops = hops.join(ids.select(F.col("id").alias("from_id")).distinct(), "from_id", "left_semi")
    if once:
        hops = hops.groupBy("from_id", "id").agg(F.min("via").alias("via"))
    return hops.join(g.elem, "id").select("from_id", "via", "id", "kind", "name", "module")


def ego(g: Graph, seeds: DataFrame, depth: int = 2, kinds: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Breadth-first balls: nodes (seed, id, distance) and edges (seed, arr_id, kind, src_id, dst_id), where every
    outgoing arrow of a node nearer than `depth` is an edge, to nodes seen before too."""
    a = g.arr if kinds is None else g.arr.where(F.col("kind").isin(list(kinds)))
    a = a.select(F.col("id").alias("arr_id"), "kind", "src_id", "dst_id")
    seen = seeds.select(F.col("id").alias("seed"), "id").distinct().withColumn("distance", F.lit(0))
    for d in range(1, depth + 1):
        edge = seen.where(F.col("distance") == d - 1).join(a, F.col("id") == F.col("src_id")).select("seed", F.col("dst_id").alias("id")).distinct()
        seen = seen.unionByName(edge.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("distance", F.lit(d)))
    edges = seen.where(F.col("distance") < depth).join(a, F.col("id") == F.col("src_id")).select("seed", "arr_id", "kind", "src_id", "dst_id")
    return seen, edges


def literal_hits(docs: DataFrame, literal: str, id_col: str = "doc_id") -> DataFrame:
    """(id, line): 1-based lines of a text that contain a literal."""
    lines = docs.where(F.col("text").contains(literal)).select(F.col(id_col).alias("id"), F.posexplode(F.split("text", "\n")).alias("pos", "line_text"))
    return lines.where(F.col("line_text").contains(literal)).select("id", (F.col("pos") + 1).alias("line"))


def enclosing(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """(elem_id): elements whose span of lines in the same file encloses a hit; an equi join on the file with a range
    condition. hits: (id, line); spans: (elem_id, file, start_line, end_line)."""
    return hits.join(spans, (F.col("file") == F.col("id")) & F.col("line").between(F.col("start_line"), F.col("end_line"))).select("elem_id").distinct()


def query(
    g: Graph, start: dict | None = None, kind: str | None = None, name: str | None = None, module: str | None = None,
    arrows: Sequence[str] = (), direction: str = "out", confidence: str | None = None, limit: int | None = 50, derived: bool = False,
) -> tuple[DataFrame, DataFrame | None]:
    """One front door: (elements, arrows), arrows None without a traversal.

    start is {"id": ...} or a filter {"kind": ..., "name": ..., "module": ...}; without a kind in it the top-level
    filter counts. With arrow kinds, the elements found are the seeds of a traversal along them, whose elements and
    arrows come once each; without, an id gives that element, and a filter its elements, with confidence only those
    that have it.
    """
    start = start or {}
    if "id" in start:
        found = g.element(start["id"])
    else:
        f = start if "kind" in start else {"kind": kind, "name": name, "module": module}
        wanted = (f.get("kind"), f.get("name"), f.get("module"))
        found = g.elements(*wanted, limit=limit) if arrows or not confidence else g.elements(*wanted)
        if confidence and not arrows:
            found = g.with_confidence(found, confidence)
            if limit is not None:
                found = found.orderBy(F.col("module").asc_nulls_first(), F.col("name").asc_nulls_first(), "id").limit(limit)
    if not arrows:
        return found, None
    elements, passed = traverse(g, found.select("id"), [(k, direction) for k in arrows], derived, confidence)
    return elements, passed.groupBy("id", "kind", "src_id", "dst_id").agg(F.min("level").alias("level"))
