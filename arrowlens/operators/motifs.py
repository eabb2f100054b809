"""Structural motifs: ego graphs with kinds in place of names, grouped by the hash of their shape.

Roles number the nodes of a kind by id, so that a shape is a canonical text of one ego graph, not a test for graph
isomorphism: two isomorphic ego graphs whose ids sort differently may have different shapes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from arrowlens.operators.graph import Graph
from arrowlens.operators.mining import mine_equations, prune
from arrowlens.operators.traverse import ego
from arrowlens.runtime import Scratch


def motif_seeds(g: Graph, kinds: Sequence[str] = ("function", "class", "interface"), scope: str | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    e = g.elem.where(F.col("kind").isin(list(kinds)))
    if scope:
        e = e.where(F.col("module").rlike(scope))
    for x in exclude:
        e = e.where(~F.coalesce(F.col("module").rlike(x), F.lit(False)))
    return e.select("id")


def roles(g: Graph, nodes: DataFrame) -> DataFrame:
    """(seed, id, kind, role): role = kind_n, numbered within the kind by id."""
    named = nodes.join(g.elem.select("id", "kind"), "id")
    w = Window.partitionBy("seed", "kind").orderBy("id")
    return named.select("seed", "id", "kind", F.concat_ws("_", "kind", (F.row_number().over(w) - 1).cast("string")).alias("role"))


def balls(g: Graph, seeds: DataFrame, depth: int = 2, kinds: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(roles, edges) of the ego graphs, stored once; what follows reads them several times."""
    scratch = Scratch(g.spark, "balls")
    nodes, edges = ego(g, seeds, depth, kinds)
    return scratch.write(roles(g, nodes), "roles"), scratch.write(edges.select("seed", F.col("kind").alias("label"), "src_id", "dst_id"), "edges")


def shapes(g: Graph, seeds: DataFrame, depth: int = 2, kinds: Sequence[str] | None = None, of: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(seed, shape_hash, shape): SHA-256 of the sorted objects and arrows as compact JSON. `of` takes balls made before."""
    r, edges = of or balls(g, seeds, depth, kinds)
    objects = r.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("kind", "role"))).alias("objects"))
    f = r.select("seed", F.col("id").alias("src_id"), F.col("role").alias("fromRole"))
    t = r.select("seed", F.col("id").alias("dst_id"), F.col("role").alias("toRole"))
    placed = edges.join(f, ["seed", "src_id"]).join(t, ["seed", "dst_id"])
    arrows = placed.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("fromRole", "label", "toRole"))).alias("arrows"))
    none = F.array().cast("array<struct<fromRole:string,label:string,toRole:string>>")
    whole = objects.join(arrows, "seed", "left").select("seed", F.struct("objects", F.coalesce("arrows", none).alias("arrows")).alias("shape"))
    return whole.select("seed", F.sha2(F.to_json("shape"), 256).alias("shape_hash"), "shape")


def group_shapes(found: DataFrame, min_support: int = 3) -> DataFrame:
    """(shape_hash, support, shape, name): shapes with enough seeds."""
    by = found.groupBy("shape_hash").agg(F.count(F.lit(1)).alias("support"), F.first("shape").alias("shape")).where(F.col("support") >= min_support)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("shape.objects", lambda o: o["kind"]))), "_")
    labels = F.array_join(F.array_sort(F.array_distinct(F.transform("shape.arrows", lambda a: a["label"]))), "_")
    return by.select("shape_hash", "support", "shape", F.concat_ws("_", F.lit("Motif"), kinds, labels).alias("name"))


def instances(g: Graph, seeds: DataFrame, depth: int = 2, kinds: Sequence[str] | None = None, min_support: int = 3) -> DataFrame:
    """(shape_hash, seed, role, elem_id): which element plays which role in each instance of a supported shape."""
    made = balls(g, seeds, depth, kinds)
    found = shapes(g, seeds, depth, kinds, made)
    kept = group_shapes(found, min_support).select("shape_hash")
    return found.join(kept, "shape_hash", "left_semi").select("seed", "shape_hash").join(made[0], "seed").select("shape_hash", "seed", "role", F.col("id").alias("elem_id"))


def candidates(found: DataFrame, placed: DataFrame, min_support: int = 3) -> DataFrame:
    """(shape_hash, name, description, support, seed, mapping, question): an instance each, with its roles as a map."""
    groups = group_shapes(found, min_support)
    text = F.format_string("%d objects and %d arrows, found %d times", F.size("shape.objects"), F.size("shape.arrows"), F.col("support"))
    named = groups.select("shape_hash", "name", text.alias("description"), "support", F.concat(F.lit("Is "), "name", F.lit(" a pattern worth a name?")).alias("question"))
    maps = placed.groupBy("shape_hash", "seed").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "elem_id")))).alias("mapping"))
    return maps.join(named, "shape_hash").select("shape_hash", "name", "description", "support", "seed", "mapping", "question")


def internal_equations(g: Graph, placed: DataFrame, depth: int = 2, min_coverage: float = 0.8, most: int = 50) -> DataFrame:
    """(shape_hash, lhs, rhs, coverage): equations mined on the whole graph from the element kinds of each shape's first
    instance, with as many seeds of a kind as its instances have different elements.

    placed is the result of `instances`; shapes are few against their instances and are gone through one by one.
    """
    first = placed.groupBy("shape_hash").agg(F.min("seed").alias("seed"), F.countDistinct("elem_id").alias("n"))
    kinds = placed.join(first, ["shape_hash", "seed"]).groupBy("shape_hash", "n").agg(F.array_sort(F.collect_set(F.regexp_replace("role", r"_\d+$", ""))).alias("kinds"))
    mined: dict[tuple, list] = {}
    rows = []
    for r in kinds.orderBy("shape_hash").toLocalIterator():
        key = (tuple(r["kinds"]), r["n"])
        if key not in mined:
            mined[key] = prune(mine_equations(g, None, r["kinds"], depth, min_coverage, r["n"]), most)
        rows += [(r["shape_hash"], k["lhs"], k["rhs"], k["coverage"]) for k in mined[key]]
    return g.spark.createDataFrame(rows, "shape_hash string, lhs array<string>, rhs array<string>, coverage double")
