"""Integrity constraints and path equations. Violations are rows (rule, kind, message, involved)."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from arrowlens.operators.graph import ELEMENT_KINDS, Graph
from arrowlens.operators.traverse import path_relation, reach

#: Constraints are definitions; more than this is an error.
MAX_RULES = 10_000
#: Ranks of confidence.
RANK = {"tentative": 0, "unresolved": 1, "resolved": 2}


def existence(g: Graph, kind: str | None) -> DataFrame:
    """(kind): the required kind, if no element has it."""
    wanted = g.spark.createDataFrame([(kind,)] if kind else [], "kind string")
    return wanted.join(g.elem.select("kind").distinct(), "kind", "left_anti")


def layer_of(module: Column, layers: Sequence[Sequence[str]]) -> Column:
    """Index of the first layer of which any pattern is found in the module; null if none."""
    out = None
    for i, patterns in enumerate(layers):
        hit = F.lit(False)
        for p in patterns:
            hit = hit | module.rlike(p)
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out if out is not None else F.lit(None).cast("int")


def layering(g: Graph, layers: Sequence[Sequence[str]], kinds: Sequence[str] | None = None) -> DataFrame:
    """(arr_id, src_id, dst_id, src_layer, dst_layer): arrows from a lower layer index to a higher one."""
    placed = g.elem.select("id", layer_of(F.col("module"), layers).alias("layer")).where("layer IS NOT NULL")
    a = g.arr if kinds is None else g.arr.where(F.col("kind").isin(list(kinds)))
    a = a.select(F.col("id").alias("arr_id"), "src_id", "dst_id")
    a = a.join(placed.select(F.col("id").alias("src_id"), F.col("layer").alias("src_layer")), "src_id")
    return a.join(placed.select(F.col("id").alias("dst_id"), F.col("layer").alias("dst_layer")), "dst_id").where("src_layer < dst_layer").select("arr_id", "src_id", "dst_id", "src_layer", "dst_layer")


def first_provenance(g: Graph) -> DataFrame:
    """(elem_id, confidence, ...): of several rows the first by source, commit_sha."""
    key = F.struct("source", "commit_sha", "ingested_at", "confidence")
    return g.prov.groupBy("elem_id").agg(F.min(key).alias("m")).select("elem_id", "m.*")


def monotonicity(g: Graph) -> DataFrame:
    """(arr_id, src_rank, dst_rank): arrows into a more confident element; elements without provenance are skipped."""
    ranks = F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv))
    p = first_provenance(g).select("elem_id", F.try_element_at(ranks, F.col("confidence")).alias("rank")).where("rank IS NOT NULL")
    a = g.arr.select(F.col("id").alias("arr_id"), "src_id", "dst_id")
    a = a.join(p.select(F.col("elem_id").alias("src_id"), F.col("rank").alias("src_rank")), "src_id")
    return a.join(p.select(F.col("elem_id").alias("dst_id"), F.col("rank").alias("dst_rank")), "dst_id").where("dst_rank > src_rank").select("arr_id", "src_rank", "dst_rank")


def totality(g: Graph, domain_kind: str, arrow_kind: str) -> DataFrame:
    """(id, n): elements of a kind with none or several outgoing arrows of a kind."""
    n = g.arr.where(F.col("kind") == arrow_kind).groupBy(F.col("src_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return g.elem.where(F.col("kind") == domain_kind).select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


def check(g: Graph, constraints: Sequence[dict]) -> DataFrame:
    """All violations of constraints {id, kind, config, message?}: (rule, kind, message, involved)."""
    out = g.spark.createDataFrame([], "rule string, kind string, message string, involved array<string>")
    for c in constraints:
        cfg = c["config"] if isinstance(c["config"], dict) else json.loads(c["config"])
        if c["kind"] == "existence":
            v = existence(g, cfg.get("kind")).select(F.array().cast("array<string>").alias("involved"), F.concat(F.lit("no element of kind "), "kind").alias("text"))
        elif c["kind"] == "layering":
            v = layering(g, cfg["layers"]).select(F.array("src_id", "dst_id", "arr_id").alias("involved"), F.format_string("layer %d refers to layer %d", "src_layer", "dst_layer").alias("text"))
        elif c["kind"] == "monotonicity":
            v = monotonicity(g).select(F.array("arr_id").alias("involved"), F.format_string("confidence rises from %d to %d", "src_rank", "dst_rank").alias("text"))
        elif c["kind"] == "totality":
            bad = totality(g, cfg["domainKind"], cfg["arrowKind"])
            arrows = g.arr.where(F.col("kind") == cfg["arrowKind"]).groupBy(F.col("src_id").alias("id")).agg(F.sort_array(F.collect_list(F.col("id"))).alias("a"))
            v = bad.join(arrows, "id", "left").select(F.concat(F.array("id"), F.coalesce("a", F.array().cast("array<string>"))).alias("involved"), F.when(F.col("n") == 0, "no arrow").otherwise("more than one arrow").alias("text"))
        else:
            raise ValueError(f"unknown constraint kind {c['kind']}")
        out = out.unionByName(v.select(F.lit(c["id"]).alias("rule"), F.lit(c["kind"]).alias("kind"), F.coalesce(F.lit(c.get("message")), F.col("text")).alias("message"), "involved"))
    return out


def equation_sides(g: Graph, seeds: DataFrame, lhs: Sequence[str], rhs: Sequence[str], from_right: bool = False) -> DataFrame:
    """(seed, lhs, rhs): the sorted sets that both paths reach from each seed that reaches anything.

    From few seeds, paths are walked from the left. With from_right they are composed from the right as whole
    relations and then cut to the seeds, which is far cheaper where many seeds reach few ends.
    """

    def ends(path: Sequence[str]) -> DataFrame:
        if not from_right:
            return reach(g, seeds, path)
        rel = path_relation(g, path).join(g.elem.select("id"), "id", "left_semi")
        return rel.join(seeds.select(F.col("id").alias("seed")).distinct(), "seed", "left_semi").select("seed", "id")

    sets = [ends(p).groupBy("seed").agg(F.array_sort(F.collect_set("id")).alias(n)) for p, n in ((lhs, "lhs"), (rhs, "rhs"))]
    empty = F.array().cast("array<string>")
    return sets[0].join(sets[1], "seed", "full_outer").select("seed", F.coalesce("lhs", empty).alias("lhs"), F.coalesce("rhs", empty).alias("rhs"))


def equation_check(g: Graph, seeds: DataFrame, lhs: Sequence[str], rhs: Sequence[str], from_right: bool = False) -> DataFrame:
    """(seed, valid, lhs_only, rhs_only): a seed from which both sides are empty is valid and not listed."""
    s = equation_sides(g, seeds, lhs, rhs, from_right)
    return s.select("seed", (F.col("lhs") == F.col("rhs")).alias("valid"), F.array_except("lhs", "rhs").alias("lhs_only"), F.array_except("rhs", "lhs").alias("rhs_only"))


def schema_kind(elem: DataFrame) -> DataFrame:
    """(id, schema_kind): elements that stand for a kind: domain and property for themselves, else attrs.schemaKind,
    else an 'a X' or 'an X' of kind other without module and span, for X in lower case."""
    attr = F.get_json_object("attrs", "$.schemaKind")
    phrase = F.regexp_extract("name", r"^an? (.+)$", 1)
    as_phrase = (F.col("kind") == "other") & F.col("module").isNull() & F.col("span").isNull() & (phrase != "")
    return elem.select("id", F.when(F.col("kind").isin("domain", "property"), F.col("kind")).when(attr.isNotNull(), attr).when(as_phrase, F.lower(phrase)).alias("schema_kind")).where("schema_kind IS NOT NULL")


def equation_violations(g: Graph, equations: Sequence[dict]) -> DataFrame:
    """(equation, seed, lhs_only, rhs_only) of equations {id, lhs: {src, arrows}, rhs: {src, arrows}}.

    From an element that stands for a kind, every element of that kind is a seed; otherwise the element itself. An
    equation whose left or right source does not exist holds.
    """
    out = g.spark.createDataFrame([], "equation string, seed string, lhs_only array<string>, rhs_only array<string>")
    for e in equations:
        sources = g.elem.where(F.col("id").isin(e["lhs"]["src"], e["rhs"]["src"])).select("id").distinct().count()
        if sources < len({e["lhs"]["src"], e["rhs"]["src"]}):
            continue
        row = schema_kind(g.element(e["lhs"]["src"])).first()
        seeds = g.elem.where(F.col("kind") == row["schema_kind"]) if row else g.element(e["lhs"]["src"])
        bad = equation_check(g, seeds.select("id"), e["lhs"]["arrows"], e["rhs"]["arrows"]).where(~F.col("valid"))
        out = out.unionByName(bad.select(F.lit(e["id"]).alias("equation"), "seed", "lhs_only", "rhs_only"))
    return out


def validate_equation(g: Graph, equation: dict, proposed: Sequence[str] = ()) -> list[str]:
    """Faults of an equation's form: ends that differ, arrow kinds that neither stand in the graph nor are proposed."""
    lhs, rhs = equation["lhs"], equation["rhs"]
    faults = [f"{end} differ: {lhs[end]} and {rhs[end]}" for end in ("src", "tgt") if lhs[end] != rhs[end]]
    wanted = sorted({*lhs["arrows"], *rhs["arrows"]} - set(proposed))
    if wanted:
        known = {r["kind"] for r in g.arr.where(F.col("kind").isin(wanted)).select("kind").distinct().collect()}
        faults += [f"unknown arrow kind {k}" for k in wanted if k not in known]
    return faults


def is_noun_phrase(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"(?i)^(a|an|the)\s+", "").rlike("^[A-Z]")


def equations_about(equations: DataFrame, element: str, wildcard: bool = False) -> DataFrame:
    """Equations (columns lhs and rhs with src, tgt, arrows) that name an element as an end; with wildcard, whose text
    contains it."""
    if wildcard:
        like = f"%{element}%"
        return equations.where(F.to_json("lhs").ilike(like) | F.to_json("rhs").ilike(like))
    e = F.lit(element)
    return equations.where((F.col("lhs.src") == e) | (F.col("lhs.tgt") == e) | (F.col("rhs.src") == e) | (F.col("rhs.tgt") == e))


def about_element(rules: DataFrame, elements: DataFrame) -> DataFrame:
    """(id, constraint_id): constraints (id, config as JSON text) that concern elements (id, kind, module): those with
    an empty config, and those whose config names the kind or the module. An empty or null module is named by all.

    Constraints are definitions: at most MAX_RULES of them become one literal; more are an error.
    """
    few = rules.select(F.col("id").alias("constraint_id"), F.coalesce("config", F.lit("{}")).alias("config")).limit(MAX_RULES + 1).collect()
    if len(few) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} constraints")
    every = F.from_json(F.lit(json.dumps([r.asDict() for r in few])), "array<struct<constraint_id:string,config:string>>")
    bare = F.regexp_replace("config", r"\s", "").isin("{}", "")
    hit = bare | F.col("config").contains(F.col("kind")) | (F.coalesce("module", F.lit("")) == "") | F.col("config").contains(F.col("module"))
    return elements.select("id", "kind", "module", F.inline(every)).where(hit).select("id", "constraint_id")


def propose_schema(g: Graph, proposal: dict, dry_run: bool = True) -> tuple[list[str], Graph]:
    """Faults of a schema fragment {objects, arrows, equations} and the graph with it added (unchanged if there are
    faults or on a dry run). Objects need noun phrases, arrows must be total with known ends; ids are content hashes."""
    import hashlib
    import re

    phrase = lambda n: bool(re.match(r"[A-Z]", re.sub(r"(?i)^(a|an|the)\s+", "", n.strip())))
    objects, arrows = proposal.get("objects", []), proposal.get("arrows", [])
    faults = [f"{o['name']} is no noun phrase" for o in objects if not phrase(o["name"])]
    names = {o["name"]: "schema:" + hashlib.sha256(json.dumps(o, sort_keys=True).encode()).hexdigest()[:32] for o in objects}
    ends = sorted({x for a in arrows for x in (a["domain"], a["codomain"])} - set(names))
    if ends:
        found = g.elem.where(F.col("name").isin(ends)).groupBy("name").agg(F.min("id").alias("id")).collect()
        names |= {r["name"]: r["id"] for r in found}
    for a in arrows:
        if not a.get("total"):
            faults.append(f"{a['name']} is not total")
        faults += [f"{x} is unknown" for x in (a["domain"], a["codomain"]) if x not in names]
    for e in proposal.get("equations", []):
        faults += validate_equation(g, e, [a["name"] for a in arrows])
    if faults or dry_run:
        return faults, g
    kind = lambda k: k if k in ELEMENT_KINDS else "other"
    elem = g.spark.createDataFrame([(names[o["name"]], kind(o["kind"]), o["name"], o.get("module"), None, json.dumps({"schemaKind": o["kind"]})) for o in objects], g.elem.schema)
    arr = g.spark.createDataFrame([(f"{names[a['domain']]}:{a['name']}:{names[a['codomain']]}", a["name"], names[a["domain"]], names[a["codomain"]], "{}") for a in arrows], g.arr.schema)
    prov = elem.select(F.col("id").alias("elem_id"), F.lit("proposal").alias("source"), F.lit("").alias("commit_sha"), F.lit(0).cast("long").alias("ingested_at"), F.lit("tentative").alias("confidence"))
    return [], Graph(g.elem.unionByName(elem), g.arr.unionByName(arr), g.prov.unionByName(prov))


def one_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by a total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
