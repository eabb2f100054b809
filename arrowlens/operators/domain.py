"""Domain modelling over a code graph: noun phrases, type-driven discovery, extension along calls, shared targets,
mapping of briefs, and removal of duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from arrowlens.operators.constraints import one_per
from arrowlens.operators.graph import Graph, arrow_id, one_row
from arrowlens.runtime import Scratch

#: Abbreviations that noun phrases spell out.
ABBREVIATIONS = {
    "Elem": "Element", "Arr": "Arrow", "Prov": "Provenance", "Val": "Value", "Cfg": "Configuration", "Msg": "Message",
    "Err": "Error", "Req": "Request", "Res": "Response", "Impl": "Implementation", "Attr": "Attribute",
    "Prop": "Property", "Spec": "Specification", "Ctor": "Constructor", "Lhs": "Left-Hand Side",
    "Rhs": "Right-Hand Side", "Src": "Source", "Dst": "Destination", "Id": "ID",
}


def with_article(noun: Column) -> Column:
    return F.concat(F.when(noun.rlike("^[AEIOUaeiou]"), "an ").otherwise("a "), noun)


def noun_phrase(name: Column, abbreviations: dict[str, str] | None = None) -> Column:
    """'a Graph Element' for the type name GraphElem: cut where capitals begin, abbreviations spelled out, article by
    the first vowel. Words of other styles are left as they are."""
    known = F.create_map(*(F.lit(x) for kv in (ABBREVIATIONS if abbreviations is None else abbreviations).items() for x in kv))
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.filter(F.split(spaced, " "), lambda w: w != "")
    return with_article(F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w)), " "))


def capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))


def noun_phrase_of_name(name: Column, abbreviations: dict[str, str] | None = None) -> Column:
    """Noun phrase of a name in any style, without what stands before its last slash. Words between dashes or, if
    there are none, underscores are capitalised and not spelled out; other names are read as type names."""
    local = F.element_at(F.split(name, "/"), -1)

    def parts(mark: str) -> Column:
        return with_article(F.array_join(F.transform(F.filter(F.split(local, mark), lambda w: w != ""), capitalised), " "))

    return F.when(local.contains("-"), parts("-")).when(local.contains("_"), parts("_")).otherwise(noun_phrase(capitalised(local), abbreviations))


def is_external(module: Column, exclude: Sequence[str] = ()) -> Column:
    out = module.isNull() | module.startswith("node:")
    for x in exclude:
        out = out | module.rlike(x)
    return out


def existing_concepts(g: Graph) -> DataFrame:
    """(code_id, concept_id): the domain element that each code element implements; of several the greatest id."""
    d = g.elem.where("kind = 'domain'").select(F.col("id").alias("src_id"))
    return g.arr.where("kind = 'implementedAs'").join(d, "src_id", "left_semi").groupBy(F.col("dst_id").alias("code_id")).agg(F.max("src_id").alias("concept_id"))


def pullbacks(g: Graph, scope: str | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """(code_id, n, domains): code elements that two or more domain elements are implemented as."""
    d = g.elem.where("kind = 'domain'").select(F.col("id").alias("src_id"))
    shared = g.arr.where("kind = 'implementedAs'").join(d, "src_id", "left_semi").select("src_id", F.col("dst_id").alias("code_id")).distinct()
    many = shared.groupBy("code_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("src_id")).alias("domains")).where("n >= 2")
    code = g.elem.where(~is_external(F.col("module"), exclude))
    if scope:
        code = code.where(F.col("module").rlike(scope))
    return many.join(code.select(F.col("id").alias("code_id")), "code_id", "left_semi")


def shared_targets(g: Graph, kind: str, src_kind: str, least: int = 2) -> DataFrame:
    """(dst_id, n): elements that `least` or more different elements of a kind point at by a kind of arrow."""
    d = g.elem.where(F.col("kind") == src_kind).select(F.col("id").alias("src_id"))
    pairs = g.arr.where(F.col("kind") == kind).join(d, "src_id", "left_semi").select("src_id", "dst_id").distinct()
    return pairs.groupBy("dst_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def candidates(g: Graph, kinds: Sequence[str] = ("interface", "type", "class"), scope: str | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """(candidate, phrase, kind): structured types of the project as proposed concepts."""
    code = g.elem.where(F.col("kind").isin(list(kinds)) & ~is_external(F.col("module"), exclude))
    if scope:
        code = code.where(F.col("module").rlike(scope))
    return code.select(F.col("id").alias("candidate"), noun_phrase(F.col("name")).alias("phrase"), "kind")


def _properties(g: Graph, cand: DataFrame) -> DataFrame:
    """(candidate, property, field, type_text, optional, many, record): the properties of candidates. field is the
    name after the first dot; many marks arrays and record types without a name of their own."""
    has = g.arr.where("kind = 'hasProperty'").select(F.col("src_id").alias("candidate"), F.col("dst_id").alias("property")).distinct()
    name = F.col("name")
    field = F.when(name.contains("."), F.substr(name, F.position(F.lit("."), name) + 1)).otherwise(name)
    type_text = F.coalesce(F.get_json_object("attrs", "$.typeText"), F.lit(""))
    optional = F.coalesce(F.get_json_object("attrs", "$.optional") == "true", F.lit(False))
    many = type_text.contains("[]") | type_text.contains("Array<")
    record = type_text.contains("Record<") | (type_text.startswith("{") & ~type_text.contains("null"))
    props = g.elem.select(F.col("id").alias("property"), field.alias("field"), type_text.alias("type_text"), optional.alias("optional"), many.alias("many"), record.alias("record"))
    return cand.select("candidate").join(has, "candidate").join(props, "property")


def field_arrows(g: Graph, kinds: Sequence[str] = ("interface", "type", "class"), scope: str | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """(candidate, phrase, name, property, codomain, codomain_kind, total, source, confidence, question): the arrows
    that discovery proposes.

    Each typed property of a candidate gives an arrow `has <field>`, each extends or implements that ends at a
    candidate or concept an arrow of that name. The codomain is another candidate, else the concept that exists for
    the type, else the raw type. An optional property or an array gives a partial arrow and a question.
    """
    cand = candidates(g, kinds, scope, exclude)
    typed = g.arr.where("kind = 'hasType'").select(F.col("src_id").alias("property"), F.col("dst_id").alias("type_id")).distinct()
    fields = _properties(g, cand).join(typed, "property").select("candidate", F.concat(F.lit("has "), "field").alias("name"), "property", "field", "optional", "many", "type_id", F.lit("field").alias("source"))
    heritage = g.arr.where(F.col("kind").isin("extends", "implements")).select(F.col("src_id").alias("candidate"), F.col("kind").alias("name"), F.col("dst_id").alias("type_id")).distinct()
    none, no = F.lit(None).cast("string"), F.lit(False)
    heirs = heritage.join(cand.select("candidate"), "candidate", "left_semi").select("candidate", "name", none.alias("property"), none.alias("field"), no.alias("optional"), no.alias("many"), "type_id", F.col("name").alias("source"))
    other = cand.select(F.col("candidate").alias("type_id"), F.col("phrase").alias("type_phrase"))
    known = existing_concepts(g).select(F.col("code_id").alias("type_id"), "concept_id")
    types = g.elem.select(F.col("id").alias("type_id"), F.col("name").alias("type_name"))
    rows = fields.unionByName(heirs).join(types, "type_id").join(other, "type_id", "left").join(known, "type_id", "left").join(cand.select("candidate", "phrase"), "candidate")
    kind = F.when(F.col("type_phrase").isNotNull(), "candidate").when(F.col("concept_id").isNotNull(), "concept").otherwise("type")
    question = F.when(F.col("optional"), F.concat(F.lit("Is "), "field", F.lit(" total although it is optional?"))).when(F.col("many"), F.concat(F.lit("Should "), "type_name", F.lit(" be an object of its own, as "), "field", F.lit(" is an array?")))
    return rows.where((F.col("source") == "field") | (kind != "type")).select(
        "candidate", "phrase", "name", "property", F.when(kind == "concept", F.col("concept_id")).otherwise(F.col("type_id")).alias("codomain"), kind.alias("codomain_kind"),
        (~F.col("optional") & ~F.col("many")).alias("total"), "source", F.when(kind == "type", "unresolved").otherwise("resolved").alias("confidence"), question.alias("question"),
    )


def candidate_questions(g: Graph, kinds: Sequence[str] = ("interface", "type", "class"), scope: str | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """(candidate, about): what discovery asks of a candidate itself: `alias` of a type without properties, and the
    fields that are untyped records."""
    cand = candidates(g, kinds, scope, exclude)
    props = _properties(g, cand)
    alias = cand.where("kind = 'type'").select("candidate").join(props.select("candidate").distinct(), "candidate", "left_anti").select("candidate", F.lit("alias").alias("about"))
    typed = g.arr.where("kind = 'hasType'").select(F.col("src_id").alias("property")).distinct()
    records = props.where("record").join(typed, "property", "left_anti").select("candidate", F.col("field").alias("about")).distinct()
    return alias.unionByName(records)


def labels_of(g: Graph) -> DataFrame:
    """(code_id, concept): the domain element of each code element that has any; of several the smallest id."""
    d = g.elem.where("kind = 'domain'").select(F.col("id").alias("src_id"))
    return g.arr.where("kind = 'implementedAs'").join(d, "src_id", "left_semi").groupBy(F.col("dst_id").alias("code_id")).agg(F.min("src_id").alias("concept"))


def kan_extension(g: Graph, labels: DataFrame | None = None, depth: int = 2, call_kind: str = "callerOf", callee_kinds: Sequence[str] = ("function", "method", "const"), exclude: Sequence[str] = ()) -> DataFrame:
    """(concept, dst, via_start, distance, status): arrows between concepts along calls.

    labels: (code_id, concept), by default `labels_of`. From each labelled element calls are followed breadth first,
    each element once per start, from the smallest caller of those nearest to the start. The arrow begins at the
    concept of the *caller*: its label, or the caller itself as a new concept. It is resolved if the callee has a
    label and tentative if the callee becomes a new concept. Of several ways to the same (concept, dst) the shortest
    stays, then the smallest start. A labelled element that is not of callee_kinds also starts from its members
    (incoming memberOf), which speak for its concept.
    """
    label = one_per(labels if labels is not None else labels_of(g), ["code_id"], [F.col("concept")])
    walk = g.elem.where(F.col("kind").isin(list(callee_kinds)) & ~is_external(F.col("module"), exclude)).select(F.col("id").alias("node"))
    own = label.select(F.col("code_id").alias("start"), F.col("code_id").alias("node"), "concept")
    still = g.elem.where(~F.col("kind").isin(list(callee_kinds))).select(F.col("id").alias("start"))
    members = g.arr.where("kind = 'memberOf'").select(F.col("src_id").alias("node"), F.col("dst_id").alias("start")).distinct()
    inner = own.drop("node").join(still, "start", "left_semi").join(members, "start").where("node <> start").select("start", "node", "concept")
    seen = own.unionByName(inner).withColumn("distance", F.lit(0))
    calls = g.arr.where(F.col("kind") == call_kind).select(F.col("src_id").alias("caller"), F.col("dst_id").alias("node")).distinct().join(walk, "node", "left_semi")
    known = label.select(F.col("code_id").alias("node"), F.col("concept").alias("to"))
    scratch, rows = Scratch(g.spark, "kan"), None
    for d in range(1, depth + 1):
        edge = seen.where(F.col("distance") == d - 1).select("start", F.col("node").alias("caller"), F.col("concept").alias("of")).join(calls, "caller")
        first = edge.groupBy("start", "node").agg(F.min(F.struct("caller", "of")).alias("m")).select("start", "node", F.col("m.of").alias("of"))
        fresh = first.join(seen.select("start", "node"), ["start", "node"], "left_anti").join(known, "node", "left")
        level = scratch.write(fresh.select("start", "node", "of", F.coalesce("to", "node").alias("concept"), F.when(F.col("to").isNotNull(), "resolved").otherwise("tentative").alias("status")), f"level{d}")
        seen = seen.unionByName(level.select("start", "node", "concept", F.lit(d).alias("distance")))
        here = level.select(F.col("of").alias("concept"), F.col("concept").alias("dst"), F.col("start").alias("via_start"), F.lit(d).alias("distance"), "status")
        rows = here if rows is None else rows.unionByName(here)
    if rows is None:
        return g.spark.createDataFrame([], "concept string, dst string, via_start string, distance int, status string")
    return one_per(rows, ["concept", "dst"], [F.col("distance"), F.col("via_start"), F.col("status")])


def functor_mapping(g: Graph, brief: DataFrame, most: int = 10) -> DataFrame:
    """(brief_id, mapping, n, candidates): brief has id, kind, name. Exactly one element of that kind and name makes
    an element 'existing', several 'ambiguous', none 'to-create'; at most `most` candidate ids, the smallest."""
    hit = brief.select(F.col("id").alias("brief_id"), "kind", "name").join(g.elem.select("kind", "name", F.col("id").alias("elem_id")), ["kind", "name"], "left")
    n = hit.groupBy("brief_id").agg(F.count("elem_id").alias("n"), F.slice(F.array_sort(F.collect_list("elem_id")), 1, most).alias("candidates"))
    return n.select("brief_id", F.when(F.col("n") == 0, "to-create").when(F.col("n") == 1, "existing").otherwise("ambiguous").alias("mapping"), "n", "candidates")


def keepers(g: Graph, keyed: DataFrame) -> DataFrame:
    """(key, id, keeper): keyed has key and id; of equal keys the element with most arrows stays, then the smallest id."""
    ranked = keyed.join(g.degree(keyed.select("id").distinct()), "id")
    best = one_per(ranked, ["key"], [F.desc("degree"), F.col("id")]).select("key", F.col("id").alias("keeper"))
    return ranked.join(best, "key").select("key", "id", "keeper")


def merge_duplicates(g: Graph, kept: DataFrame) -> Graph:
    """The graph with arrows re-pointed to keepers, their ids made anew, arrows that became equal kept once, and the
    other elements removed."""
    moved = kept.where("id <> keeper").select("id", "keeper")
    a = g.arr.select("*", F.col("src_id").alias("was_src"), F.col("dst_id").alias("was_dst"))
    for end in ("src_id", "dst_id"):
        m = moved.select(F.col("id").alias(end), F.col("keeper").alias("to"))
        a = a.join(m, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    new_id = F.when((F.col("src_id") != F.col("was_src")) | (F.col("dst_id") != F.col("was_dst")), arrow_id(F.col("src_id"), F.col("kind"), F.col("dst_id"))).otherwise(F.col("id"))
    arr = one_row(a.withColumn("id", new_id).select(g.arr.columns))
    gone = moved.select("id")
    return Graph(g.elem.join(gone, "id", "left_anti").select(g.elem.columns), arr, g.prov.join(gone.withColumnRenamed("id", "elem_id"), "elem_id", "left_anti").select(g.prov.columns))


def refine(candidates: DataFrame, responses: DataFrame) -> DataFrame:
    """Session candidates (id, code_id, name, status, arrows) after responses (id, status, name_override, arrows): new
    status and name; arrows take status and total from the response's arrow of their name; arrows to candidates that
    are rejected go. arrows: array<struct<name, dst, status, total>>."""
    r = responses.select("id", F.col("status").alias("new_status"), "name_override", F.col("arrows").alias("changes"))
    out = candidates.join(r, "id", "left").select("id", "code_id", F.coalesce("name_override", "name").alias("name"), F.coalesce("new_status", "status").alias("status"), "arrows", "changes")

    def changed(a: Column) -> Column:
        c = F.get(F.filter("changes", lambda c: c["name"] == a["name"]), F.lit(0))
        return F.struct(a["name"].alias("name"), a["dst"].alias("dst"), F.coalesce(c["status"], a["status"]).alias("status"), F.coalesce(c["total"], a["total"]).alias("total"))

    out = out.withColumn("arrows", F.transform("arrows", changed)).drop("changes")
    rejected = out.where("status = 'rejected'").select(F.col("id").alias("dst"))
    kept = out.select("id", F.posexplode("arrows").alias("pos", "a")).withColumn("dst", F.col("a.dst")).join(rejected, "dst", "left_anti").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "a"))).alias("x"))
    none = F.filter("arrows", lambda _: F.lit(False))
    return out.join(kept, "id", "left").select("id", "code_id", "name", "status", F.coalesce(F.transform("x", lambda e: e["a"]), none).alias("arrows"))


def commit(g: Graph, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements, arrows) that accepted candidates (id, code_id, name, status, arrows) add: a domain element unless
    one exists for the code element, its implementedAs bridge, and an arrow of kind other per proposed arrow whose
    end is accepted or exists; ids are `src:label-with-dashes:dst`."""
    ok = candidates.where("status = 'accepted'").join(existing_concepts(g), "code_id", "left").withColumn("domain_id", F.coalesce("concept_id", F.concat(F.lit("domain:"), "id")))
    fresh = ok.where("concept_id IS NULL")
    elem = fresh.select(F.col("domain_id").alias("id"), F.lit("domain").alias("kind"), "name", F.lit(None).cast("string").alias("module"), F.lit(None).cast("string").alias("span"), F.lit("{}").alias("attrs"))
    bridge = fresh.select(arrow_id(F.col("domain_id"), F.lit("implementedAs"), F.col("code_id")).alias("id"), F.lit("implementedAs").alias("kind"), F.col("domain_id").alias("src_id"), F.col("code_id").alias("dst_id"), F.lit("{}").alias("attrs"))
    ends = ok.select(F.col("id").alias("dst"), F.col("domain_id").alias("to")).unionByName(g.elem.where("kind = 'domain'").select(F.col("id").alias("dst"), F.col("id").alias("to")))
    a = ok.select(F.col("domain_id").alias("src_id"), F.explode("arrows").alias("a")).where("a.status = 'accepted'").withColumn("dst", F.col("a.dst")).join(ends, "dst")
    label = F.regexp_replace("a.name", " ", "-")
    arrows = a.select(arrow_id(F.col("src_id"), label, F.col("to")).alias("id"), F.lit("other").alias("kind"), "src_id", F.col("to").alias("dst_id"), F.to_json(F.struct(F.col("a.name").alias("name"), F.col("a.total").alias("total"))).alias("attrs"))
    return elem, one_row(bridge.unionByName(arrows))
