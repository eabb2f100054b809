"""Similarity and context of an element: analogues, what it must call, what uses it, imports, and one nested brief."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from arrowlens.operators.constraints import about_element, first_provenance
from arrowlens.operators.graph import Graph
from arrowlens.operators.traverse import related
from arrowlens.runtime import Scratch
from arrowlens.sources.snippets import element_spans, signature, snippet

CALLS = ("callerOf", "calls")


def _facts(g: Graph, asked: DataFrame, top: int, calls: Sequence[str], working_set: DataFrame | None, other_module: bool, concepts: DataFrame | None = None) -> DataFrame:
    """(num, id, known, kind, name, module, bonus, asked, near, called, rest, n, b0, b1, concepts, callees), stored: one row for each
    element, asked id and id that calls something, all brought together in one shuffle.

    near has the first `top` of the elements that share kind and name with an asked one, called the ends of callerOf
    arrows, rest those of the other kinds of `calls`, callees all; n counts a missing end as one more. b0 and b1 are the 128 bits that
    the callees set, num is a number of the row.
    """
    scratch = Scratch(g.spark, "facts")
    e = g.elem.where("id IS NOT NULL").select("id", "kind", "name", "module")
    if working_set is not None:
        e = e.join(working_set.select("id", F.lit(0.3).alias("bonus")).distinct(), "id", "left").withColumn("bonus", F.coalesce("bonus", F.lit(0.0)))
    else:
        e = e.withColumn("bonus", F.lit(0.0))
    t = asked.where("id IS NOT NULL").select("id").distinct().join(e.drop("bonus"), "id", "left")
    # those of the target's own module, or itself, are `top` or one of the first at most
    among = lambda *keys: F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc("bonus"), "id"))
    first = e.join(t.select("kind", "name").distinct(), ["kind", "name"], "left_semi")
    if other_module:
        first = first.withColumn("_rn", among("kind", "name", "module")).where(F.col("_rn") <= top)
    first = first.withColumn("_rn", among("kind", "name")).where(F.col("_rn") <= (2 * top if other_module else top + 1))
    first = scratch.write(first.groupBy("kind", "name").agg(F.array_sort(F.collect_list(F.struct((-F.col("bonus")).alias("less"), "id", "module"))).alias("first")), "first")
    apart = lambda x: (x["id"] != F.col("id")) & ~(x["module"].eqNullSafe(F.col("module")) if other_module else F.lit(False))
    near = F.transform(F.slice(F.filter("first", apart), 1, top), lambda x: F.struct(x["id"].alias("id"), (-x["less"]).alias("bonus")))
    t = t.join(first, ["kind", "name"], "left").select("id", F.coalesce(near, F.array().cast("array<struct<id: string, bonus: double>>")).alias("near"))

    said = {"e": "struct<kind: string, name: string, module: string, bonus: double>", "near": "array<struct<id: string, bonus: double>>", "concept": "string"}

    def rows(df: DataFrame, **has) -> DataFrame:
        no_end = (F.lit(None).cast("string").alias("dst_id"), F.lit(None).cast("boolean").alias("main"))
        return df.select("id", *no_end, F.struct(*(has.get(k, F.lit(None)).cast(v).alias(k) for k, v in said.items())).alias("x"))

    arrows = g.arr.where(F.col("kind").isin(list(calls)) & F.col("src_id").isNotNull())
    every = arrows.select(F.col("src_id").alias("id"), "dst_id", (F.col("kind") == "callerOf").alias("main"), F.lit(None).cast("struct<" + ", ".join(f"{k}: {v}" for k, v in said.items()) + ">").alias("x"))
    every = every.unionByName(rows(e, e=F.struct("kind", "name", "module", "bonus"))).unionByName(rows(t, near=F.col("near")))
    if concepts is not None:
        every = every.unionByName(rows(concepts.withColumnRenamed("code", "id"), concept=F.col("concept")))
    place = F.xxhash64("dst_id")
    bits = lambda half: F.coalesce(F.bit_or(F.when(F.col("dst_id").isNotNull() & (place.bitwiseAND(64) == half), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int")))), F.lit(0).cast("long"))
    found = every.repartition("id").groupBy("id").agg(
        F.max("x.e").alias("e"), F.max("x.near").alias("near"), F.collect_set("x.concept").alias("concepts"),
        F.collect_set(F.when(F.col("main"), F.col("dst_id"))).alias("called"), F.collect_set(F.when(~F.col("main"), F.col("dst_id"))).alias("rest"),
        F.max((F.col("main").isNotNull() & F.col("dst_id").isNull()).cast("int")).alias("endless"), bits(0).alias("b0"), bits(64).alias("b1"),
    )
    callees = F.when(F.size("rest") == 0, F.col("called")).otherwise(F.array_union("called", "rest"))
    found = found.select(F.monotonically_increasing_id().alias("num"), "id", F.col("e").isNotNull().alias("known"), "e.*", F.col("near").isNotNull().alias("asked"), "near", "called", "rest", (F.size(callees) + F.col("endless")).alias("n"), "b0", "b1", "concepts")
    found = scratch.write(found, "facts")
    scratch.free()
    return found.withColumn("callees", callees)  # called is not stored twice


def _alike(facts: DataFrame, top: int, least: float) -> DataFrame:
    """(target, id, both, t_n, n, bonus, ...): pairs of an asked element that has `top` near ones and one of its kind whose
    Jaccard of callees is `least` or more, found by prefixes.

    Callees stand in the order of a hash. Two sets that are so much alike share one of the first n - least * n + 1 of
    either; where it stands and which bits of 128 the callees set bound what they can share. What remains is compared.
    """
    scratch = Scratch(facts.sparkSession, "alike")
    sets = facts.where("known AND kind IS NOT NULL AND size(callees) > 0")
    keys = sets.select("num", "n", "b0", "b1", (F.col("asked") & (F.size(F.coalesce("near", F.array())) >= top)).alias("tight"), F.sort_array(F.transform("callees", lambda c: F.xxhash64(c, F.col("kind")))).alias("keys"))
    index = keys.select("num", "n", "b0", "b1", "tight", F.size("keys").alias("m"), F.posexplode(F.slice("keys", 1, F.greatest(F.lit(0), F.size("keys") - F.ceil(F.col("n") * least - 1e-6).cast("int") + 1))).alias("p", "key"))
    index = index.withColumn("left", F.col("m") - F.col("p")).drop("p").repartition("key")
    # each pair is met once, of one index that is shuffled once, and then looked at from both sides
    t, c = index.alias("t"), index.alias("c")
    need = F.expr(f"(t.n + c.n) * {least / (1 + least)!r}D - 1e-6D")
    other = lambda a, b: F.expr(f"{a}.m - bit_count({a}.b0 & ~{b}.b0) - bit_count({a}.b1 & ~{b}.b1)")
    near = t.join(c, (F.col("t.key") == F.col("c.key")) & (F.col("t.num") < F.col("c.num")) & (F.col("t.tight") | F.col("c.tight")) & (F.least("t.left", "c.left") >= need) & (F.least(other("t", "c"), other("c", "t")) >= need))
    side = lambda a, b: F.when(F.col(f"{a}.tight"), F.struct(F.col(f"{a}.num").alias("t_num"), F.col(f"{b}.num").alias("num")))
    pairs = scratch.write(near.select(F.inline(F.array_compact(F.array(side("t", "c"), side("c", "t"))))).distinct(), "pairs")
    scratch.free()
    t = sets.select(F.col("num").alias("t_num"), F.col("id").alias("target"), F.col("kind").alias("t_kind"), F.col("name").alias("t_name"), F.col("module").alias("t_module"), F.col("callees").alias("t_callees"), F.col("n").alias("t_n"))
    both = F.size(F.array_intersect("t_callees", "callees"))
    return pairs.join(t, "t_num").join(sets, "num").withColumn("both", both).where(F.col("both") >= (F.col("t_n") + F.col("n") - F.col("both")) * least - 1e-6)


def _ranked(facts: DataFrame, top: int, bonus: bool, other_module: bool) -> DataFrame:
    """(target, id, similarity, rank) of the asked elements. Where `top` elements share kind and name, each of which
    makes 0.5, only pairs that reach 0.5 are looked for; elsewhere all that share a callee are."""

    def rows(df: DataFrame) -> DataFrame:
        df = df.where("id <> target AND kind = t_kind")
        if other_module:
            df = df.where("NOT (module <=> t_module)")
        return df.select("target", "id", "both", "t_n", "n", "bonus", F.coalesce(F.col("name") == F.col("t_name"), F.lit(False)).alias("named"))

    no_n = F.lit(None).cast("int")
    pairs = facts.where("asked AND known").select(F.col("id").alias("target"), F.inline("near")).select("target", "id", F.lit(0).alias("both"), no_n.alias("t_n"), no_n.alias("n"), "bonus", F.lit(True).alias("named"))
    pairs = pairs.unionByName(rows(_alike(facts, top, 0.2 if bonus else 0.5)))
    callers = facts.where("known AND kind IS NOT NULL AND size(callees) > 0")
    few = callers.where(F.col("asked") & (F.size("near") < top))
    if not few.isEmpty():
        few = few.select(F.col("id").alias("target"), F.col("kind").alias("t_kind"), F.col("name").alias("t_name"), F.col("module").alias("t_module"), F.col("n").alias("t_n"), F.explode("callees").alias("dst_id"))
        pairs = pairs.unionByName(rows(few.join(callers.select("id", "kind", "name", "module", "n", "bonus", F.explode("callees").alias("dst_id")), "dst_id").withColumn("both", F.lit(1))))
    # all that a pair needs comes with it, so that pairs are shuffled once: by target, which serves sum and rank
    pairs = pairs.repartition("target").groupBy("target", "id").agg(F.sum("both").alias("both"), *(F.max(c).alias(c) for c in ("t_n", "n", "bonus", "named")))
    jaccard = F.when(F.col("both") > 0, F.col("both") / (F.col("t_n") + F.col("n") - F.col("both"))).otherwise(0.0)
    score = F.least(F.lit(1.0), F.greatest(jaccard, F.when(F.col("named"), 0.5).otherwise(0.0)) + F.col("bonus"))
    w = Window.partitionBy("target").orderBy(F.desc("similarity"), "id")
    return pairs.select("target", "id", score.alias("similarity")).where("similarity > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def analogues(g: Graph, targets: DataFrame, top: int = 3, calls: Sequence[str] = CALLS, working_set: DataFrame | None = None, other_module: bool = True) -> DataFrame:
    """(target, id, similarity, rank): for each target the elements of its kind, in other modules, most like it.

    similarity = min(1, max(Jaccard of callees, 0.5 if the names are equal) + 0.3 if in the working set); 0 is left
    out. Candidates come from an inverted index of callees, so that only pairs that share something are compared, and
    of each name from the elements that come first: of all that share but the name these are the best.
    """
    return _ranked(_facts(g, targets, top, calls, working_set, other_module), top, working_set is not None, other_module)


def must_call(g: Graph, ids: DataFrame) -> DataFrame:
    return related(g, ids, ["callerOf"], "out")


def must_implement(g: Graph, ids: DataFrame) -> DataFrame:
    return related(g, ids, ["implements"], "both")


def used_by(g: Graph, ids: DataFrame) -> DataFrame:
    return related(g, ids, ["callerOf"], "in", once=True)


def imports_of(g: Graph, module: str | None = None) -> DataFrame:
    """(module, import_id, name, source): import elements of modules and where they come from (the arrow's destination,
    or the module that its attrs name)."""
    i = g.elem.where("kind = 'import'")
    if module is not None:
        i = i.where(F.col("module") == module)
    a = g.arr.where("kind = 'importsFrom'").groupBy(F.col("src_id").alias("id")).agg(F.min(F.struct("dst_id", "attrs")).alias("m"))
    source = F.coalesce(F.get_json_object("m.attrs", "$.module"), F.regexp_replace("m.dst_id", "^module:", ""))
    return i.join(a, "id", "left").select("module", F.col("id").alias("import_id"), "name", source.alias("source"))


def missing_imports(g: Graph, ids: DataFrame) -> DataFrame:
    """(from_id, id): elements that must be called, in other modules, of which the caller's module imports none."""
    called = must_call(g, ids).select("from_id", "id", F.col("module").alias("needs")).join(g.elem.select(F.col("id").alias("from_id"), F.col("module").alias("own")), "from_id")
    away = called.where("needs IS NOT NULL AND own IS NOT NULL AND needs <> own")
    have = imports_of(g).where("source IS NOT NULL").select(F.col("module").alias("own"), "source").distinct()
    ok = away.join(have, "own").where((F.col("needs") == F.col("source")) | F.col("needs").endswith(F.concat(F.lit("/"), F.col("source")))).select("from_id", "id")
    return away.join(ok, ["from_id", "id"], "left_anti").select("from_id", "id").distinct()


def second_level(g: Graph, ids: DataFrame, most: int = 5) -> DataFrame:
    """(from_id, callee, second): of each callee its first `most` callees by id."""
    first = must_call(g, ids).select("from_id", F.col("id").alias("callee")).distinct()
    calls = g.arr.where("kind = 'callerOf'").select(F.col("src_id").alias("callee"), F.col("dst_id").alias("second")).distinct()
    w = Window.partitionBy("from_id", "callee").orderBy("second")
    return first.join(calls, "callee").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).select("from_id", "callee", "second")


def domain_context(g: Graph, ids: DataFrame) -> DataFrame:
    """(from_id, via, concept): own concepts and those of callers and callees, each (via, concept) once."""
    concept = related(g, g.elem.select("id"), ["implementedAs"], "in").where("kind = 'domain'").select(F.col("from_id").alias("code"), F.col("id").alias("concept"))
    own = ids.select(F.col("id").alias("from_id"), F.lit("own").alias("via"), F.col("id").alias("code"))
    near = related(g, ids, ["callerOf"], "out").select("from_id", F.lit("callee").alias("via"), F.col("id").alias("code")).unionByName(related(g, ids, ["callerOf"], "in").select("from_id", F.lit("caller").alias("via"), F.col("id").alias("code")))
    return own.unionByName(near).join(concept, "code").select("from_id", "via", "concept").distinct()


def inspect(g: Graph, ids: DataFrame, equations: DataFrame | None = None, rules: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """(id, kind, name, module, outgoing, incoming, provenance) and, where their tables are given, equations,
    constraints and snippet: one row per element, arrows as sorted lists with the derived ones among the outgoing."""
    keep = ids.select("id").distinct()
    e = keep.join(g.elem, "id")
    arrows = g.arr.select("kind", "src_id", "dst_id")
    near = lambda df, end: df.join(keep.withColumnRenamed("id", end), end, "left_semi")
    out = near(arrows.unionByName(g.derived().select("kind", "src_id", "dst_id")), "src_id").groupBy(F.col("src_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("kind", F.col("dst_id").alias("other")))).alias("outgoing"))
    inn = near(arrows, "dst_id").groupBy(F.col("dst_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("kind", F.col("src_id").alias("other")))).alias("incoming"))
    p = first_provenance(g).select(F.col("elem_id").alias("id"), F.struct("source", "commit_sha", "confidence").alias("provenance"))
    rows = e.join(out, "id", "left").join(inn, "id", "left").join(p, "id", "left").select("id", "kind", "name", "module", "span", "outgoing", "incoming", "provenance")
    if equations is not None:
        ends = equations.select(F.col("id").alias("equation"), F.explode(F.array_distinct(F.array("lhs.src", "lhs.tgt", "rhs.src", "rhs.tgt"))).alias("id"))
        rows = rows.join(ends.groupBy("id").agg(F.array_sort(F.collect_set("equation")).alias("equations")), "id", "left")
    if rules is not None:
        rows = rows.join(about_element(rules, e).groupBy("id").agg(F.array_sort(F.collect_set("constraint_id")).alias("constraints")), "id", "left")
    if files is not None:
        rows = rows.join(snippet(files, element_spans(e)).withColumnRenamed("elem_id", "id"), "id", "left")
    return rows.drop("span")


#: What a finished task must show, by the kind of task.
CRITERIA = {
    "write_function_body": ("compiles", "calls all that it must call", "returns what the signature says", "leaves signature and exports as they are", "is written like its analogues"),
    "write_test": ("compiles", "imports the target", "has a case for each function that must be called", "is written like its analogues", "lies in a test file"),
    "write_migration": ("compiles", "may run twice", "uses the database client of the project", "goes up and down where that is asked for"),
    "rewrite_body": ("compiles", "keeps signature and exports", "calls all that it must call", "brings no new dependency", "is better by the criteria given"),
    "write_documentation": ("is a valid comment", "names every parameter", "names the result", "has an example where analogues have one", "names the errors thrown"),
}


def brief(g: Graph, ids: DataFrame, top: int = 3, files: DataFrame | None = None, task: str | None = None, snippet_lines: int = 50) -> DataFrame:
    """(id, must_call, used_by, must_implement, analogues, missing_imports, concepts, second_level, confidence) and,
    where files or a task are given, signature, body and criteria: one nested row per element.

    confidence is `resolved` if the first provenance row says so, `mixed` if it says something else, `unresolved`
    without any. The body has `snippet_lines` lines of the element's span at most.
    """
    keep = ids.select("id").distinct()
    concept = related(g, g.elem.select("id"), ["implementedAs"], "in").where("kind = 'domain'").select(F.col("from_id").alias("code"), F.col("id").alias("concept"))
    facts = _facts(g, keep, top, CALLS, None, True, concept)

    # a call is joined with its callee once, and goes once to whom it concerns: the caller, the callee, or both
    end = facts.select(F.col("id").alias("dst_id"), "known", "asked", "module", F.slice(F.sort_array("called"), 1, 5).alias("second"), "concepts")
    call = facts.where("asked OR known").select(F.col("id").alias("src_id"), F.col("known").alias("src_known"), F.col("asked").alias("src_asked"), F.col("module").alias("src_module"), F.col("concepts").alias("src_concepts"), F.explode("called").alias("dst_id")).join(end, "dst_id")
    none = F.lit(None)
    out = F.struct(F.col("src_id").alias("from_id"), F.lit(True).alias("out"), F.col("dst_id").alias("other"), F.when(F.col("module") != F.col("src_module"), F.col("module")).alias("needs"), "second", F.col("concepts").alias("theirs"))
    inn = F.struct(F.col("dst_id").alias("from_id"), F.lit(False).alias("out"), F.col("src_id").alias("other"), none.cast("string").alias("needs"), none.cast("array<string>").alias("second"), F.col("src_concepts").alias("theirs"))
    call = call.select(F.inline(F.array_compact(F.array(F.when(F.col("src_asked") & F.col("known"), out), F.when(F.col("asked") & F.col("src_known"), inn)))))
    own = facts.where("asked").select("id", F.col("module").alias("own"), "concepts")
    out = own.join(call, own["id"] == call["from_id"], "left").groupBy("id").agg(F.first("own").alias("own"), F.first("concepts").alias("concepts"), F.collect_list(F.when(F.col("from_id").isNotNull(), F.struct("out", "other", "needs", "second", "theirs"))).alias("calls"))

    # modules' imports are stored as they are few, or known to be many
    have = imports_of(g).where("source IS NOT NULL AND module IS NOT NULL").groupBy(F.col("module").alias("own")).agg(F.collect_set("source").alias("sources"))
    out = out.join(Scratch(g.spark, "imports").write(have, "imports"), "own", "left")
    called, callers = F.filter("calls", lambda c: c["out"]), F.filter("calls", lambda c: ~c["out"])
    met = lambda c: F.exists("sources", lambda s: (c["needs"] == s) | c["needs"].endswith(F.concat(F.lit("/"), s)))
    away = F.filter("called", lambda c: c["needs"].isNotNull())
    away = F.when(F.col("sources").isNull(), away).otherwise(F.filter(away, lambda c: ~met(c)))
    others = lambda items: F.transform(items, lambda c: c["other"])
    near = lambda items: F.array_distinct(F.flatten(F.transform(items, lambda c: c["theirs"])))
    via = lambda items, name: F.transform(items, lambda x: F.struct(F.lit(name).alias("via"), x.alias("concept")))
    seconds = F.flatten(F.transform("called", lambda c: F.transform(c["second"], lambda x: F.struct(c["other"].alias("callee"), x.alias("second")))))
    lists = {"must_call": others("called"), "used_by": others("callers"), "missing_imports": others(away), "second_level": seconds}
    lists["concepts"] = F.concat(via("concepts", "own"), via(near("called"), "callee"), via(near("callers"), "caller"))
    out = out.select("id", "sources", "concepts", called.alias("called"), callers.alias("callers")).select("id", *(F.array_sort(items).alias(name) for name, items in lists.items()))
    out = out.select("id", *(F.when(F.size(name) > 0, F.col(name)).alias(name) for name in lists))

    def listed(df: DataFrame, key: str, item, name: str) -> DataFrame:
        return df.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_set(item)).alias(name))

    held = first_provenance(g).select(F.col("elem_id").alias("id"), F.when(F.col("confidence") == "resolved", "resolved").otherwise("mixed").alias("confidence"))
    # few of those that have such arrows may be asked: these are found first
    ends = g.arr.where("kind = 'implements'").select(F.explode(F.array("src_id", "dst_id")).alias("id")).distinct().join(keep, "id", "left_semi")
    for part in (
        listed(must_implement(g, Scratch(g.spark, "implement").write(ends, "ends")), "from_id", F.col("id"), "must_implement"),
        listed(_ranked(facts, top, False, True), "target", F.struct("rank", F.col("id").alias("other"), "similarity"), "analogues"),
        held,
    ):
        out = out.join(part, "id", "left")
    parts = ("must_call", "used_by", "must_implement", "analogues", "missing_imports", "concepts", "second_level", "confidence")
    out = out.select("id", *parts)
    out = out.withColumn("confidence", F.coalesce("confidence", F.lit("unresolved")))
    if files is not None:
        spans = element_spans(keep.join(g.elem, "id"))
        text = snippet(files, spans.withColumn("end_line", F.least("end_line", F.col("start_line") + snippet_lines - 1)))
        out = out.join(text.select(F.col("elem_id").alias("id"), signature(F.col("snippet")).alias("signature"), F.col("snippet").alias("body")), "id", "left")
    if task is not None:
        out = out.withColumn("criteria", F.array(*(F.lit(c) for c in CRITERIA[task])))
    return out


def brief_arrows(briefs: DataFrame, set_id: str) -> DataFrame:
    """Arrows for a working set (set_id, kind, src_id, dst_id, note, source): what a brief says should be called,
    implemented and looked at."""
    def arrows(kind: str, ends) -> F.Column:
        return F.transform(F.coalesce(ends, F.array().cast("array<string>")), lambda d: F.struct(F.lit(kind).alias("kind"), d.alias("dst_id")))

    rows = F.concat(arrows("shouldCall", F.col("must_call")), arrows("shouldImplement", F.col("must_implement")), arrows("analogueOf", F.transform("analogues", lambda a: a["other"])))
    none = F.lit(None).cast("string")
    return briefs.select(F.lit(set_id).alias("set_id"), F.col("id").alias("src_id"), F.inline(rows)).select("set_id", "kind", "src_id", "dst_id", none.alias("note"), F.lit("brief").alias("source"))
