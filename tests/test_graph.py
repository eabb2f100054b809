"""The graph operators on a small graph with hand-checked answers."""

import pytest

from arrowlens.operators import constraints, context, domain, mining, motifs, plan, traverse, workingset
from arrowlens.operators.graph import from_rows

F6 = [("f1", "a.ts"), ("f2", "a.ts"), ("f3", "b.ts"), ("f4", "c.ts"), ("f5", "c.ts"), ("f6", "c.ts")]
CALLS = [("f1", "f2"), ("f1", "f3"), ("f2", "f3"), ("f3", "f4"), ("f4", "f1"), ("f5", "f2"), ("f5", "f3"), ("f6", "f4")]


@pytest.fixture(scope="module")
def g(spark):
    elem = [(f, "function", f, m) for f, m in F6] + [("C", "class", "C", "b.ts"), ("I", "interface", "I", "a.ts"), ("fa", "file", "fa", "a.ts"), ("fb", "file", "fb", "b.ts"), ("fc", "file", "fc", "c.ts"), ("D", "domain", "D", None), ("D2", "domain", "D2", None)]
    arr = [("callerOf", a, b) for a, b in CALLS] + [("definedIn", f, "f" + m[0]) for f, m in F6] + [("definedIn", "C", "fb"), ("definedIn", "I", "fa"), ("implements", "C", "I"), ("implementedAs", "D", "f1"), ("implementedAs", "D2", "f1"), ("implementedAs", "D2", "f3")]
    prov = [("f1", "z", "2", 0, "resolved"), ("f1", "a", "1", 0, "tentative"), ("f2", "a", "1", 0, "resolved"), ("f3", "a", "1", 0, "unresolved")]
    a = spark.createDataFrame([(f"{s}:{k}:{d}", k, s, d) for k, s, d in arr] + [("D:x:D2", "other", "D", "D2"), ("D:y:D2", "other", "D", "D2")], "id string, kind string, src_id string, dst_id string")
    return from_rows(spark.createDataFrame(elem, "id string, kind string, name string, module string"), a, spark.createDataFrame(prov, "elem_id string, source string, commit_sha string, ingested_at long, confidence string"))


def seed(g, *ids):
    return g.spark.createDataFrame([(i,) for i in ids], "id string")


def col(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


def test_closure_and_endpoint(g):
    e, a = traverse.traverse(g, seed(g, "f1"), [("callerOf", "out")] * 2)
    assert col(e) == ["f1", "f2", "f3", "f4"] and a.count() == 4
    e, a = traverse.traverse(g, seed(g, "f1"), [("callerOf", "out"), ("definedIn", "out")])
    assert col(e) == ["f1", "f2", "f3", "fa", "fb"] and a.count() == 4
    assert col(traverse.reach(g, seed(g, "f1"), ["callerOf", "definedIn"])) == ["fa", "fb"]
    assert col(traverse.reach(g, seed(g, "f1"), [])) == ["f1"]
    whole = {(r.seed, r.id) for r in traverse.path_relation(g, ["callerOf", "definedIn"]).collect()}
    assert whole == {(r.seed, r.id) for r in traverse.reach(g, g.elem.select("id"), ["callerOf", "definedIn"]).collect()}


def test_derived_kinds_only_on_request(g):
    assert col(traverse.traverse(g, seed(g, "fa"), [("contains", "out")])[0]) == ["fa"]
    assert col(traverse.traverse(g, seed(g, "fa"), [("contains", "out")], derived=True)[0]) == ["I", "f1", "f2", "fa"]


def test_constraints(g):
    assert sorted((r.id, r.n) for r in constraints.totality(g, "function", "callerOf").collect()) == [("f1", 2), ("f5", 2)]
    l = constraints.layering(g, [[r"^a\.ts$"], [r"^b\.ts$"], [r"^c\.ts$"]])
    assert sorted((r.src_id, r.dst_id) for r in l.where("arr_id LIKE '%callerOf%'").collect()) == [("f1", "f3"), ("f2", "f3"), ("f3", "f4")]
    assert sorted(map(tuple, constraints.monotonicity(g).collect())) == [("f1:callerOf:f2", 0, 2), ("f1:callerOf:f3", 0, 1)]
    rules = [{"id": "r1", "kind": "existence", "config": {"kind": "enum"}}, {"id": "r2", "kind": "totality", "config": '{"domainKind":"function","arrowKind":"callerOf"}'}]
    assert sorted((r.rule, len(r.involved)) for r in constraints.check(g, rules).collect()) == [("r1", 0), ("r2", 3), ("r2", 3)]


def test_equation(g):
    seeds = g.elem.where("kind IN ('function', 'class', 'interface')").select("id")
    for right in (False, True):
        c = constraints.equation_check(g, seeds, ["callerOf", "definedIn"], ["definedIn"], right)
        assert c.count() == 8 and col(c.where("valid"), "seed") == ["f6"]
    assert constraints.validate_equation(g, {"lhs": {"src": "a", "tgt": "b", "arrows": ["nope"]}, "rhs": {"src": "a", "tgt": "c", "arrows": ["calls"]}}, ["calls"]) == ["tgt differ: b and c", "unknown arrow kind nope"]
    bad = constraints.equation_violations(g, [{"id": "e", "lhs": {"src": "f1", "arrows": ["callerOf"]}, "rhs": {"src": "f1", "arrows": ["definedIn"]}}, {"id": "none", "lhs": {"src": "zz", "arrows": []}, "rhs": {"src": "f1", "arrows": []}}])
    assert [(r.equation, r.lhs_only, r.rhs_only) for r in bad.collect()] == [("e", ["f2", "f3"], ["fa"])]
    faults, same = constraints.propose_schema(g, {"objects": [{"name": "thing", "kind": "x"}], "arrows": [{"name": "to", "domain": "thing", "codomain": "zz", "total": False}]})
    assert faults == ["thing is no noun phrase", "to is not total", "zz is unknown"] and same is g
    faults, more = constraints.propose_schema(g, {"objects": [{"name": "a Thing", "kind": "x"}], "arrows": [{"name": "to", "domain": "a Thing", "codomain": "C", "total": True}]}, dry_run=False)
    assert not faults and more.elem.count() == g.elem.count() + 1 and more.arr.count() == g.arr.count() + 1


def test_mining_against_sets(g):
    seeds = mining.sample_seeds(g, ["function"], None)
    reached = mining.path_reach(g, seeds, ["callerOf", "definedIn"], 2)
    want = {}
    for f, m in F6:
        step = {b for a, b in CALLS if a == f}
        want[("callerOf",), f] = step
        want[("definedIn",), f] = {"f" + m[0]}
        want[("callerOf", "definedIn"), f] = {"f" + dict(F6)[b][0] for b in step}
    got = {}
    for r in reached.collect():
        got.setdefault((tuple(r.path), r.seed), set()).add(r.id)
    assert got == want
    m = mining.mine_equations(g, ["callerOf", "definedIn"], ["function"], 2, 0.0, None).collect()
    assert [(tuple(r.lhs), tuple(r.rhs), r.support, r.total) for r in m] == [(("definedIn",), ("callerOf", "definedIn"), 1, 6)]
    assert mining.subsumed(["a", "c"], ["b", "c"], [(("a",), ("b",))]) and mining.subsumed(["c", "a"], ["c", "b"], [(("a",), ("b",))]) and not mining.subsumed(["a"], ["b"], [(("a",), ("b",))])
    assert [len(mining.enumerate_paths([str(i) for i in range(18)], d)) for d in (1, 2, 3)] == [18, 324, 5526]


def test_ego_and_shapes(g):
    nodes, edges = traverse.ego(g, seed(g, "f3"), 2, ["callerOf"])
    assert col(nodes) == ["f1", "f3", "f4"] and edges.count() == 2
    s = motifs.shapes(g, motifs.motif_seeds(g, ["function"]), 1, ["callerOf"]).collect()
    groups = {}
    for r in s:
        groups.setdefault(r.shape_hash, set()).add(r.seed)
    assert sorted(map(sorted, groups.values())) == [["f1"], ["f2", "f3"], ["f4", "f6"], ["f5"]]
    i = motifs.instances(g, motifs.motif_seeds(g, ["function"]), 1, ["callerOf"], 2)
    assert i.count() == 8


def test_domain(g):
    assert [(r.code_id, r.domains) for r in domain.pullbacks(g).collect()] == [("f1", ["D", "D2"])]
    k = domain.kan_extension(g)
    assert sorted((r.concept, r.dst, r.status) for r in k.collect()) == [("D", "D2", "resolved"), ("D", "f2", "tentative"), ("D2", "f4", "tentative"), ("f4", "D", "resolved")]
    names = g.spark.createDataFrame([("AxisElem",), ("PaymentReq",), ("http-elem",), ("HTMLParser",), ("SrcId",), ("Ctor",), ("V2Val",)], "n string")
    from pyspark.sql import functions as F

    assert [r[0] for r in names.select(domain.noun_phrase(F.col("n"))).collect()] == ["an Axis Element", "a Payment Request", "a http-elem", "a HTML Parser", "a Source ID", "a Constructor", "a V2Val"]
    names = g.spark.createDataFrame([("ns/http-elem",), ("load_src_id",), ("loadSrcId",), ("x",), ("a/" + "w" * 20_000,)], "n string")
    assert [r[0] for r in names.select(domain.noun_phrase_of_name(F.col("n"))).collect()] == ["a Http Elem", "a Load Src Id", "a Load Source ID", "a X", "a W" + "w" * 19_999]
    kept = domain.keepers(g, g.spark.createDataFrame([("d", "D"), ("d", "D2")], "key string, id string"))
    assert {(r.id, r.keeper) for r in kept.collect()} == {("D", "D2"), ("D2", "D2")}
    m = domain.merge_duplicates(g, kept)
    assert "D" not in col(m.elem) and m.arr.where("src_id = 'D' OR dst_id = 'D'").isEmpty() and m.arr.where("src_id = 'D2' AND kind = 'implementedAs'").count() == 2


def test_kan_members_speak_for_their_class(spark):
    elem = [("K", "class", "K", "m"), ("k1", "method", "k1", "m"), ("t", "function", "t", "m"), ("x", "function", "x", None), ("D", "domain", "D", None)]
    arr = [("implementedAs", "D", "K"), ("memberOf", "k1", "K"), ("callerOf", "k1", "t"), ("callerOf", "k1", "x")]
    g = from_rows(spark.createDataFrame(elem, "id string, kind string, name string, module string"), spark.createDataFrame(arr, "kind string, src_id string, dst_id string"))
    assert [tuple(r) for r in domain.kan_extension(g).collect()] == [("D", "t", "K", 1, "tentative")]
    assert domain.kan_extension(g, depth=0).collect() == []


def test_discovery(spark):
    elem = [("A", "interface", "OrderReq", "m", "{}"), ("B", "class", "Base", "m", "{}"), ("T", "type", "Mode", "m", "{}"), ("E", "enum", "Hue", "m", "{}"), ("X", "class", "Ext", "node:fs", "{}"), ("D", "domain", "a Hue", None, "{}"),
            ("p1", "property", "OrderReq.a.b", "m", '{"typeText":"Base[]"}'), ("p2", "property", "OrderReq.hue", "m", '{"typeText":"Hue","optional":true}'), ("p3", "property", "OrderReq.bag", "m", '{"typeText":"Record<string, x>"}'), ("p4", "property", "base", "m", "{}")]
    arr = [("hasProperty", "A", p) for p in ("p1", "p2", "p3", "p4", "nope")] + [("hasType", "p1", "B"), ("hasType", "p2", "E"), ("hasType", "p4", "gone"), ("hasType", "p4", "X"), ("extends", "A", "B"), ("implements", "B", "X"), ("implementedAs", "D", "E")]
    g = from_rows(spark.createDataFrame(elem, "id string, kind string, name string, module string, attrs string"), spark.createDataFrame(arr, "kind string, src_id string, dst_id string"))
    rows = {(r.candidate, r.phrase, r.name, r.codomain, r.codomain_kind, r.total, r.confidence, r.question is not None) for r in domain.field_arrows(g).collect()}
    a = ("A", "an Order Request")
    assert rows == {(*a, "has a.b", "B", "candidate", False, "resolved", True), (*a, "has hue", "D", "concept", False, "resolved", True), (*a, "has base", "X", "type", True, "unresolved", False), (*a, "extends", "B", "candidate", True, "resolved", False)}
    assert {tuple(r) for r in domain.candidate_questions(g).collect()} == {("T", "alias"), ("A", "bag")}


def test_drawing(g):
    w = workingset.WorkingSets.empty(g.spark)
    nodes, edges = workingset.drawing(g.elem, g.arr, g.spark.createDataFrame([("s", "y", "guess", "f1", None, "why", "me")], workingset.SYNTHETIC), w.notes)
    assert {(r.kind, r.colour) for r in nodes.collect()} == {("function", "#4A90D9"), ("class", "#70AD47"), ("interface", "#9B59B6"), ("file", "#BDC3C7"), ("domain", "#FFD700")}
    assert [(r.src_id, r.dst_id, r.annotation) for r in edges.where("synthetic").collect()] == [("f1", "f1", "why")]


def test_context(g):
    assert [(r.target, r.id, r.similarity) for r in context.analogues(g, seed(g, "f1", "f2")).orderBy("target").collect()] == [("f1", "f5", 1.0), ("f2", "f5", 0.5)]
    assert col(context.used_by(g, seed(g, "f3"))) == ["f1", "f2", "f5"]
    assert {(r.from_id, r.id) for r in context.missing_imports(g, seed(g, "f1")).collect()} == {("f1", "f3")}
    assert {(r.via, r.concept) for r in context.domain_context(g, seed(g, "f3")).collect()} == {("own", "D2"), ("caller", "D"), ("caller", "D2")}
    row = context.inspect(g, seed(g, "f1")).first()
    assert row.provenance.confidence == "tentative" and {(o.kind, o.other) for o in row.outgoing} >= {("inModule", "fa"), ("callerOf", "f2")}
    assert context.brief(g, seed(g, "f1")).first().must_call == ["f2", "f3"]


def test_working_sets(g):
    w = workingset.WorkingSets.empty(g.spark)
    w, s = w.open("mine", 1)
    member = lambda *x: g.spark.createDataFrame([(s, i) for i in x], workingset.MEMBERS)
    w, n = w.add(member("f1", "f3", "nope"), member("f1:callerOf:f3"), 2)
    assert [(r.elems, r.arrs) for r in n.collect()] == [(3, 1)]
    w, n = w.add(member("f1", "f4"), member(), 3)
    assert [(r.elems, r.arrs) for r in n.collect()] == [(1, 0)]
    w = w.annotate(g.spark.createDataFrame([(s, "f1", "look")], "set_id string, target_id string, note string"), 4)
    w = w.assert_arrows(g, g.spark.createDataFrame([(s, "guess", "f1", None, None, "me"), (s, "guess", "nope", "f1", None, "me")], "set_id string, kind string, src_id string, dst_id string, note string, source string"))
    assert sorted((r.id, r.annotation) for r in w.members(g, s).collect()) == [("f1", "look"), ("f3", None), ("f4", None)]
    ids, a = w.hop(g, s, ["callerOf", "guess"], name="f1")
    assert col(ids) == ["f1", "f2", "f3"] and a.count() == 3
    w = w.resolve(g, w.synthetic.select("id").withColumn("dst_id", __import__("pyspark").sql.functions.lit("f6")))
    assert col(w.synthetic, "dst_id") == ["f6"]
    row = w.set_status(s, "paused", 9).listed().first()
    assert (row.status, row.elems, row.arrs, row.updated_at) == ("paused", 4, 1, 9)
    assert w.drop(s).elems.isEmpty()
    lines = [r.line for r in workingset.dot_lines(g.elem.where("kind = 'domain'").select("id", "name"), g.arr).orderBy("ord").collect()]
    assert lines[0] == "digraph G {" and lines[-1] == "}" and sum("->" in x for x in lines) == 2


def test_plan(g):
    ops = plan.plan_rows(g.spark, [{"op": "rename", "target": "f2", "name": "f9"}, {"op": "add_symbol", "name": "f9", "module": "a.ts", "kind": "function"}, {"op": "remove_symbol", "target": "C"}, {"op": "add_arrow", "src": "f1", "dst": "manual:a.ts:0:0:function:f9", "kind": "calls"}, {"op": "rewrite_body", "target": "f2", "text": "x"}, {"op": "move", "target": "zz", "module": "q"}])
    faults = {(r.op, r.fault) for r in plan.validate(g, ops).collect()}
    assert faults == {("rename", "name is taken"), ("add_symbol", "name is taken"), ("remove_symbol", "arrow survives"), ("rewrite_body", "no span"), ("rewrite_body", "rewritten and renamed or removed"), ("move", "no such element")}
    new, _ = plan.apply(g, plan.plan_rows(g.spark, [{"op": "remove_symbol", "target": "f3"}, {"op": "move", "target": "f2", "module": "z"}, {"op": "amend_type", "target": "f1", "text": "T"}, {"op": "add_symbol", "name": "n", "module": "m", "kind": "class"}]))
    assert "f3" not in col(new.elem) and new.arr.where("src_id = 'f3' OR dst_id = 'f3'").isEmpty()
    assert new.element("f2").first().module == "z" and '"amended":"T"' in new.element("f1").first().attrs
    assert new.prov.where("elem_id = 'manual:m:0:0:class:n'").first().source == "manual"
    assert plan.plan_hash([{"op": "a"}]) == plan.plan_hash([{"op": "a"}]) != plan.plan_hash([])


def test_edits(spark):
    text = "one\ntwo\nthree"
    E = [("a", "f", "two", "2", 2, 1, 2, 4), ("b", "f", None, "!", 3, 6, 3, 6), ("c", "g", "x", "y", 1, 1, 1, 3), ("d", "g", None, "z", 1, 2, 1, 4), ("e", "h", "no", "yes", 1, 1, 1, 3)]
    edits = spark.createDataFrame(E, plan.EDITS)
    files = spark.createDataFrame([("f", text), ("g", text), ("h", text), ("i", text)], "file string, text string")
    assert [tuple(r) for r in plan.edit_conflicts(edits).collect()] == [("g", "c", "d")]
    got = {r.file: (r.text, r.edited) for r in plan.apply_edits(files, edits).collect()}
    assert got == {"f": ("one\n2\nthree!", True), "g": (text, False), "h": (text, False), "i": (text, False)}
