"""Context, inspection, sessions, ingestion and the smaller operators, on small hand-checked inputs."""

import pytest
from pyspark.sql import functions as F

from arrowlens.operators import constraints, context, domain, mining, motifs, plan, sessions, traverse
from arrowlens.operators.graph import from_rows
from arrowlens.sources import code, snippets
from arrowlens.streaming import feed

E = "id string, kind string, name string, module string, span string, attrs string"
TEXT = "import { g } from './b';\n\nexport function f(x: number): string {\n  g(x);\n  return 'a';\n}\n"


@pytest.fixture(scope="module")
def g(spark):
    elem = [
        ("f", "function", "f", "a.ts", "a.ts:3:1-6:2", "{}"), ("f2", "function", "f", "c.ts", None, "{}"), ("g", "function", "g", "b.ts", None, "{}"), ("h", "function", "h", "d.ts", None, "{}"),
        ("i", "import", "g", "a.ts", "1:1-1:25", "{}"), ("K", "class", "K", "b.ts", None, "{}"), ("I", "interface", "I", "b.ts", None, "{}"), ("D", "domain", "a F", None, None, "{}"),
    ]
    arr = [("callerOf", "f", "g"), ("callerOf", "f", "h"), ("callerOf", "f2", "g"), ("callerOf", "g", "h"), ("importsFrom", "i", "module:b.ts"), ("implements", "K", "I"), ("implementedAs", "D", "f"), ("definedIn", "f", "I")]
    prov = [("f", "a", "1", 0, "resolved"), ("g", "a", "1", 0, "tentative")]
    return from_rows(spark.createDataFrame(elem, E), spark.createDataFrame(arr, "kind string, src_id string, dst_id string"), spark.createDataFrame(prov, "elem_id string, source string, commit_sha string, ingested_at long, confidence string"))


def ids(g, *names):
    return g.spark.createDataFrame([(n,) for n in names], "id string")


def col(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


def test_front_door(g):
    assert col(traverse.query(g, {"id": "f"})[0]) == ["f"] and traverse.query(g, {"id": "no"})[0].isEmpty()
    assert col(traverse.query(g, {"kind": "function", "module": "^a"}, kind="class")[0]) == ["f"]
    assert col(traverse.query(g, kind="any", name="^g$")[0]) == ["g", "i"]
    assert col(traverse.query(g, kind="function", limit=2)[0]) == ["f", "g"]
    assert col(traverse.query(g, kind="function", confidence="tentative", limit=1)[0]) == ["g"]
    e, a = traverse.query(g, {"id": "f"}, arrows=["callerOf", "callerOf"])
    assert col(e) == ["f", "g", "h"] and col(a) == ["f:callerOf:g", "f:callerOf:h", "g:callerOf:h"]
    assert col(traverse.query(g, {"id": "h"}, arrows=["callerOf"], direction="in")[0]) == ["f", "g", "h"]


def test_constraints_and_equations_about_elements(g):
    rules = g.spark.createDataFrame([("all", None), ("k", '{"kind":"class"}'), ("m", '{"layers":[["b.ts"]]}')], "id string, config string")
    got = {}
    for r in constraints.about_element(rules, g.elem).collect():
        got.setdefault(r.id, set()).add(r.constraint_id)
    assert got["f"] == {"all"} and got["K"] == {"all", "k", "m"} and got["g"] == {"all", "m"} and got["D"] == {"all", "k", "m"}
    side = "struct<src:string,tgt:string,arrows:array<string>>"
    eqs = g.spark.createDataFrame([("e1", ("f", "g", ["x"]), ("f", "g", ["y"])), ("e2", ("ff", "h", []), ("ff", "h", []))], f"id string, lhs {side}, rhs {side}")
    assert col(constraints.equations_about(eqs, "f")) == ["e1"] and col(constraints.equations_about(eqs, "f", wildcard=True)) == ["e1", "e2"]
    files = g.spark.createDataFrame([("a.ts", TEXT)], "file string, text string")
    row = context.inspect(g, ids(g, "f"), eqs, rules, files).first()
    assert (row.equations, row.constraints, row.snippet) == (["e1"], ["all"], TEXT.split("\n", 2)[2].rstrip("\n"))
    assert [(o.kind, o.other) for o in row.incoming] == [("implementedAs", "D")] and row.provenance.confidence == "resolved"
    names = g.spark.createDataFrame([("a Thing",), ("thing",), ("  The X",), ("An",)], "n string")
    assert [r[0] for r in names.select(constraints.is_noun_phrase(F.col("n"))).collect()] == [True, False, True, True]
    assert col(plan.relevant(rules, ["class"])) == ["k"]


def test_context(g):
    assert [(r.module, r.name, r.source) for r in context.imports_of(g).collect()] == [("a.ts", "g", "b.ts")] and context.imports_of(g, "q").isEmpty()
    assert {(r.from_id, r.id) for r in context.missing_imports(g, ids(g, "f", "f2")).collect()} == {("f", "h"), ("f2", "g")}
    assert {tuple(r) for r in context.second_level(g, ids(g, "f")).collect()} == {("f", "g", "h")}
    assert {(r.from_id, r.id) for r in context.must_implement(g, ids(g, "K", "I")).collect()} == {("K", "I"), ("I", "K")}
    files = g.spark.createDataFrame([("a.ts", TEXT)], "file string, text string")
    rows = {r.id: r for r in context.brief(g, ids(g, "f", "g", "h"), files=files, task="write_test").collect()}
    f = rows["f"]
    assert f.must_call == ["g", "h"] and f.missing_imports == ["h"] and [a.other for a in f.analogues] == ["f2", "g"] and f.signature == "export function f(x: number): string"
    assert f.body.startswith("export function f") and f.criteria[0] == "compiles" and [(c.via, c.concept) for c in f.concepts] == [("own", "D")]
    assert [rows[i].confidence for i in "fgh"] == ["resolved", "mixed", "unresolved"]
    arrows = {(r.kind, r.src_id, r.dst_id) for r in context.brief_arrows(context.brief(g, ids(g, "f")), "s").collect()}
    assert arrows == {("shouldCall", "f", "g"), ("shouldCall", "f", "h"), ("analogueOf", "f", "f2"), ("analogueOf", "f", "g")}


def test_mining_helpers(g):
    seeds = mining.sample_seeds(g, ["function", "class"], None)
    one = mining.evaluate_one(g, seeds, ["callerOf"], ["callerOf", "callerOf"])
    assert [(r.support, r.total) for r in one.collect()] == [(0, 3)]
    reached = mining.path_reach(g, seeds, ["callerOf", "implements"], 1)
    pair = g.spark.createDataFrame([(["callerOf"], ["implements"])], "lhs array<string>, rhs array<string>")
    e = mining.evaluate(pair, mining.reach_sets(reached))
    assert [(r.kind, r.n) for r in mining.dominant_kinds(e, seeds).collect()] == [("function", 3)]
    assert [(r.seed, r.lhs_only, r.rhs_only) for r in mining.counterexamples(e, 2).orderBy("seed").collect()] == [("K", [], ["I"]), ("f", ["g", "h"], [])]
    assert [r.line for r in mining.rendered(mining.coverage(e)).collect()] == ["callerOf = implements (0/4, 0.0%)"]
    assert mining.kinds_in_use(g, touching=["class"]) == ["implements"] and mining.kinds_in_use(g)[0] == "implements"


def test_motif_candidates_and_equations(g):
    seeds = motifs.motif_seeds(g, ["function"])
    found, placed = motifs.shapes(g, seeds, 1, ["callerOf"]), motifs.instances(g, seeds, 1, ["callerOf"], 2)
    c = motifs.candidates(found, placed, 2).collect()
    assert {(r.seed, r.support) for r in c} == {("f2", 2), ("g", 2)} and c[0].name == "Motif_function_callerOf" and set(c[0].mapping) == {"function_0", "function_1"}
    assert {tuple(r.lhs) for r in motifs.internal_equations(g, placed).collect()} <= {("callerOf",), ("definedIn",)}
    templates, rows = sessions.motif_templates(motifs.candidates(found, placed, 2), found.select("shape_hash"), 7)
    assert templates.count() == 1 and rows.count() == 2


def test_did_you_mean(g):
    ops = plan.plan_rows(g.spark, [{"op": "rename", "target": "module:x:1:1:function:f", "name": "q"}])
    assert [r.candidates for r in plan.did_you_mean(g, plan.validate(g, ops)).collect()] == [["f", "f2"]]


def test_sessions(g):
    s, sid = sessions.start(sessions.empty(g.spark), "domain", sessions.discovered(g), 5)
    assert col(sessions.candidates_of(s, sid)) == ["I", "K"]
    answer = g.spark.createDataFrame([("K", "accepted", "a Kay", [("implements", None, "accepted", False)]), ("I", "accepted", None, None)], f"id string, status string, name_override string, arrows {sessions.ARROWS}")
    s = sessions.refine(s, sid, answer, 6)
    row = sessions.summaries(s).first()
    assert (row.accepted, row.rejected, row.arrows, row.updated_at) == (2, 0, 1, 6)
    done, after = sessions.commit(s, sid, g, 7)
    new = after.elem.join(g.elem.select("id"), "id", "left_anti")
    assert {(r.id, r.name) for r in new.collect()} == {("domain:K", "a Kay"), ("domain:I", "an I")}
    assert {r.id for r in after.arr.join(g.arr.select("id"), "id", "left_anti").collect()} == {"domain:K:implementedAs:K", "domain:I:implementedAs:I", "domain:K:implements:domain:I"}
    assert after.arr.where("id = 'domain:K:implements:domain:I'").first().attrs == '{"name":"implements","total":false}'
    with pytest.raises(ValueError):
        sessions.commit(done, sid, g, 8)
    rejected = sessions.refine(s, sid, g.spark.createDataFrame([("I", "rejected", None, None)], answer.schema), 8)
    assert {(r.id, r.status, len(r.arrows)) for r in sessions.candidates_of(rejected, sid).collect()} == {("I", "rejected", 0), ("K", "accepted", 0)}
    assert domain.refine(sessions.candidates_of(s, sid), answer.limit(0)).count() == 2


def test_snippets(spark):
    files = spark.createDataFrame([("a.ts", TEXT), ("n", None)], "file string, text string")
    spans = spark.createDataFrame([("x", "a.ts", 3, 6), ("y", "a.ts", 99, 100), ("z", "n", 1, 1)], "elem_id string, file string, start_line int, end_line int")
    whole = snippets.snippet(files, spans).collect()
    assert [(r.elem_id, r.snippet.count("\n")) for r in whole] == [("x", 3)]
    assert [r.snippet for r in snippets.focused(files, spans, 2).collect()] == ["export function f(x: number): string {\n…\n}"]
    texts = spark.createDataFrame([(whole[0].snippet,), ("type A = 1;",)], "s string")
    assert [tuple(r) for r in texts.select(snippets.signature(F.col("s")), snippets.body(F.col("s"))).collect()] == [("export function f(x: number): string", "\n  g(x);\n  return 'a';\n"), ("type A = 1", None)]
    assert files.select(snippets.import_block(F.col("text"))).first()[0] == "import { g } from './b';"


def test_ingestion_finds_its_changes(spark):
    frame = lambda d: spark.createDataFrame(list(d.items()), "file string, text string")
    one = {"a.ts": TEXT, "b.ts": "export function g(x: number) {\n  return x;\n}\n", "c.ts": "export class C {}\n"}
    g1, marks = feed.ingest(None, None, frame(one), "s1")
    two = {"a.ts": TEXT, "b.ts": one["b.ts"].replace("g(", "gg("), "d.ts": "export class D {}\n"}
    assert {tuple(r) for r in feed.changed_files(marks, frame(two)).collect()} == {("b.ts", "changed"), ("c.ts", "deleted"), ("d.ts", "added")}
    g2, _ = feed.ingest(g1, marks, frame(two), "s2", 9)
    full, _ = feed.ingest(None, None, frame(two))
    assert col(g2.elem) == col(full.elem) and col(g2.arr) == col(full.arr)
    assert {r.commit_sha for r in g2.prov.where("elem_id LIKE '%gg'").collect()} == {"s2"}
    assert feed.is_fresh("s1", "s1") and not feed.is_fresh("s1", "s2") and not feed.is_fresh(None, None)
    again, _ = feed.ingest(g1, None, frame(two))
    assert col(again.elem) == col(full.elem)


def test_micro_batches(spark, tmp_path):
    spark.createDataFrame([("a.ts", "x")], "file string, text string").write.parquet(str(tmp_path / "in"))
    got = []
    q = feed.merge_each(spark.readStream.schema("file string, text string").parquet(str(tmp_path / "in")), lambda df: got.extend(r.file for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert got == ["a.ts"]


def test_large_files_are_reported(spark, tmp_path):
    (tmp_path / "big.ts").write_text("export class A {}\n" * 20)
    (tmp_path / "ok.ts").write_text("export class B {}\n")
    staged = code.stage(code.read_files(spark, f"file://{tmp_path}", max_bytes=100))
    assert [tuple(r) for r in code.extraction_errors(staged).collect()] == [("big.ts", "too large or unreadable")]
    assert code.extraction_errors(code.stage(code.read_files(spark, f"file://{tmp_path}", max_bytes=None))).isEmpty()
