"""Plans rendered to text edits, over small TypeScript and Clojure sources."""

import pytest

from arrowlens.operators import plan, render
from arrowlens.operators.graph import from_rows
from arrowlens.sources import code

FILES = {
    "src/a.ts": "import { helper } from './b';\n\nexport function main() {\n  helper(1);\n  return helper(2) + other.helper;\n}\n",
    "src/b.ts": "export function helper(x: number) {\n  return x;\n}\n\nexport interface Opts {\n  a: string;\n}\nexport type Mode = 'on';\n",
    "src/sub/c.ts": "import { helper, Opts } from '../b';\nexport const run = () => {\n  helper(3);\n};\n",
    "lib/d.clj": "(ns d)\n(defn go [] 1)\n",
}


@pytest.fixture(scope="module")
def world(spark):
    files = spark.createDataFrame(list(FILES.items()), "file string, text string")
    g = code.build_graph(code.stage(files))
    return g, files, {(r.kind, r.name, r.module): r.id for r in g.elem.collect()}


def done(world, *operations):
    g, files, _ = world
    out = render.apply_with_edits(g, files, plan.plan_rows(g.spark, list(operations)))
    return out, {r.file: r.text for r in out["files"].collect()}


def test_rename_reaches_imports_and_calls(world):
    out, text = done(world, {"op": "rename", "target": world[2]["function", "helper", "src/b.ts"], "name": "assist"})
    assert out["ok"] and out["unmet"].isEmpty()
    assert text["src/a.ts"] == FILES["src/a.ts"].replace("{ helper }", "{ assist }").replace("helper(", "assist(")
    assert text["src/b.ts"] == FILES["src/b.ts"].replace("helper", "assist")
    assert text["src/sub/c.ts"] == FILES["src/sub/c.ts"].replace("helper", "assist") and text["lib/d.clj"] == FILES["lib/d.clj"]


def test_move_cuts_inserts_and_repoints(world):
    out, text = done(world, {"op": "move", "target": world[2]["function", "helper", "src/b.ts"], "module": "src/new/e.ts"})
    assert out["ok"] and text["src/b.ts"] == FILES["src/b.ts"].split("}\n", 1)[1]
    assert text["src/new/e.ts"] == "export function helper(x: number) {\n  return x;\n}\n"
    assert text["src/a.ts"].startswith("import { helper } from './new/e';\n")
    assert text["src/sub/c.ts"].startswith("import { Opts } from '../b';\nimport { helper } from '../new/e';\n")


def test_add_reexport_remove_and_amend(world):
    ids = world[2]
    out, text = done(
        world,
        {"op": "add_symbol", "module": "src/a.ts", "name": "fresh", "kind": "class"},
        {"op": "add_symbol", "module": "lib/d.clj", "name": "stop", "kind": "function"},
        {"op": "add_symbol", "module": "src/z.ts", "name": "z", "kind": "const"},
        {"op": "add_reexport", "module": "src/a.ts", "name": "run", "src": "src/sub/c.ts"},
        {"op": "amend_type", "target": ids["interface", "Opts", "src/b.ts"], "text": "b?: number"},
        {"op": "amend_type", "target": ids["type", "Mode", "src/b.ts"], "text": "'off'"},
        {"op": "remove_symbol", "target": ids["function", "helper", "src/b.ts"]},
    )
    assert out["ok"]
    assert text["src/a.ts"] == "\nexport function main() {\n  helper(1);\n  return helper(2) + other.helper;\n}\n".replace("\n", "export class fresh {}\n\n", 1) + "export { run } from './sub/c';\n"
    assert text["src/b.ts"] == "\nexport interface Opts {\n  a: string;\n  b?: number;\n}\nexport type Mode = 'on' | 'off';\n"
    assert text["src/sub/c.ts"].startswith("import { Opts } from '../b';\n")
    assert text["lib/d.clj"] == FILES["lib/d.clj"] + "(defn stop [])\n" and text["src/z.ts"] == "export const z = undefined;\n"
    assert {(r.op, r.warning) for r in out["warnings"].collect()} == {("remove_symbol", "still called by main"), ("remove_symbol", "still called by run")}


def test_conflicts_drop_all_and_bodies_stay_work(world):
    g, files, ids = world
    helper = ids["function", "helper", "src/b.ts"]
    ops = plan.plan_rows(g.spark, [{"op": "remove_symbol", "target": helper}, {"op": "rename", "target": helper, "name": "x"}, {"op": "rewrite_body", "target": ids["function", "main", "src/a.ts"], "text": "do it"}, {"op": "add_symbol", "module": "src/a.ts", "name": "n", "kind": "function"}])
    edits, warnings = render.render(g, files, ops)
    assert edits.where("file = 'src/b.ts' OR op = 'add_symbol'").isEmpty()
    assert {(r.op, r.file) for r in warnings.where("warning LIKE 'overlaps%'").collect()} >= {("remove_symbol", "src/b.ts"), ("rename", "src/b.ts")}
    assert [(r.module, r.text) for r in render.pending_bodies(g, ops).collect()] == [("src/a.ts", "do it")]


def test_a_fault_leaves_everything_as_it_was(world):
    g, files, ids = world
    out, text = done(world, {"op": "rename", "target": ids["type", "Mode", "src/b.ts"], "name": "M2"}, {"op": "move", "target": "nowhere", "module": "x.ts"})
    assert not out["ok"] and text == FILES and out["graph"] is g
    assert [(r.op, r.fault) for r in out["faults"].collect()] == [("move", "no such element")]


def test_verify_names_what_is_not_there(world):
    g, _, ids = world
    ops = plan.plan_rows(g.spark, [{"op": "rename", "target": ids["type", "Mode", "src/b.ts"], "name": "M2"}, {"op": "add_symbol", "module": "q", "name": "n", "kind": "class"}, {"op": "remove_arrow", "target": "no"}, {"op": "add_arrow", "src": "no", "dst": ids["type", "Mode", "src/b.ts"], "kind": "calls"}, {"op": "remove_symbol", "target": ids["type", "Mode", "src/b.ts"]}, {"op": "move", "target": ids["type", "Mode", "src/b.ts"], "module": "src/b.ts"}])
    assert sorted((r.ord, r.fault) for r in render.verify(g, ops).collect()) == [(0, "is still called Mode"), (1, "was not added"), (3, "an end does not exist"), (4, "is still there")]


def test_texts_of_imports():
    text = "import type { A } from './a';\nimport d, {\n  B as C,\n  E\n} from \"../b\";\nimport * as all from 'x'\nexport { q } from './q';\nconst y = 1;\n"
    got = render.parse_imports(text)
    assert [(i["word"], i["type"], i["default"], i["all"], i["names"], i["path"]) for i in got] == [("import", True, None, None, ["A"], "./a"), ("import", False, "d", None, ["B as C", "E"], "../b"), ("import", False, None, "all", [], "x"), ("export", False, None, None, ["q"], "./q")]
    assert render.format_import(got[1]) == "import d, { B as C, E } from '../b';" and render.insertion_line(text) == 7
    assert render.merge_imports("x;\n", "n", "./m") == "import { n } from './m';\nx;\n"
    assert render.merge_imports("import { a } from './m';\n", "n", "./m") == "import { a, n } from './m';\n" and render.merge_imports("import { n as k } from './m';", "n", "./m") == "import { n as k } from './m';"
    assert render.relative_import("src/x/a.ts", "src/b.ts") == "../b" and render.relative_import("a.ts", "lib/c.tsx") == "./lib/c"
    assert render.imported_module("src/x/a.ts", "../b.js") == "src/b" and render.imported_module("a.ts", "react") == "react"
    assert render.enclosing_declaration("type T =\n  | 'a'\n  | 'b';\nlet x = 1;", 1) == (1, 3) and render.enclosing_declaration("a", 4) is None
