import datetime as dt

from arrowlens.operators.graph import Graph
from arrowlens.sources import code
from arrowlens.streaming import feed

A = """import { helper } from './b.js';
export class Shop extends Base implements Sells {
  items: Item[];
  readonly owner?: Person;
  open(now: number): void {
    helper(now);
  }
}
export interface Person { }
export function main() {
  helper(1);
  local();
}
const local = () => {
  return 1;
};
"""
B = "export function helper(x: number) {\n  return x;\n}\nexport class Base {\n}\n"
C = '(ns app.core\n  (:require [app.util :as u :refer [pick]]))\n(defn run [x]\n  (u/go x)\n  (pick x)\n  (throw (ex-info "no" {:type :app/bad})))\n(def limit 3)\n'
U = "(ns app.util)\n(defn go [x] x)\n(defn pick [x] x)\n"


def built(spark, tmp_path, files):
    for name, text in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return code.build_graph(code.stage(code.read_files(spark, f"file://{tmp_path}")))


def test_typescript_and_clojure(spark, tmp_path):
    g = built(spark, tmp_path, {"src/a.ts": A, "src/b.ts": B, "src/app/core.clj": C, "src/app/util.clj": U, "node_modules/x.ts": B, "src/d.d.ts": B})
    names = {(r.kind, r.name) for r in g.elem.collect()}
    assert {("class", "Shop"), ("function", "main"), ("function", "local"), ("function", "helper"), ("method", "open"), ("property", "Shop.items"), ("interface", "Person"), ("import", "helper"), ("file", "a.ts"), ("namespace", "app.core"), ("function", "run"), ("const", "limit"), ("symbol", ":app/bad")} <= names
    short = lambda i: i.rsplit(":", 1)[-1]
    arrows = {(short(r.src_id), r.kind, short(r.dst_id)) for r in g.arr.collect()}
    assert {("main", "callerOf", "helper"), ("main", "callerOf", "local"), ("helper", "calleeOf", "main"), ("Shop", "extends", "Base"), ("Shop", "hasProperty", "Shop.items"), ("Shop.owner", "hasType", "Person"), ("run", "callerOf", "go"), ("run", "callerOf", "pick"), ("run", "throws", "app/bad"), ("open", "callerOf", "helper"), ("helper", "importsFrom", "src/b.ts"), ("u", "importsFrom", "app/util.clj")} <= arrows
    assert g.elem.where("module LIKE '%node_modules%' OR module LIKE '%.d.ts'").isEmpty()


def test_incremental_equals_full(spark, tmp_path):
    before = built(spark, tmp_path, {"src/a.ts": A, "src/b.ts": B})
    after = built(spark, tmp_path, {"src/b.ts": B.replace("class Base", "class Basic")})
    changed = spark.createDataFrame([("src/b.ts",)], "module string")
    part = after.elem.join(changed, "module", "left_semi").select(after.elem.columns)
    m = feed.merged(before, changed, part, after.arr)
    assert {r.id for r in m.elem.collect()} == {r.id for r in after.elem.collect()}
    assert {r.id for r in m.arr.collect()} == {r.id for r in after.arr.collect()}


def test_full_load_keeps_manual_facts(spark, tmp_path):
    g = built(spark, tmp_path, {"b.ts": B})
    helper = g.elem.where("name = 'helper'").first().id
    hand = spark.createDataFrame([("h1", "domain", "H", None, None, "{}")], g.elem.schema)
    arr = spark.createDataFrame([("x", "implementedAs", "h1", helper, "{}"), ("y", "implementedAs", "h1", "gone", "{}")], g.arr.schema)
    prov = spark.createDataFrame([("h1", "manual", "", 0, "resolved")], g.prov.schema)
    old = Graph(g.elem.unionByName(hand), g.arr.unionByName(arr), g.prov.unionByName(prov))
    new = code.replace_extracted(old, g)
    assert {r.id for r in new.elem.collect()} == {r.id for r in old.elem.collect()}
    assert new.arr.where("src_id = 'h1'").count() == 1


def test_specifiers(spark):
    from pyspark.sql import functions as F

    rows = [("src/x/a.ts", "../b.js", "src/b.ts"), ("a.ts", "./b", "b.ts"), ("a.ts", "react", "react"), ("a.ts", "../../b", "b.ts"), ("x/y/z.ts", "./k/../m.tsx", "x/y/m.tsx"), (None, "./b", None), ("a.ts", None, None)]
    df = spark.createDataFrame(rows, "f string, s string, want string")
    assert [r[0] for r in df.select(code.resolve_specifier(F.col("f"), F.col("s"))).collect()] == [r[2] for r in rows]


def staged(extract, text):
    rows = extract("f", text)
    return {(r[3], r[4]) for r in rows if r[2] != "arrow"}, {(r[3], r[9], r[10]) for r in rows if r[2] == "arrow"}, rows


def test_typescript_heads_over_lines_and_the_like():
    text = """import def, {
  one as two,
  type Three
} from './m'; // import { no } from 'x'
export default class Box<T extends A<B>>
  extends Base<T>
  implements One, ns.Two
{
  private readonly items: Map<string, Item[]> = new Map();
  static size?: number;
  constructor(private readonly db: Db, public cache?: Cache, plain: X) { super(); }
  async load<T>(
    id: string,
  ): Promise<T> {
    if (!id) throw new Missing("function fake() {");
    this.check(this.db);
    return two(await def.go<Item>(id));
  }
  check = (x: Db) => { helper(x); };
}
type Shape = {
  kind: 'a;b';
  next?: Shape | null;
};
export const make = async <T,>(x: T): Promise<T> => {
  return wrap(x);
};
const LIMIT = 3;
enum Hue { Red }
"""
    elems, arrows, rows = staged(code.EXTRACTORS[".ts"], text)
    assert elems == {("import", "def"), ("import", "two"), ("import", "Three"), ("class", "Box"), ("method", "load"), ("method", "check"), ("method", "constructor"), ("type", "Shape"), ("function", "make"), ("const", "LIMIT"), ("enum", "Hue"), *(("property", f"Box.{x}") for x in ("items", "size", "db", "cache")), ("property", "Shape.kind"), ("property", "Shape.next")}
    assert {("extends", "Box", "Base"), ("implements", "Box", "One"), ("implements", "Box", "Two"), ("memberOf", "load", "Box"), ("throws", "load", "Missing"), ("callerOf", "load", "check"), ("callerOf", "load", "two"), ("callerOf", "load", "go"), ("callerOf", "check", "helper"), ("callerOf", "make", "wrap"), ("references", "load", "Box.db")} <= arrows
    assert not any(d in ("fake", "no", "if", "load") for k, s, d in arrows if k == "callerOf")
    place = {(r[3], r[4]): r[5:9] for r in rows if r[2] != "arrow"}
    assert place["class", "Box"] == (5, 1, 20, 2) and place["method", "load"] == (12, 3, 18, 4) and place["type", "Shape"][2] == 24 and place["function", "make"] == (25, 1, 27, 2)
    assert [r[11] for r in rows if r[3] == "callerOf" and r[10] == "two"] == ["./m"]


def test_clojure_forms():
    text = """(ns app.ui
  (:require [re-frame.core :as rf]
            [app.my-util :as u :refer [pick]]))
(rf/reg-sub ::names :<- [::db] (fn [db _] (u/sort-names db)))
(rf/reg-event-db ::add (fn [db [_ n]] (pick db n)))
(defn view
  "A doc (string)."
  [x]
  #_(ignored x)
  (let [n @(rf/subscribe [::names])]
    (rf/dispatch [::add n])
    (when-not n (throw (ex-info "no" {:type :app/missing})))))
(def table {:view view :pick pick})
(comment (defn hidden [] 1))
(defn open [
"""
    elems, arrows, rows = staged(code.EXTRACTORS[".clj"], text)
    assert elems == {("namespace", "app.ui"), ("import", "rf"), ("import", "u"), ("const", "::names"), ("const", "::add"), ("function", "view"), ("const", "table"), ("symbol", ":app/missing"), ("function", "open")}
    assert {("callerOf", "::names", "::db"), ("callerOf", "::names", "sort-names"), ("callerOf", "::add", "pick"), ("callerOf", "view", "::names"), ("callerOf", "view", "::add"), ("throws", "view", ":app/missing"), ("references", "table", "view"), ("references", "table", "pick"), ("importsFrom", "u", "app/my_util.clj")} <= arrows
    assert not any(d in ("ignored", "hidden") for _, _, d in arrows)
    assert {r[4]: r[5:9] for r in rows if r[2] == "elem"}["view"] == (6, 1, 12, 63)
    assert [r[11] for r in rows if r[10] == "sort-names"] == ["app/my_util.clj"]


def test_feed_stream_equals_batch(spark, tmp_path):
    t = lambda n: dt.datetime(2024, 1, 1, 0, n)
    rows = [("a", t(1), False), ("a", t(1), False), ("a", t(2), False), ("b", t(1), False), ("b", t(3), True), ("b", t(4), False)]
    df = spark.createDataFrame(rows, feed.CHANGES)
    want = sorted((r.set_id, r.event, r.updated_at) for r in feed.feed_batch(df).collect())
    assert [w[:2] for w in want] == [("a", "updated"), ("a", "updated"), ("b", "deleted"), ("b", "updated")]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = feed.feed_stream(stream).writeStream.format("memory").queryName("feed").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.set_id, r.event, r.updated_at) for r in spark.table("feed").collect()) == want
