"""Registered queries of the graph operators over the star-schema lens and the code graph, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from arrowlens.operators import constraints, context, domain, mining, motifs, plan, traverse, workingset
from arrowlens.operators.graph import ARROW_KINDS, ELEMENT_KINDS, Graph, code_graph, store
from arrowlens.runtime import Scratch
from arrowlens.sources.code import cross_file
from arrowlens.sources.lens import CTE, star_graph, star_lens
from arrowlens.sources.tables import table
from arrowlens.streaming import feed

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, lens: bool | str = True, queries: dict | None = None, oracles: dict[str, str] | None = None):
    """Registers a function of the star graph (lens), of the star graph as a plan that is not stored (lens "plan", for
    queries that read few kinds once; "sets" with repeated arrows), or of (spark, sf_dir)."""

    def add(f):
        graph = {"plan": star_lens, "sets": partial(star_lens, repeats=True)}.get(lens, star_graph)
        (QUERIES if queries is None else queries)[f.__name__] = (lambda spark, sf_dir: f(graph(spark, sf_dir))) if lens else f
        if sql:
            s = sql.strip()
            (ORACLES if oracles is None else oracles)[f.__name__] = (CTE + (", " + s[5:] if s.startswith("WITH ") else "\n" + s)) if lens else s
        return f

    return add


def ids(g: Graph, kind: str) -> DataFrame:
    return g.elem.where(F.col("kind") == kind).select("id")


def listed(c: str) -> F.Column:
    return F.array_join(c, ",")


# scans and counts ------------------------------------------------------------------------------------------------


@query("SELECT id, kind, name, module FROM elem WHERE kind = 'function' AND regexp_matches(name, '^BUILD') AND regexp_matches(module, '[13579]$|A') ORDER BY module NULLS FIRST, name, id LIMIT 50")
def scan_kind_regex_limit(g: Graph) -> DataFrame:
    return g.elements("function", "^BUILD", "[13579]$|A", 50).select("id", "kind", "name", "module")


@query("SELECT e.id, p.confidence FROM elem e JOIN prov p ON p.elem_id = e.id WHERE p.confidence = 'tentative' AND e.kind = 'method'")
def scan_confidence(g: Graph) -> DataFrame:
    return g.with_confidence(g.elements("method"), "tentative").select("id", "confidence")


@query("""
SELECT 'element' AS scope, kind, count(*) AS n FROM elem GROUP BY kind UNION ALL SELECT 'arrow', kind, count(*) FROM arr GROUP BY kind
UNION ALL SELECT 'element', NULL, count(*) FROM elem UNION ALL SELECT 'arrow', NULL, count(*) FROM arr""")
def overview_counts(g: Graph) -> DataFrame:
    return g.counts()


@query(
    """
WITH e AS (SELECT DISTINCT id, lower(trim(kind)) AS kind FROM (SELECT id, kind FROM olog_elem UNION ALL SELECT id, kind FROM olog_elem_ext)),
a AS (SELECT DISTINCT id, lower(trim(kind)) AS kind FROM olog_arr)
SELECT 'element' AS scope, kind, count(*) AS n FROM e GROUP BY kind UNION ALL SELECT 'arrow', kind, count(*) FROM a GROUP BY kind
UNION ALL SELECT 'element', NULL, count(*) FROM e UNION ALL SELECT 'arrow', NULL, count(*) FROM a""",
    lens=False,
)
def code_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = code_graph(spark, sf_dir)
    return Graph(g.elem.withColumn("kind", F.lower(F.trim("kind"))), g.arr.withColumn("kind", F.lower(F.trim("kind"))), g.prov).counts()


@query("SELECT 'customer:1' AS id, kind, count(*) AS n FROM arr WHERE src_id = 'customer:1' GROUP BY kind")
def neighbours_out(g: Graph) -> DataFrame:
    return g.outgoing("customer:1").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("customer:1").alias("id"), "kind", "n")


@query("SELECT 'supplier:1' AS id, kind, count(*) AS n FROM arr WHERE dst_id = 'supplier:1' GROUP BY kind")
def neighbours_in(g: Graph) -> DataFrame:
    return g.incoming("supplier:1").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("supplier:1").alias("id"), "kind", "n")


@query("""
SELECT kind, src_id, dst_id FROM (SELECT 'inModule' AS kind, src_id, dst_id FROM arr WHERE kind = 'definedIn'
UNION ALL SELECT 'locatedIn', src_id, dst_id FROM arr WHERE kind = 'definedIn' UNION ALL SELECT 'contains', dst_id, src_id FROM arr WHERE kind = 'definedIn'
UNION ALL SELECT 'imports', dst_id, src_id FROM arr WHERE kind = 'importsFrom') x""")
def derived_arrows(g: Graph) -> DataFrame:
    return g.derived().select("kind", "src_id", "dst_id")


@query("""
SELECT DISTINCT a.kind FROM arr a LEFT JOIN elem s ON s.id = a.src_id LEFT JOIN elem d ON d.id = a.dst_id
WHERE s.kind IN ('class', 'enum') OR d.kind IN ('class', 'enum')""")
def kinds_touching(g: Graph) -> DataFrame:
    return g.kinds_touching(["class", "enum"])


@query("""
SELECT e.id, coalesce(count(x.id), 0) AS degree FROM elem e LEFT JOIN (SELECT src_id AS id FROM arr UNION ALL SELECT dst_id FROM arr) x ON x.id = e.id
WHERE e.kind IN ('class', 'type', 'module') GROUP BY e.id""")
def degrees(g: Graph) -> DataFrame:
    return g.degree(g.elem.where(F.col("kind").isin("class", "type", "module")))


# traversal -------------------------------------------------------------------------------------------------------


@query("""
SELECT r.name, count(DISTINCT c.id) AS customers FROM elem c JOIN arr a ON a.src_id = c.id AND a.kind = 'memberOf'
JOIN arr b ON b.src_id = a.dst_id AND b.kind = 'definedIn' JOIN elem r ON r.id = b.dst_id WHERE c.kind = 'function' GROUP BY r.name""", lens="plan")
def traverse_two_hop(g: Graph) -> DataFrame:
    ends = traverse.reach(g, ids(g, "function"), ["memberOf", "definedIn"])
    return ends.join(g.elem.select("id", "name"), "id").groupBy("name").agg(F.countDistinct("seed").alias("customers"))


@query("""
WITH l0 AS (SELECT id FROM elem WHERE kind = 'class'),
l1 AS (SELECT DISTINCT a.dst_id AS id FROM arr a JOIN l0 ON a.src_id = l0.id WHERE a.kind = 'implements'),
l2 AS (SELECT DISTINCT a.dst_id AS id FROM arr a JOIN l1 ON a.src_id = l1.id WHERE a.kind = 'hasType'),
every AS (SELECT id, 0 AS l FROM l0 UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2)
SELECT e.id, min(l) AS first_level FROM every JOIN elem e ON e.id = every.id GROUP BY e.id""")
def traverse_closure(g: Graph) -> DataFrame:
    found, _ = traverse.traverse(g, ids(g, "class"), [("implements", "out"), ("hasType", "out")])
    return found.select("id", "first_level")


@query("""
WITH l1 AS (SELECT DISTINCT src_id AS id FROM arr WHERE kind = 'memberOf' AND dst_id = 'nation:3'),
l2 AS (SELECT DISTINCT a.src_id AS id FROM arr a JOIN l1 ON a.dst_id = l1.id WHERE a.kind = 'param')
SELECT 'nation:3' AS id UNION SELECT id FROM l1 UNION SELECT id FROM l2""")
def traverse_in(g: Graph) -> DataFrame:
    found, _ = traverse.traverse(g, g.element("nation:3"), [("memberOf", "in"), ("param", "in")])
    return found.select("id")


@query("SELECT a.id FROM arr a JOIN prov p ON p.elem_id = a.src_id WHERE a.kind = 'param' AND p.confidence = 'resolved'")
def traverse_confidence(g: Graph) -> DataFrame:
    _, passed = traverse.traverse(g, ids(g, "method"), [("param", "out")], confidence="resolved")
    return passed.select("id")


@query("""
WITH p1 AS (SELECT DISTINCT src_id AS seed, dst_id AS id FROM arr WHERE kind = 'references'),
p2 AS (SELECT DISTINCT p1.seed, a.dst_id AS id FROM p1 JOIN arr a ON a.src_id = p1.id AND a.kind = 'memberOf')
SELECT seed, count(*) AS n FROM p2 JOIN elem e ON e.id = p2.seed WHERE e.kind = 'function' GROUP BY seed""")
def reach_endpoint_counts(g: Graph) -> DataFrame:
    return traverse.reach(g, ids(g, "function"), ["references", "memberOf"]).groupBy("seed").agg(F.count(F.lit(1)).alias("n"))


@query(
    """
WITH lines AS (SELECT doc_id, line, line_text FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line_text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE contains(text, 'engine')) x),
hits AS (SELECT doc_id, line FROM lines WHERE contains(line_text, 'engine'))
SELECT DISTINCT doc_id || ':' || ((line - 1) // 5) AS elem_id FROM hits""",
    lens=False,
)
def literal_search_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of five lines as elements; those whose lines enclose a hit of the literal."""
    docs = table(spark, sf_dir, "documents")
    n = F.size(F.split("text", "\n"))
    blocks = docs.where("text IS NOT NULL").select(F.col("doc_id").alias("file"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / 5).cast("int"))).alias("b"))
    spans = blocks.select(F.concat_ws(":", F.col("file").cast("string"), F.col("b").cast("string")).alias("elem_id"), "file", (F.col("b") * 5 + 1).alias("start_line"), (F.col("b") * 5 + 5).alias("end_line"))
    return traverse.enclosing(traverse.literal_hits(docs, "engine"), spans)


# constraints and equations ---------------------------------------------------------------------------------------


@query("SELECT k AS kind FROM (SELECT 'callsite' AS k UNION ALL SELECT 'class') x WHERE k NOT IN (SELECT kind FROM elem)")
def constraint_existence(g: Graph) -> DataFrame:
    return constraints.existence(g, "callsite").unionByName(constraints.existence(g, "class"))


_LOW, _HIGH = "_[0-4]$", "_[5-9]$"


@query("""
WITH placed AS (SELECT id, CASE WHEN regexp_matches(module, '_[0-4]$') THEN 0 WHEN regexp_matches(module, '_[5-9]$') THEN 1 END AS layer FROM elem)
SELECT a.id AS arr_id, s.layer AS src_layer, d.layer AS dst_layer FROM arr a JOIN placed s ON s.id = a.src_id JOIN placed d ON d.id = a.dst_id
WHERE a.kind = 'references' AND s.layer < d.layer""")
def constraint_layering(g: Graph) -> DataFrame:
    return constraints.layering(g, [[_LOW], [_HIGH]], ["references"]).select("arr_id", "src_layer", "dst_layer")


@query("""
WITH r AS (SELECT elem_id, CASE confidence WHEN 'tentative' THEN 0 WHEN 'unresolved' THEN 1 WHEN 'resolved' THEN 2 END AS rank FROM prov)
SELECT a.id AS arr_id, s.rank AS src_rank, d.rank AS dst_rank FROM arr a JOIN r s ON s.elem_id = a.src_id JOIN r d ON d.elem_id = a.dst_id WHERE d.rank > s.rank""")
def constraint_monotonicity(g: Graph) -> DataFrame:
    return constraints.monotonicity(g)


@query("""
SELECT e.id, count(a.id) AS n FROM elem e LEFT JOIN arr a ON a.src_id = e.id AND a.kind = 'returns' WHERE e.kind = 'method' GROUP BY e.id HAVING count(a.id) <> 1""")
def constraint_totality(g: Graph) -> DataFrame:
    return constraints.totality(g, "method", "returns")


_SIDES = """
WITH l AS (SELECT a.src_id AS seed, list_sort(list(DISTINCT b.dst_id)) AS lhs FROM arr a JOIN arr b ON b.src_id = a.dst_id AND b.kind = 'hasType' WHERE a.kind = 'callerOf' GROUP BY 1),
st AS (SELECT DISTINCT a.src_id, b.dst_id FROM arr a JOIN arr b ON b.src_id = a.dst_id AND b.kind = 'hasType' WHERE a.kind = 'implements'),
r AS (SELECT a.src_id AS seed, list_sort(list(DISTINCT st.dst_id)) AS rhs FROM arr a JOIN st ON st.src_id = a.dst_id WHERE a.kind = 'references' GROUP BY 1),
s AS (SELECT coalesce(l.seed, r.seed) AS seed, coalesce(lhs, []) AS lhs, coalesce(rhs, []) AS rhs FROM l FULL JOIN r ON l.seed = r.seed)
"""


@query(_SIDES + "SELECT seed, lhs = rhs AS valid, len(list_filter(lhs, lambda x: NOT list_contains(rhs, x))) AS lhs_only_n, len(list_filter(rhs, lambda x: NOT list_contains(lhs, x))) AS rhs_only_n FROM s JOIN elem e ON e.id = s.seed WHERE e.kind = 'function'")
def equation_check(g: Graph) -> DataFrame:
    c = constraints.equation_check(g, ids(g, "function"), ["callerOf", "hasType"], ["references", "implements", "hasType"], from_right=True)
    return c.select("seed", "valid", F.size("lhs_only").alias("lhs_only_n"), F.size("rhs_only").alias("rhs_only_n"))


@query(_SIDES + "SELECT 'callerOf>hasType' AS lhs_path, count(*) FILTER (WHERE lhs = rhs) AS support, count(*) AS total FROM s")
def equation_coverage(g: Graph) -> DataFrame:
    """Both sides as whole relations, composed from the right."""
    empty = F.array().cast("array<string>")
    l, r = (traverse.path_relation(g, p).groupBy("seed").agg(F.array_sort(F.collect_set("id")).alias(n)) for p, n in ((["callerOf", "hasType"], "l"), (["references", "implements", "hasType"], "r")))
    s = l.join(r, "seed", "full_outer").select((F.coalesce("l", empty) == F.coalesce("r", empty)).alias("same"))
    return s.agg(F.count(F.when(F.col("same"), 1)).alias("support"), F.count(F.lit(1)).alias("total")).select(F.lit("callerOf>hasType").alias("lhs_path"), "support", "total")


# mining ----------------------------------------------------------------------------------------------------------

_MINE_KINDS, _MINE_SEEDS = ["callerOf", "hasType", "references", "implements", "memberOf"], ["class", "function"]
_MINE = """
WITH seeds AS (SELECT id AS seed, kind AS seed_kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY module NULLS FIRST, name, id) AS rn FROM elem WHERE kind IN ('class', 'function')) x WHERE rn <= 100),
k AS (SELECT DISTINCT kind, src_id, dst_id FROM arr WHERE kind IN ('callerOf', 'hasType', 'references', 'implements', 'memberOf')),
d1 AS (SELECT DISTINCT k.kind AS path, k.kind AS last, s.seed, k.dst_id AS id FROM seeds s JOIN k ON k.src_id = s.seed),
d2 AS (SELECT DISTINCT d1.path || '>' || k.kind AS path, k.kind AS last, d1.seed, k.dst_id AS id FROM d1 JOIN k ON k.src_id = d1.id AND k.kind <> d1.last),
reached AS (SELECT path, seed, id FROM d1 UNION ALL SELECT path, seed, id FROM d2),
notes AS (SELECT r.path, CASE WHEN count(DISTINCT s.seed_kind) = 1 THEN min(s.seed_kind) END AS domain_kind, list_sort(list(DISTINCT e.kind)) AS codomain_kinds
  FROM reached r JOIN seeds s ON s.seed = r.seed JOIN elem e ON e.id = r.id GROUP BY r.path),
pairs AS (SELECT l.domain_kind, l.path AS lhs, r.path AS rhs FROM notes l JOIN notes r ON l.domain_kind IS NOT DISTINCT FROM r.domain_kind
  AND (len(string_split(l.path, '>')) < len(string_split(r.path, '>')) OR (len(string_split(l.path, '>')) = len(string_split(r.path, '>')) AND l.path < r.path))
  AND len(list_intersect(l.codomain_kinds, r.codomain_kinds)) > 0)
"""


def _mined(g: Graph) -> tuple[DataFrame, DataFrame]:
    seeds = mining.sample_seeds(g, _MINE_SEEDS, 100)
    return seeds, mining.path_reach(g, seeds, _MINE_KINDS, 2)


@query(_MINE + "SELECT path, domain_kind, array_to_string(codomain_kinds, ',') AS codomain_kinds FROM notes")
def mine_path_annotations(g: Graph) -> DataFrame:
    seeds, reached = _mined(g)
    return mining.annotate(g, reached, seeds).select(F.array_join("path", ">").alias("path"), "domain_kind", listed("codomain_kinds").alias("codomain_kinds"))


@query(_MINE + "SELECT domain_kind, lhs, rhs FROM pairs")
def mine_candidate_pairs(g: Graph) -> DataFrame:
    seeds, reached = _mined(g)
    return mining.candidate_pairs(mining.annotate(g, reached, seeds)).select("domain_kind", F.array_join("lhs", ">").alias("lhs"), F.array_join("rhs", ">").alias("rhs"))


@query(
    _MINE
    + """, sets AS (SELECT path, seed, list_sort(list(DISTINCT id)) AS ends FROM reached GROUP BY 1, 2),
sides AS (SELECT p.lhs, p.rhs, s.seed, s.ends AS l, CAST(NULL AS VARCHAR[]) AS r FROM pairs p JOIN sets s ON s.path = p.lhs UNION ALL SELECT p.lhs, p.rhs, s.seed, CAST(NULL AS VARCHAR[]), s.ends FROM pairs p JOIN sets s ON s.path = p.rhs),
joined AS (SELECT lhs, rhs, seed, max(l) AS l, max(r) AS r FROM sides GROUP BY 1, 2, 3)
SELECT lhs, rhs, count(*) FILTER (WHERE l = r) AS support, count(*) AS total FROM joined GROUP BY 1, 2"""
)
def mine_coverage(g: Graph) -> DataFrame:
    m = mining.mine_equations(g, _MINE_KINDS, _MINE_SEEDS, 2, 0.0, 100)
    return m.select(F.array_join("lhs", ">").alias("lhs"), F.array_join("rhs", ">").alias("rhs"), "support", "total")


@query(lens="sets")
def mine_equations(g: Graph) -> DataFrame:
    """All kinds and all seeds, ranked and pruned; the pruning by already kept equations is iterative."""
    kept = mining.prune(mining.mine_equations(g, None, mining.SEED_KINDS, 3, 0.8, None), 50)
    return g.spark.createDataFrame([(">".join(k["lhs"]), ">".join(k["rhs"]), k["support"], k["total"], k["coverage"]) for k in kept], "lhs string, rhs string, support long, total long, coverage double")


_MINE_ALL = f"""
WITH seeds AS (SELECT id AS seed, kind AS seed_kind FROM elem WHERE kind IN {mining.SEED_KINDS}),
k AS (SELECT DISTINCT kind, src_id, dst_id FROM arr WHERE kind IN {mining.UNIVERSE}),
d1 AS (SELECT DISTINCT k.kind AS path, k.kind AS last, s.seed, k.dst_id AS id FROM seeds s JOIN k ON k.src_id = s.seed),
""" + _MINE[_MINE.index("d2 AS") :]


def mine_coverage_sql() -> str:
    return """, sets AS (SELECT path, seed, list_sort(list(DISTINCT id)) AS ends FROM reached WHERE path IN (SELECT lhs FROM pairs UNION SELECT rhs FROM pairs) GROUP BY 1, 2),
sides AS (SELECT p.lhs, p.rhs, s.seed, s.ends AS l, CAST(NULL AS VARCHAR[]) AS r FROM pairs p JOIN sets s ON s.path = p.lhs UNION ALL SELECT p.lhs, p.rhs, s.seed, CAST(NULL AS VARCHAR[]), s.ends FROM pairs p JOIN sets s ON s.path = p.rhs),
joined AS (SELECT lhs, rhs, seed, max(l) AS l, max(r) AS r FROM sides GROUP BY 1, 2, 3)
SELECT lhs, rhs, count(*) FILTER (WHERE l = r) AS support, count(*) AS total FROM joined GROUP BY 1, 2"""


def _mined_all(g: Graph) -> DataFrame:
    return mining.path_kinds(g, mining.sample_seeds(g, size=None), mining.kinds_in_use(g), 2)


@query(_MINE_ALL + "SELECT path, domain_kind, array_to_string(codomain_kinds, ',') AS codomain_kinds FROM notes")
def mine_path_annotations_all(g: Graph) -> DataFrame:
    """Of all kinds and all seeds, as the next two; the queries without _all mine 5 kinds from a sample of 100 seeds a kind."""
    return _mined_all(g).select(F.array_join("path", ">").alias("path"), "domain_kind", listed("codomain_kinds").alias("codomain_kinds"))


@query(_MINE_ALL + "SELECT domain_kind, lhs, rhs FROM pairs")
def mine_candidate_pairs_all(g: Graph) -> DataFrame:
    return mining.candidate_pairs(_mined_all(g)).select("domain_kind", F.array_join("lhs", ">").alias("lhs"), F.array_join("rhs", ">").alias("rhs"))


@query(_MINE_ALL + mine_coverage_sql())
def mine_coverage_all(g: Graph) -> DataFrame:
    m = mining.mine_equations(g, None, mining.SEED_KINDS, 2, 0.0, None)
    return m.select(F.array_join("lhs", ">").alias("lhs"), F.array_join("rhs", ">").alias("rhs"), "support", "total")


# motifs ----------------------------------------------------------------------------------------------------------

_EGO = """
WITH d1 AS (SELECT DISTINCT src_id AS seed, dst_id AS id FROM arr WHERE kind IN ('returns', 'typeof') AND src_id LIKE 'order:%'),
nodes AS (SELECT id AS seed, id FROM elem WHERE kind = 'method' UNION SELECT seed, id FROM d1),
roles AS (SELECT n.seed, n.id, e.kind, e.kind || '_' || (row_number() OVER (PARTITION BY n.seed, e.kind ORDER BY n.id) - 1) AS role FROM nodes n JOIN elem e ON e.id = n.id),
objs AS (SELECT seed, list_sort(list({'kind': kind, 'role': role})) AS objects FROM roles GROUP BY seed),
ars AS (SELECT a.src_id AS seed, list_sort(list({'fromRole': f.role, 'label': a.kind, 'toRole': t.role})) AS arrows FROM arr a
  JOIN roles f ON f.seed = a.src_id AND f.id = a.src_id JOIN roles t ON t.seed = a.src_id AND t.id = a.dst_id WHERE a.kind IN ('returns', 'typeof') GROUP BY a.src_id),
hashed AS (SELECT o.seed, sha256(CAST(to_json({'objects': o.objects, 'arrows': coalesce(ars.arrows, [])}) AS VARCHAR)) AS shape_hash FROM objs o LEFT JOIN ars ON ars.seed = o.seed),
kept AS (SELECT shape_hash, count(*) AS support FROM hashed GROUP BY 1 HAVING count(*) >= 3)
"""


@query("""
WITH d0 AS (SELECT id AS seed, id FROM elem WHERE kind = 'class'),
d1 AS (SELECT DISTINCT d0.seed, a.dst_id AS id FROM d0 JOIN arr a ON a.src_id = d0.id WHERE a.kind IN ('memberOf', 'definedIn')),
n1 AS (SELECT seed, id FROM d0 UNION SELECT seed, id FROM d1),
d2 AS (SELECT DISTINCT n1.seed, a.dst_id AS id FROM n1 JOIN arr a ON a.src_id = n1.id WHERE a.kind IN ('memberOf', 'definedIn')),
n2 AS (SELECT seed, id FROM n1 UNION SELECT seed, id FROM d2),
e AS (SELECT n1.seed, count(*) AS n_edges FROM n1 JOIN arr a ON a.src_id = n1.id WHERE a.kind IN ('memberOf', 'definedIn') GROUP BY 1)
SELECT n.seed, n.n_nodes, coalesce(e.n_edges, 0) AS n_edges FROM (SELECT seed, count(*) AS n_nodes FROM n2 GROUP BY 1) n LEFT JOIN e ON e.seed = n.seed""")
def ego_sizes(g: Graph) -> DataFrame:
    nodes, edges = traverse.ego(g, ids(g, "class"), 2, ["memberOf", "definedIn"])
    n = nodes.groupBy("seed").agg(F.count(F.lit(1)).alias("n_nodes"))
    e = edges.groupBy("seed").agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(e, "seed", "left").select("seed", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


@query(_EGO + "SELECT shape_hash, support FROM kept")
def motif_shapes(g: Graph) -> DataFrame:
    found = motifs.shapes(g, motifs.motif_seeds(g, ["method"]), 1, ["returns", "typeof"])
    return motifs.group_shapes(found).select("shape_hash", "support")


@query(_EGO + "SELECT h.shape_hash, r.seed, r.role, r.id AS elem_id FROM hashed h JOIN kept k ON k.shape_hash = h.shape_hash JOIN roles r ON r.seed = h.seed")
def motif_instances(g: Graph) -> DataFrame:
    return motifs.instances(g, motifs.motif_seeds(g, ["method"]), 1, ["returns", "typeof"])


# domain ----------------------------------------------------------------------------------------------------------


_CODE = """
WITH e AS MATERIALIZED (SELECT id, max(struct_pack(kind := kind, name := name, module := module, attrs := attrs)) AS m FROM (
  SELECT id, coalesce(MAP {KINDS}[lower(trim(kind))], kind) AS kind, name, module, attrs FROM (SELECT id, kind, name, module, attrs FROM olog_elem UNION ALL SELECT id, kind, name, module, attrs FROM olog_elem_ext)) GROUP BY id),
elem AS MATERIALIZED (SELECT id, m.kind AS kind, m.name AS name, m.module AS module, m.attrs AS attrs FROM e),
arr AS MATERIALIZED (SELECT DISTINCT id, CASE lower(trim(kind)) {ARROWS} ELSE kind END AS kind, src_id, dst_id FROM olog_arr WHERE id IS NOT NULL)"""
_CODE = _CODE.replace("{KINDS}", "{" + ", ".join(f"'{k.lower()}': '{k}'" for k in ELEMENT_KINDS) + "}").replace("{ARROWS}", " ".join(f"WHEN '{k.lower()}' THEN '{k}'" for k in ARROW_KINDS))
#: Concepts of the code graph: what a domain element refers to stands in for what it is implemented as.
_MODEL = _CODE + ", labels AS MATERIALIZED (SELECT a.dst_id AS code_id, a.src_id AS concept FROM arr a JOIN elem d ON d.id = a.src_id WHERE d.kind = 'domain' AND a.kind = 'references')"


def _modelled(spark: SparkSession, sf_dir: str) -> Graph:
    g = code_graph(spark, sf_dir)
    d = g.elem.where("kind = 'domain'").select(F.col("id").alias("src_id"))
    own = g.arr.where("kind = 'references'").join(d, "src_id", "left_semi").select(g.arr.columns).withColumn("kind", F.lit("implementedAs"))
    return store(g.with_arrows(g.arr.unionByName(own)), Scratch(spark, "model"))


@query(_MODEL + " SELECT code_id, count(DISTINCT concept) AS n, string_agg(DISTINCT concept, ',' ORDER BY concept) AS domains FROM labels JOIN elem c ON c.id = code_id WHERE c.module IS NOT NULL AND NOT starts_with(c.module, 'node:') GROUP BY 1 HAVING count(DISTINCT concept) >= 2", lens=False)
def domain_pullbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.pullbacks(_modelled(spark, sf_dir)).select("code_id", "n", listed("domains").alias("domains"))


@query("SELECT dst_id, count(DISTINCT src_id) AS n FROM arr WHERE kind = 'implements' AND src_id LIKE 'supplier:%' GROUP BY dst_id HAVING count(DISTINCT src_id) >= 2")
def shared_targets(g: Graph) -> DataFrame:
    return domain.shared_targets(g, "implements", "class")


@query(
    _MODEL
    + """,
label AS (SELECT code_id, min(concept) AS concept FROM labels GROUP BY 1),
walk AS (SELECT id FROM elem WHERE kind IN ('function', 'method', 'const') AND module IS NOT NULL AND NOT starts_with(module, 'node:')),
calls AS MATERIALIZED (SELECT DISTINCT src_id AS caller, dst_id AS node FROM arr WHERE kind = 'callerOf' AND dst_id IN (SELECT id FROM walk)),
s0 AS MATERIALIZED (SELECT code_id AS start, code_id AS node, concept FROM label UNION SELECT l.code_id, a.src_id, l.concept FROM label l JOIN elem e ON e.id = l.code_id AND e.kind NOT IN ('function', 'method', 'const') JOIN arr a ON a.dst_id = l.code_id AND a.kind = 'memberOf' WHERE a.src_id <> l.code_id),
e1 AS (SELECT s.start, c.node, min(struct_pack(caller := c.caller, of := s.concept)).of AS of FROM s0 s JOIN calls c ON c.caller = s.node GROUP BY 1, 2),
l1 AS MATERIALIZED (SELECT e1.start, e1.node, e1.of, coalesce(l.concept, e1.node) AS concept, CASE WHEN l.concept IS NULL THEN 'tentative' ELSE 'resolved' END AS status FROM e1 LEFT JOIN label l ON l.code_id = e1.node WHERE (e1.start, e1.node) NOT IN (SELECT (start, node) FROM s0)),
e2 AS (SELECT s.start, c.node, min(struct_pack(caller := c.caller, of := s.concept)).of AS of FROM l1 s JOIN calls c ON c.caller = s.node GROUP BY 1, 2),
l2 AS (SELECT e2.start, e2.node, e2.of, coalesce(l.concept, e2.node) AS concept, CASE WHEN l.concept IS NULL THEN 'tentative' ELSE 'resolved' END AS status FROM e2 LEFT JOIN label l ON l.code_id = e2.node WHERE (e2.start, e2.node) NOT IN (SELECT (start, node) FROM s0 UNION ALL SELECT (start, node) FROM l1)),
every AS (SELECT of AS concept, concept AS dst, start AS via_start, 1 AS distance, status FROM l1 UNION ALL SELECT of, concept, start, 2, status FROM l2)
SELECT concept, dst, via_start, distance, status FROM (SELECT *, row_number() OVER (PARTITION BY concept, dst ORDER BY distance, via_start, status) AS rn FROM every) x WHERE rn = 1""",
    lens=False,
)
def domain_kan_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.kan_extension(_modelled(spark, sf_dir))


_CANDIDATES = """, cand AS (SELECT id, kind, name FROM elem WHERE kind IN ('interface', 'class', 'type') AND module IS NOT NULL AND NOT starts_with(module, 'node:')),
known AS (SELECT code_id, max(concept) AS concept FROM labels GROUP BY 1),
prop AS (SELECT DISTINCT c.id AS candidate, p.id AS property, CASE WHEN contains(p.name, '.') THEN substring(p.name, position('.' IN p.name) + 1) ELSE p.name END AS field,
  coalesce(p.attrs ->> '$.typeText', '') AS tt, coalesce(p.attrs ->> '$.optional' = 'true', false) AS optional FROM cand c JOIN arr h ON h.src_id = c.id AND h.kind = 'hasProperty' JOIN elem p ON p.id = h.dst_id)"""


@query(
    _MODEL
    + _CANDIDATES
    + """, rows AS (
  SELECT DISTINCT p.candidate, 'has ' || p.field AS name, p.property, t.dst_id AS type_id, NOT p.optional AND NOT contains(p.tt, '[]') AND NOT contains(p.tt, 'Array<') AS total, 'field' AS source FROM prop p JOIN arr t ON t.src_id = p.property AND t.kind = 'hasType'
  UNION ALL SELECT DISTINCT c.id, h.kind, NULL, h.dst_id, true, h.kind FROM cand c JOIN arr h ON h.src_id = c.id AND h.kind IN ('extends', 'implements')),
placed AS (SELECT r.*, CASE WHEN r.type_id IN (SELECT id FROM cand) THEN 'candidate' WHEN k.concept IS NOT NULL THEN 'concept' ELSE 'type' END AS codomain_kind, k.concept FROM rows r JOIN elem t ON t.id = r.type_id LEFT JOIN known k ON k.code_id = r.type_id)
SELECT candidate, name, property, CASE codomain_kind WHEN 'concept' THEN concept ELSE type_id END AS codomain, codomain_kind, total, source, CASE codomain_kind WHEN 'type' THEN 'unresolved' ELSE 'resolved' END AS confidence, NOT total AS asks
FROM placed WHERE source = 'field' OR codomain_kind <> 'type'""",
    lens=False,
)
def domain_field_arrows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = domain.field_arrows(_modelled(spark, sf_dir))
    return a.select("candidate", "name", "property", "codomain", "codomain_kind", "total", "source", "confidence", F.col("question").isNotNull().alias("asks"))


@query(
    _MODEL
    + _CANDIDATES
    + """ SELECT id AS candidate, 'alias' AS about FROM cand WHERE kind = 'type' AND id NOT IN (SELECT candidate FROM prop)
UNION ALL SELECT DISTINCT candidate, field FROM prop WHERE (contains(tt, 'Record<') OR (starts_with(tt, '{') AND NOT contains(tt, 'null'))) AND property NOT IN (SELECT src_id FROM arr WHERE kind = 'hasType')""",
    lens=False,
)
def domain_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.candidate_questions(_modelled(spark, sf_dir))


_PHRASE = "(CASE WHEN regexp_matches(p, '^[AEIOUaeiou]') THEN 'an ' ELSE 'a ' END) || p"
_SPELT = "array_to_string(list_transform(list_filter(string_split(regexp_replace(regexp_replace({n}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), ' '), lambda w: w <> ''), lambda w: coalesce(MAP {map}[w], w)), ' ')".replace("{map}", "{" + ", ".join(f"'{a}': '{b}'" for a, b in domain.ABBREVIATIONS.items()) + "}")
_CAPPED = "array_to_string(list_transform(list_filter(string_split(l, '{m}'), lambda w: w <> ''), lambda w: upper(substring(w, 1, 1)) || substring(w, 2)), ' ')"


@query(f"SELECT name, {_PHRASE} AS phrase FROM (SELECT name, {_SPELT.replace('{n}', 'name')} AS p FROM (SELECT DISTINCT name FROM olog_elem WHERE name IS NOT NULL) y) x", lens=False)
def noun_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "olog_elem").where("name IS NOT NULL").select("name").distinct().select("name", domain.noun_phrase(F.col("name")).alias("phrase"))


@query(
    f"""SELECT name, {_PHRASE} AS phrase FROM (SELECT name, CASE WHEN contains(l, '-') THEN {_CAPPED.replace('{m}', '-')} WHEN contains(l, '_') THEN {_CAPPED.replace('{m}', '_')} ELSE {_SPELT.replace('{n}', '(upper(substring(l, 1, 1)) || substring(l, 2))')} END AS p
FROM (SELECT DISTINCT name, string_split(name, '/')[-1] AS l FROM olog_elem WHERE name IS NOT NULL) y) x""",
    lens=False,
)
def noun_phrases_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "olog_elem").where("name IS NOT NULL").select("name").distinct().select("name", domain.noun_phrase_of_name(F.col("name")).alias("phrase"))


@query("""
WITH brief AS (SELECT DISTINCT 'b:' || c_mktsegment || '_' || k AS brief_id, 'function' AS kind, c_mktsegment || '_' || k AS name FROM customer, (VALUES ('0'), ('19'), ('77')) t(k))
SELECT b.brief_id, CASE count(e.id) WHEN 0 THEN 'to-create' WHEN 1 THEN 'existing' ELSE 'ambiguous' END AS mapping, count(e.id) AS n
FROM brief b LEFT JOIN elem e ON e.kind = b.kind AND e.name = b.name GROUP BY b.brief_id""")
def functor_mapping(g: Graph) -> DataFrame:
    seg = g.elem.where("kind = 'function'").select(F.regexp_extract("name", "^(.*)_", 1).alias("s")).distinct()
    name = F.concat_ws("_", "s", F.col("k"))
    b = seg.select("s", F.explode(F.array(F.lit("0"), F.lit("19"), F.lit("77"))).alias("k")).select(F.concat(F.lit("b:"), name).alias("id"), F.lit("function").alias("kind"), name.alias("name"))
    return domain.functor_mapping(g, b).select("brief_id", "mapping", "n")


_KEEP = """
WITH deg AS (SELECT e.id, e.name, e.module, count(x.id) AS degree FROM elem e LEFT JOIN (SELECT src_id AS id FROM arr UNION ALL SELECT dst_id FROM arr) x ON x.id = e.id WHERE e.kind = 'function' GROUP BY 1, 2, 3),
rk AS (SELECT *, first_value(id) OVER (PARTITION BY name, module ORDER BY degree DESC, id) AS keeper FROM deg)
SELECT name || '|' || module AS key, id, keeper FROM rk"""


@query(_KEEP)
def dedup_keepers(g: Graph) -> DataFrame:
    return domain.keepers(g, g.elem.where("kind = 'function'").select(F.concat_ws("|", "name", "module").alias("key"), "id"))


# similarity and context ------------------------------------------------------------------------------------------


_ANALOGUES = """
WITH t AS (SELECT id, name, module FROM elem WHERE {WHERE}),
c AS (SELECT DISTINCT src_id AS id, dst_id FROM arr WHERE kind = 'callerOf'), sz AS (SELECT id, count(*) AS n FROM c GROUP BY 1),
sh AS (SELECT a.id AS target, b.id, count(*) AS nb FROM c a JOIN t ON t.id = a.id JOIN c b ON b.dst_id = a.dst_id AND b.id <> a.id GROUP BY 1, 2),
nm AS (SELECT t.id AS target, e.id, 0 AS nb FROM t JOIN elem e ON e.name = t.name AND e.id <> t.id AND e.kind = 'function'),
pr AS (SELECT target, id, max(nb) AS nb FROM (SELECT * FROM sh UNION ALL SELECT * FROM nm) x GROUP BY 1, 2),
sc AS (SELECT p.target, p.id, greatest(CASE WHEN p.nb > 0 THEN CAST(p.nb AS DOUBLE) / (st.n + se.n - p.nb) ELSE 0 END, CASE WHEN e.name = t.name THEN 0.5 ELSE 0 END) AS s
  FROM pr p JOIN t ON t.id = p.target JOIN elem e ON e.id = p.id AND e.kind = 'function' LEFT JOIN sz st ON st.id = p.target LEFT JOIN sz se ON se.id = p.id WHERE e.module IS DISTINCT FROM t.module),
rk AS (SELECT target, id, s, row_number() OVER (PARTITION BY target ORDER BY s DESC, id) AS rank FROM sc WHERE s > 0)
SELECT target, id, CAST(round(s * 1000000000) AS BIGINT) AS similarity_e9, rank FROM rk WHERE rank <= 3"""


def _functions(g: Graph) -> Graph:
    """Functions and their calls: all that analogues of functions are found by."""
    return Graph(g.elem.where("kind = 'function'"), g.arr.where("kind = 'callerOf'"), g.prov)


@query(_ANALOGUES.replace("{WHERE}", "kind = 'function' AND TRY_CAST(substring(id, 10) AS BIGINT) % 20 = 0"), lens="plan")
def analogues_topk(g: Graph) -> DataFrame:
    """A search: its queries are the functions whose number is divisible by 20, against all; analogues_all asks for all."""
    g = _functions(g)
    a = context.analogues(g, ids(g, "function").where(F.substring("id", 10, 20).try_cast("bigint") % 20 == 0), 3)
    return a.select("target", "id", F.round(F.col("similarity") * 1_000_000_000).cast("bigint").alias("similarity_e9"), "rank")


@query(_ANALOGUES.replace("{WHERE}", "kind = 'function'"), lens="plan")
def analogues_all(g: Graph) -> DataFrame:
    """Analogues of every function."""
    g = _functions(g)
    a = context.analogues(g, ids(g, "function"), 3)
    return a.select("target", "id", F.round(F.col("similarity") * 1_000_000_000).cast("bigint").alias("similarity_e9"), "rank")


@query("SELECT a.dst_id AS from_id, count(DISTINCT a.src_id) AS n FROM arr a JOIN elem e ON e.id = a.dst_id WHERE a.kind = 'callerOf' AND e.kind = 'interface' GROUP BY 1")
def used_by(g: Graph) -> DataFrame:
    return context.used_by(g, ids(g, "interface")).groupBy("from_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT a.src_id AS from_id, a.dst_id AS id FROM arr a JOIN elem e ON e.id = a.src_id WHERE a.kind = 'callerOf' AND e.kind = 'function'")
def must_call(g: Graph) -> DataFrame:
    return context.must_call(g, ids(g, "function")).select("from_id", "id")


@query("SELECT a.src_id AS from_id, a.dst_id AS id FROM arr a JOIN elem s ON s.id = a.src_id JOIN elem d ON d.id = a.dst_id WHERE a.kind = 'callerOf' AND s.module <> d.module")
def missing_imports(g: Graph) -> DataFrame:
    return context.missing_imports(g, ids(g, "function"))


# working sets ----------------------------------------------------------------------------------------------------


def _sets(g: Graph) -> workingset.WorkingSets:
    """One set per nation with its customers and suppliers and their references."""
    w = workingset.WorkingSets.empty(g.spark)
    sets = g.elem.where("kind = 'namespace'").select(F.col("id").alias("set_id"), "name", F.lit(None).cast("string").alias("plan_hash"), F.lit("active").alias("status"), F.lit(0).cast("long").alias("created_at"), F.lit(0).cast("long").alias("updated_at"))
    w = workingset.WorkingSets(sets, w.elems, w.arrs, w.notes, w.synthetic)
    member = g.arr.where("kind = 'memberOf'").select(F.col("dst_id").alias("set_id"), F.col("src_id").alias("id"))
    refs = g.arr.where("kind = 'references'").join(member.withColumnRenamed("id", "src_id"), "src_id").select("set_id", "id")
    return w.add(member, refs, 1)[0]


_SET_SQL = "WITH m AS (SELECT DISTINCT dst_id AS set_id, src_id AS id FROM arr WHERE kind = 'memberOf'), r AS (SELECT DISTINCT m.set_id, a.id FROM arr a JOIN m ON m.id = a.src_id WHERE a.kind = 'references') "


@query(_SET_SQL + "SELECT e.id AS set_id, e.name, (SELECT count(*) FROM m WHERE m.set_id = e.id) AS elems, (SELECT count(*) FROM r WHERE r.set_id = e.id) AS arrs FROM elem e WHERE e.kind = 'namespace'")
def ws_list(g: Graph) -> DataFrame:
    return _sets(g).listed().select("set_id", "name", "elems", "arrs")


@query(_SET_SQL + "SELECT m.set_id, count(*) AS elems FROM m JOIN elem e ON e.id = m.id WHERE e.kind = 'class' GROUP BY 1")
def ws_add_counts(g: Graph) -> DataFrame:
    """Suppliers are new in a set that holds the customers."""
    member = g.arr.where("kind = 'memberOf'").select(F.col("dst_id").alias("set_id"), F.col("src_id").alias("id"))
    have = member.where("id LIKE 'customer:%'")
    return workingset.newly(have, member).groupBy("set_id").agg(F.count(F.lit(1)).alias("elems"))


@query(_SET_SQL + ", s AS (SELECT id FROM m WHERE set_id = 'nation:3') SELECT id FROM s UNION SELECT dst_id FROM arr WHERE kind = 'references' AND src_id IN (SELECT id FROM s)")
def ws_traverse(g: Graph) -> DataFrame:
    return _sets(g).hop(g, "nation:3", ["references"])[0]


@query(_SET_SQL + "SELECT m.id, CASE WHEN e.kind = 'class' THEN 'check ' || m.id END AS annotation FROM m JOIN elem e ON e.id = m.id WHERE m.set_id = 'nation:3'")
def ws_annotated(g: Graph) -> DataFrame:
    notes = ids(g, "class").select(F.lit("nation:3").alias("set_id"), F.col("id").alias("target_id"), F.concat(F.lit("check "), "id").alias("note"))
    w = _sets(g).annotate(notes, 5)
    return w.members(g, "nation:3").select("id", "annotation")


@query("""
WITH n AS (SELECT id, name FROM elem WHERE kind IN ('namespace', 'module'))
SELECT '0|' AS ord, 'digraph G {' AS line UNION ALL SELECT '9|', '}' UNION ALL SELECT '1|' || id, '  "' || id || '" [label="' || name || '"];' FROM n
UNION ALL SELECT '2|' || a.id, '  "' || a.src_id || '" -> "' || a.dst_id || '" [label="' || a.kind || '"];' FROM arr a JOIN n s ON s.id = a.src_id JOIN n d ON d.id = a.dst_id""")
def dot_export(g: Graph) -> DataFrame:
    return workingset.dot_lines(g.elem.where(F.col("kind").isin("namespace", "module")).select("id", "name"), g.arr)


@query(
    """
WITH c AS (SELECT user_id AS set_id, date_trunc('hour', ts) AS t, event_type = 'error' AND user_id % 5 = 0 AS deleted FROM events),
s AS (SELECT *, max(t) OVER w AS before, max(CAST(deleted AS INTEGER)) OVER w AS gone FROM c WINDOW w AS (PARTITION BY set_id ORDER BY t, deleted ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT set_id, CASE WHEN deleted THEN 'deleted' ELSE 'updated' END AS event, count(*) AS n FROM s WHERE coalesce(gone, 0) = 0 AND (deleted OR before IS NULL OR t > before) GROUP BY 1, 2""",
    lens=False,
)
def ws_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    c = e.select(F.col("user_id").alias("set_id"), F.date_trunc("hour", "ts").alias("updated_at"), ((F.col("event_type") == "error") & (F.col("user_id") % 5 == 0)).alias("deleted"))
    return feed.feed_batch(c).groupBy("set_id", "event").agg(F.count(F.lit(1)).alias("n"))


# plans -----------------------------------------------------------------------------------------------------------


def _ops(g: Graph) -> DataFrame:
    """Customers of nation 3 move to nation 4's module; class 2 goes; a symbol and an arrow come."""
    moved = g.arr.where("kind = 'memberOf' AND dst_id = 'nation:3' AND src_id LIKE 'customer:%'").select(F.col("src_id").alias("target"))
    e4 = g.element("nation:4").select(F.lit("nation:4").alias("to"), F.col("name").alias("module"))
    mv = moved.withColumn("to", F.lit("nation:4")).join(e4, "to").select(F.lit("move").alias("op"), "target", "module")
    rows = plan.plan_rows(g.spark, [{"op": "remove_symbol", "target": "supplier:2"}, {"op": "add_symbol", "name": "Made", "module": "here", "kind": "class"}, {"op": "add_arrow", "src": "customer:1", "dst": "manual:here:0:0:class:Made", "kind": "calls"}, {"op": "rename", "target": "nowhere:1", "name": "x"}])
    m = mv.select(F.lit(100).alias("ord"), "op", "target", F.lit(None).cast("string").alias("name"), "module", *(F.lit(None).cast("string").alias(c) for c in ("kind", "src", "dst", "text")))
    return rows.unionByName(m)


@query("""
WITH mv AS (SELECT src_id AS id FROM arr WHERE kind = 'memberOf' AND dst_id = 'nation:3' AND src_id LIKE 'customer:%'),
p AS (SELECT e.id, e.name, CASE WHEN mv.id IS NOT NULL THEN (SELECT name FROM elem WHERE id = 'nation:4') ELSE e.module END AS module, mv.id IS NOT NULL AS touched FROM elem e LEFT JOIN mv ON mv.id = e.id WHERE e.id <> 'supplier:2')
SELECT module, name, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) > 1 AND bool_or(touched)""")
def plan_projected_conflicts(g: Graph) -> DataFrame:
    return plan.name_conflicts(g, _ops(g))


@query("SELECT 'supplier:2' AS target, id AS arr_id FROM arr WHERE src_id = 'supplier:2' OR dst_id = 'supplier:2'")
def plan_surviving_arrows(g: Graph) -> DataFrame:
    return plan.surviving_arrows(g, _ops(g))


@query("""
WITH mv AS (SELECT src_id AS id FROM arr WHERE kind = 'memberOf' AND dst_id = 'nation:3' AND src_id LIKE 'customer:%'),
p AS (SELECT e.id, e.name, CASE WHEN mv.id IS NOT NULL THEN (SELECT name FROM elem WHERE id = 'nation:4') ELSE e.module END AS module, mv.id IS NOT NULL AS touched FROM elem e LEFT JOIN mv ON mv.id = e.id WHERE e.id <> 'supplier:2'),
c AS (SELECT module, name FROM p GROUP BY 1, 2 HAVING count(*) > 1)
SELECT 'move' AS op, 'name is taken' AS fault, count(*) AS n FROM p JOIN c ON c.module = p.module AND c.name = p.name WHERE touched HAVING count(*) > 0
UNION ALL SELECT 'remove_symbol', 'arrow survives', count(*) FROM arr WHERE src_id = 'supplier:2' OR dst_id = 'supplier:2' HAVING count(*) > 0
UNION ALL SELECT 'rename', 'no such element', 1""")
def plan_validate(g: Graph) -> DataFrame:
    return plan.validate(g, _ops(g)).groupBy("op", "fault").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT id FROM (SELECT id FROM elem WHERE id <> 'supplier:2' UNION ALL SELECT 'manual:here:0:0:class:Made') x""")
def plan_applied_elements(g: Graph) -> DataFrame:
    return plan.apply(g, _ops(g))[0].elem.select("id")


_EDITS = """
WITH e AS (SELECT l_orderkey AS file, l_orderkey || '-' || l_partkey || '-' || l_suppkey AS edit_id, min(l_linenumber) AS s, min(l_linenumber) + CAST(min(l_quantity) AS INTEGER) % 3 AS x FROM lineitem GROUP BY 1, 2)
SELECT CAST(a.file AS VARCHAR) AS file, a.edit_id AS e1, b.edit_id AS e2 FROM e a JOIN e b ON a.file = b.file AND a.edit_id < b.edit_id AND a.s < b.x AND b.s < a.x"""


@query(_EDITS, lens=False)
def edit_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey")))
    e = l.groupBy(F.col("l_orderkey").cast("string").alias("file"), key.alias("edit_id")).agg(F.min("l_linenumber").cast("int").alias("start_line"), F.min("l_quantity").cast("int").alias("q"))
    e = e.select("file", "edit_id", F.lit(None).cast("string").alias("old_text"), F.lit("").alias("new_text"), "start_line", F.lit(1).alias("start_col"), (F.col("start_line") + F.col("q") % 3).alias("end_line"), F.lit(1).alias("end_col"))
    return plan.edit_conflicts(e)


# ingestion and merging -------------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT o.id AS pending_id, 'CUSTOMER_' AS x, c.name, c.module AS hint FROM arr a JOIN elem o ON o.id = a.src_id JOIN elem c ON c.id = a.dst_id WHERE a.kind = 'param'),
h AS (SELECT p.pending_id, e.id FROM p JOIN elem e ON e.name = p.name AND e.kind = 'function' AND ends_with(e.module, p.hint))
SELECT pending_id, min(id) AS dst_id FROM h GROUP BY 1 HAVING count(*) = 1""")
def cross_file_resolution(g: Graph) -> DataFrame:
    c = g.elem.select(F.col("id").alias("dst_id"), "name", F.col("module").alias("hint"))
    pending = g.arr.where("kind = 'param'").join(c, "dst_id").select(F.col("src_id").alias("pending_id"), "name", "hint")
    return cross_file(pending, g.elem.where("kind = 'function'"))


_MERGE = """
WITH man AS (SELECT elem_id FROM prov WHERE source <> 'tree-sitter'), ch AS (SELECT name AS module FROM elem WHERE id IN ('nation:1', 'nation:2')),
stale AS (SELECT id FROM elem WHERE module IN (SELECT module FROM ch) AND id NOT IN (SELECT elem_id FROM man)),
fresh AS (SELECT id FROM stale WHERE regexp_matches(id, '[02468]$'))
SELECT id FROM elem WHERE id NOT IN (SELECT id FROM stale) UNION SELECT id FROM fresh"""


@query(_MERGE)
def incremental_merge(g: Graph) -> DataFrame:
    """Two modules are extracted again and have lost the elements with odd numbers."""
    changed = g.elem.where(F.col("id").isin("nation:1", "nation:2")).select(F.col("name").alias("module"))
    fresh = g.elem.join(changed, "module", "left_semi").where(F.col("id").rlike("[02468]$"))
    return feed.merged(g, changed, fresh.select(g.elem.columns), g.arr.limit(0)).elem.select("id")
