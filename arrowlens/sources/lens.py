"""The relational tables read as a typed graph: rows become elements, foreign keys become arrows.

The statements run in Spark and, as common table expressions, in any engine with ANSI SQL. With a total order on
numeric ids they also give every element one provenance row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arrowlens.operators.graph import Graph, from_rows, store
from arrowlens.runtime import Scratch
from arrowlens.sources.tables import table

ELEM = """
SELECT 'region:' || r_regionkey AS id, 'module' AS kind, r_name AS name, r_name AS module FROM region
UNION ALL SELECT 'nation:' || n_nationkey, 'namespace', n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'customer:' || c_custkey, 'function', c_mktsegment || '_' || (c_custkey % 20), n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'supplier:' || s_suppkey, 'class', s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'part:' || p_partkey, 'interface', p_name, p_brand FROM part
UNION ALL SELECT 'order:' || o_orderkey, 'method', o_orderpriority, CAST(year(o_orderdate) AS VARCHAR(9)) FROM orders
UNION ALL SELECT DISTINCT 'ptype:' || p_type, 'type', p_type, CAST(NULL AS VARCHAR(9)) FROM part
UNION ALL SELECT DISTINCT 'brand:' || p_brand, 'property', p_brand, CAST(NULL AS VARCHAR(9)) FROM part
UNION ALL SELECT DISTINCT 'flag:' || l_returnflag, 'enum', l_returnflag, CAST(NULL AS VARCHAR(9)) FROM lineitem
UNION ALL SELECT DISTINCT 'status:' || l_linestatus, 'const', l_linestatus, CAST(NULL AS VARCHAR(9)) FROM lineitem
"""

ARR = """
SELECT 'definedIn' AS kind, 'nation:' || n_nationkey AS src_id, 'region:' || n_regionkey AS dst_id FROM nation
UNION ALL SELECT 'memberOf', 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
UNION ALL SELECT 'memberOf', 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
UNION ALL SELECT 'param', 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders
UNION ALL SELECT DISTINCT 'callerOf', 'customer:' || o_custkey, 'part:' || l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey
UNION ALL SELECT DISTINCT 'references', 'customer:' || o_custkey, 'supplier:' || l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey
UNION ALL SELECT DISTINCT 'implements', 'supplier:' || l_suppkey, 'part:' || l_partkey FROM lineitem
UNION ALL SELECT 'hasType', 'part:' || p_partkey, 'ptype:' || p_type FROM part
UNION ALL SELECT 'hasProperty', 'part:' || p_partkey, 'brand:' || p_brand FROM part
UNION ALL SELECT DISTINCT 'returns', 'order:' || l_orderkey, 'flag:' || l_returnflag FROM lineitem
UNION ALL SELECT DISTINCT 'typeof', 'order:' || l_orderkey, 'status:' || l_linestatus FROM lineitem
"""

PROV = """
SELECT id AS elem_id,
       CASE WHEN num % 10 = 0 THEN 'manual' ELSE 'tree-sitter' END AS source, 'seed42' AS commit_sha, CAST(0 AS BIGINT) AS ingested_at,
       CASE num % 3 WHEN 0 THEN 'tentative' WHEN 1 THEN 'unresolved' ELSE 'resolved' END AS confidence
FROM (SELECT id, CASE WHEN kind IN ('type', 'property', 'enum', 'const') THEN 5 ELSE CAST(substring(id, position(':' IN id) + 1) AS BIGINT) END AS num FROM elem) n
"""

#: Prefix of SQL over the lens; `WITH RECURSIVE` so that a query may add recursive tables.
CTE = f"WITH RECURSIVE elem AS MATERIALIZED ({ELEM}), arr0 AS ({ARR}), arr AS MATERIALIZED (SELECT src_id || ':' || kind || ':' || dst_id AS id, * FROM arr0), prov AS MATERIALIZED ({PROV})"

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


#: Graphs stored by this driver: (application, folder) -> Graph.
_STORED: dict[tuple[str, str], Graph] = {}


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The lens as stored tables: built once for each application and folder, arrows partitioned by kind, so that
    every traversal step reads its own kind only."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        _STORED[key] = store(star_lens(spark, sf_dir), Scratch(spark, "graph"))
    return _STORED[key]


def star_lens(spark: SparkSession, sf_dir: str, repeats: bool = False) -> Graph:
    """The lens as a plan over the relational tables; with repeats, for readers that take sets of arrows, an arrow stands
    there as often as rows say it."""
    for t in _TABLES:
        table(spark, sf_dir, t).createOrReplaceTempView(f"star_{t}")

    def sql(text: str) -> DataFrame:
        for t in _TABLES:
            text = text.replace(f"FROM {t} ", f"FROM star_{t} {t} ").replace(f"FROM {t}\n", f"FROM star_{t} {t}\n").replace(f"JOIN {t} ", f"JOIN star_{t} {t} ")
        return spark.sql(text.replace("VARCHAR(9)", "STRING"))

    elem, arr = sql(ELEM), sql(ARR.replace("SELECT DISTINCT", "SELECT") if repeats else ARR)
    elem.createOrReplaceTempView("star_elem")
    prov = spark.sql(PROV.replace("FROM elem", "FROM star_elem"))
    return from_rows(elem, arr, prov)
