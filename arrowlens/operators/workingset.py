"""Named sub-graphs: members, notes and arrows of their own, with life cycle, one-hop queries and exports.

All changes give a new `WorkingSets`; nothing is changed in place.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arrowlens.operators.graph import Graph

SETS = "set_id string, name string, plan_hash string, status string, created_at long, updated_at long"
MEMBERS = "set_id string, id string"
NOTES = "set_id string, target_id string, note string, updated_at long"
SYNTHETIC = "set_id string, id string, kind string, src_id string, dst_id string, note string, source string"


@dataclass(frozen=True)
class WorkingSets:
    sets: DataFrame
    elems: DataFrame
    arrs: DataFrame
    notes: DataFrame
    synthetic: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> WorkingSets:
        return WorkingSets(*(spark.createDataFrame([], s) for s in (SETS, MEMBERS, MEMBERS, NOTES, SYNTHETIC)))

    def open(self, name: str, at: int, plan_hash: str | None = None, status: str = "active") -> tuple[WorkingSets, str]:
        import hashlib

        set_id = hashlib.sha256(f"{name}\0{plan_hash}\0{at}".encode()).hexdigest()[:32]
        row = self.sets.sparkSession.createDataFrame([(set_id, name, plan_hash, status, at, at)], SETS)
        return replace(self, sets=self.sets.unionByName(row)), set_id

    def touched(self, set_ids: Sequence[str], at: int) -> WorkingSets:
        s = self.sets.withColumn("updated_at", F.when(F.col("set_id").isin(list(set_ids)), F.lit(at)).otherwise(F.col("updated_at")))
        return replace(self, sets=s)

    def add(self, elems: DataFrame, arrs: DataFrame, at: int) -> tuple[WorkingSets, DataFrame]:
        """Members (set_id, id) that are not there yet; (set_id, elems, arrs) counts what was new."""
        new_e, new_a = newly(self.elems, elems), newly(self.arrs, arrs)
        n = new_e.select("set_id", F.lit(1).alias("e"), F.lit(0).alias("a")).unionByName(new_a.select("set_id", F.lit(0).alias("e"), F.lit(1).alias("a"))).groupBy("set_id").agg(F.sum("e").alias("elems"), F.sum("a").alias("arrs"))
        changed = elems.select("set_id").unionByName(arrs.select("set_id")).distinct().withColumn("now", F.lit(at))
        s = self.sets.join(changed, "set_id", "left").withColumn("updated_at", F.coalesce("now", "updated_at")).drop("now")
        return replace(self, sets=s, elems=self.elems.unionByName(new_e), arrs=self.arrs.unionByName(new_a)), n

    def listed(self) -> DataFrame:
        """(set_id, name, status, updated_at, elems, arrs), latest first."""
        e = self.elems.groupBy("set_id").agg(F.count(F.lit(1)).alias("elems"))
        a = self.arrs.groupBy("set_id").agg(F.count(F.lit(1)).alias("arrs"))
        z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return self.sets.join(e, "set_id", "left").join(a, "set_id", "left").select("set_id", "name", "status", "updated_at", z("elems"), z("arrs")).orderBy(F.desc("updated_at"), "set_id")

    def set_status(self, set_id: str, status: str, at: int) -> WorkingSets:
        is_it = F.col("set_id") == set_id
        s = self.sets.withColumn("status", F.when(is_it, status).otherwise(F.col("status"))).withColumn("updated_at", F.when(is_it, F.lit(at)).otherwise(F.col("updated_at")))
        return replace(self, sets=s)

    def drop(self, set_id: str) -> WorkingSets:
        return WorkingSets(*(d.where(F.col("set_id") != set_id) for d in (self.sets, self.elems, self.arrs, self.notes, self.synthetic)))

    def annotate(self, notes: DataFrame, at: int) -> WorkingSets:
        """Upserts (set_id, target_id, note); a null note removes the annotation."""
        fresh = notes.withColumn("updated_at", F.lit(at).cast("long"))
        kept = self.notes.join(fresh, ["set_id", "target_id"], "left_anti")
        return replace(self, notes=kept.unionByName(fresh.where("note IS NOT NULL").select(kept.columns)))

    def assert_arrows(self, g: Graph, arrows: DataFrame) -> WorkingSets:
        """Arrows (set_id, kind, src_id, dst_id, note, source) whose source exists; the destination may be null."""
        ok = arrows.join(g.elem.select(F.col("id").alias("src_id")), "src_id", "left_semi")
        key = F.concat_ws("\0", "set_id", "kind", "src_id", F.coalesce("dst_id", F.lit("")))
        fresh = ok.withColumn("id", F.concat(F.lit("syn:"), F.substring(F.sha2(key, 256), 1, 32)))
        fresh = fresh.join(self.synthetic.select("set_id", "id"), ["set_id", "id"], "left_anti").dropDuplicates(["set_id", "id"])
        return replace(self, synthetic=self.synthetic.unionByName(fresh.select(self.synthetic.columns)))

    def resolve(self, g: Graph, ends: DataFrame) -> WorkingSets:
        """Gives arrows their destination: ends (id, dst_id), where the destination exists."""
        ok = ends.select("id", F.col("dst_id").alias("to")).join(g.elem.select(F.col("id").alias("to")), "to", "left_semi")
        s = self.synthetic.join(ok, "id", "left").withColumn("dst_id", F.coalesce("to", "dst_id"))
        return replace(self, synthetic=s.select(self.synthetic.columns))

    def members(self, g: Graph, set_id: str, kind: str | None = None, name: str | None = None, module: str | None = None) -> DataFrame:
        """Member elements that exist, by the conditions of `Graph.elements`, with their annotation."""
        mine = self.elems.where(F.col("set_id") == set_id).select("id").distinct()
        return self.annotated(replace(g, elem=g.elem.join(mine, "id", "left_semi")).elements(kind, name, module), set_id)

    def annotated(self, df: DataFrame, set_id: str) -> DataFrame:
        n = self.notes.where(F.col("set_id") == set_id).select(F.col("target_id").alias("id"), F.col("note").alias("annotation"))
        return df.join(n, "id", "left")

    def arrows(self, g: Graph, set_id: str, source: str | None = None) -> DataFrame:
        """(id, kind, src_id, dst_id, synthetic): member arrows and the set's own, whatever the element conditions."""
        mine = self.arrs.where(F.col("set_id") == set_id).select("id").distinct()
        real = g.arr.join(mine, "id", "left_semi").select("id", "kind", "src_id", "dst_id", F.lit(False).alias("synthetic"))
        own = self.synthetic.where(F.col("set_id") == set_id)
        if source:
            own = own.where(F.col("source") == source)
        return real.unionByName(own.select("id", "kind", "src_id", "dst_id", F.lit(True).alias("synthetic")))

    def hop(self, g: Graph, set_id: str, kinds: Sequence[str], direction: str = "out", **where) -> tuple[DataFrame, DataFrame]:
        """One hop from members over arrows of the whole graph and the set's own: (element ids, arrows)."""
        seeds = self.members(g, set_id, **where).select("id").distinct()
        own = self.synthetic.where(F.col("set_id") == set_id).select("id", "kind", "src_id", "dst_id", F.lit(True).alias("synthetic"))
        every = g.arr.select("id", "kind", "src_id", "dst_id", F.lit(False).alias("synthetic")).unionByName(own).where(F.col("kind").isin(list(kinds)))
        here, there = ("src_id", "dst_id") if direction == "out" else ("dst_id", "src_id")
        crossed = every.join(seeds.withColumnRenamed("id", here), here, "left_semi").select(every.columns)
        ids = seeds.unionByName(crossed.where(F.col(there).isNotNull()).select(F.col(there).alias("id"))).distinct()
        return ids, crossed


def newly(have: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.select("set_id", "id").distinct().join(have, ["set_id", "id"], "left_anti")


def dot_escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def dot_lines(elems: DataFrame, arrows: DataFrame, synthetic: DataFrame | None = None) -> DataFrame:
    """(ord, line): the DOT text of elements (id, name) and the arrows between them, in order; synthetic arrows with a
    known destination are dashed."""
    ids = elems.select("id")
    inside = arrows.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi").dropDuplicates(["id"])
    q = lambda c: F.concat(F.lit('"'), dot_escape(F.col(c)), F.lit('"'))
    nodes = elems.select(F.struct(F.lit(1).alias("part"), F.col("id").alias("key")).alias("ord"), F.concat(F.lit("  "), q("id"), F.lit(" [label="), q("name"), F.lit("];")).alias("line"))
    edge = lambda extra: F.concat(F.lit("  "), q("src_id"), F.lit(" -> "), q("dst_id"), F.lit(" [label="), q("kind"), F.lit(extra), F.lit("];"))
    edges = inside.select(F.struct(F.lit(2).alias("part"), F.col("id").alias("key")).alias("ord"), edge("").alias("line"))
    out = nodes.unionByName(edges)
    if synthetic is not None:
        s = synthetic.where("dst_id IS NOT NULL").select(F.struct(F.lit(3).alias("part"), F.col("id").alias("key")).alias("ord"), edge(", style=dashed, color=blue").alias("line"))
        out = out.unionByName(s)
    spark = elems.sparkSession
    ends = spark.createDataFrame([(0, "", "digraph G {"), (9, "", "}")], "part int, key string, line string").select(F.struct("part", "key").alias("ord"), "line")
    return ends.unionByName(out).select(F.concat_ws("|", F.col("ord.part").cast("string"), "ord.key").alias("ord"), "line")


#: Colours of element kinds in a drawing; kinds that are not listed are drawn as `other`.
COLOURS = {
    "domain": "#FFD700", "function": "#4A90D9", "method": "#5B9BD5", "class": "#70AD47", "interface": "#9B59B6",
    "type": "#1ABC9C", "import": "#95A5A6", "module": "#7F8C8D", "file": "#BDC3C7", "property": "#E67E22",
    "const": "#E74C3C", "var": "#C0392B", "enum": "#F39C12", "namespace": "#2ECC71", "other": "#ECF0F1",
}


def drawing(elems: DataFrame, arrows: DataFrame, synthetic: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) for a viewer: nodes coloured by kind, edges between included nodes only; a synthetic arrow
    without destination loops at its source, and its note stands in for a missing annotation."""
    colour = F.create_map(*(F.lit(x) for kv in COLOURS.items() for x in kv))
    n = notes.select(F.col("target_id").alias("id"), F.col("note").alias("annotation"))
    nodes = elems.select("id", "kind", "name", "module").join(n, "id", "left").withColumn("colour", F.coalesce(F.try_element_at(colour, F.col("kind")), F.lit(COLOURS["other"])))
    ids = elems.select("id")
    edges = arrows.select("id", "kind", "src_id", "dst_id", F.lit(None).cast("string").alias("note"), F.lit(False).alias("synthetic")).unionByName(synthetic.select("id", "kind", "src_id", F.coalesce("dst_id", "src_id").alias("dst_id"), "note", F.lit(True).alias("synthetic")))
    edges = edges.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
    return nodes, edges.join(n, "id", "left").withColumn("annotation", F.coalesce("annotation", "note")).drop("note")
