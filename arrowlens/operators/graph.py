"""The graph model: elements, arrows and provenance as DataFrames, with scans, counts and derived arrows."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from arrowlens.functions.text import plain_kind
from arrowlens.runtime import Scratch
from arrowlens.sources.tables import table

#: The vocabulary of element and arrow kinds. It is advice; other kinds may stand in the data.
ELEMENT_KINDS = (
    "file", "module", "symbol", "callsite", "import", "type", "interface", "class", "enum", "function", "method",
    "const", "var", "namespace", "property", "domain", "other",
)
ARROW_KINDS = (
    "extends", "implements", "calls", "imports", "exports", "references", "contains", "returns", "param", "typeof",
    "instanceof", "definedIn", "inModule", "memberOf", "callerOf", "calleeOf", "importsFrom", "locatedIn",
    "hasProperty", "hasType", "implementedAs", "proposedImplementation", "discoveredDependency",
    "discoveredAmbiguity", "throws", "other",
)
#: Kinds that are read off another kind instead of being stored: derived kind -> (stored kind, reversed).
DERIVED = {"inModule": ("definedIn", False), "locatedIn": ("definedIn", False), "contains": ("definedIn", True), "imports": ("importsFrom", True)}


@dataclass(frozen=True)
class Graph:
    """elem(id, kind, name, module, span, attrs), arr(id, kind, src_id, dst_id, attrs),
    prov(elem_id, source, commit_sha, ingested_at, confidence)."""

    elem: DataFrame
    arr: DataFrame
    prov: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.elem.sparkSession

    def with_arrows(self, arr: DataFrame) -> Graph:
        return replace(self, arr=arr)

    # scans -----------------------------------------------------------------------------------------------------

    def elements(self, kind: str | None = None, name: str | None = None, module: str | None = None, limit: int | None = None) -> DataFrame:
        """Elements by kind ('any' is no condition) and unanchored regular expressions of name and module, which null
        never meets. With a limit the first by module (nulls first), name, id."""
        df = self.elem
        if kind and kind != "any":
            df = df.where(F.col("kind") == kind)
        if name:
            df = df.where(F.col("name").rlike(name))
        if module:
            df = df.where(F.col("module").rlike(module))
        return df if limit is None else df.orderBy(F.col("module").asc_nulls_first(), F.col("name").asc_nulls_first(), "id").limit(limit)

    def with_confidence(self, df: DataFrame, confidence: str, once: bool = False) -> DataFrame:
        """Elements joined with their provenance rows of exactly this confidence; once keeps each element once."""
        p = self.prov.where(F.col("confidence") == confidence).select(F.col("elem_id").alias("id"), "confidence")
        return df.join(p.distinct() if once else p, "id")

    def element(self, id: str) -> DataFrame:
        return self.elem.where(F.col("id") == id)

    def arrow(self, id: str) -> DataFrame:
        return self.arr.where(F.col("id") == id)

    def in_module(self, module: str) -> DataFrame:
        return self.elem.where(F.col("module") == module)

    def has_arrow_kind(self, kind: str) -> bool:
        return not self.arr.where(F.col("kind") == kind).limit(1).isEmpty()

    def kinds_touching(self, kinds: list[str]) -> DataFrame:
        """(kind): arrow kinds with an end among elements of these kinds, sorted."""
        ids = self.elem.where(F.col("kind").isin(kinds) if kinds else F.lit(False)).select("id")
        ends = self.arr.select("kind", F.explode(F.array("src_id", "dst_id")).alias("id"))
        return ends.join(ids, "id", "left_semi").select("kind").distinct().orderBy("kind")

    # counts ----------------------------------------------------------------------------------------------------

    def counts(self) -> DataFrame:
        """(scope, kind, n): elements and arrows by kind, with null kind for the totals."""
        both = self.elem.select(F.lit("element").alias("scope"), "kind").unionByName(self.arr.select(F.lit("arrow").alias("scope"), "kind"))
        return both.groupBy("scope", "kind").agg(F.count(F.lit(1)).alias("n")).groupingSets([["scope", "kind"], ["scope"]], "scope", "kind").agg(F.sum("n").alias("n"))

    def degree(self, elements: DataFrame | None = None) -> DataFrame:
        """(id, degree): outgoing and incoming arrows of each element, 0 where there are none."""
        ends = self.arr.select(F.explode(F.array("src_id", "dst_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
        return (elements if elements is not None else self.elem).select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    # arrows ----------------------------------------------------------------------------------------------------

    def outgoing(self, id: str) -> DataFrame:
        return self.arr.where(F.col("src_id") == id)

    def incoming(self, id: str) -> DataFrame:
        return self.arr.where(F.col("dst_id") == id)

    def derived(self, kinds: list[str] | None = None) -> DataFrame:
        """Virtual arrows of the kinds of DERIVED, read off stored ones in one scan."""
        wanted = {k: v for k, v in DERIVED.items() if kinds is None or k in kinds}
        if not wanted:
            return self.arr.limit(0)
        made = [
            F.struct(F.lit(k).alias("kind"), (F.col("dst_id") if back else F.col("src_id")).alias("src_id"), (F.col("src_id") if back else F.col("dst_id")).alias("dst_id"), F.lit(stored).alias("of"))
            for k, (stored, back) in wanted.items()
        ]
        rows = self.arr.where(F.col("kind").isin(sorted({s for s, _ in wanted.values()}))).select("attrs", F.col("kind").alias("stored"), F.inline(F.array(*made))).where("of = stored")
        return rows.select(arrow_id(F.col("src_id"), F.col("kind"), F.col("dst_id")).alias("id"), "kind", "src_id", "dst_id", "attrs")

    def arrows_of(self, kind: str, derived: bool = False) -> DataFrame:
        """Stored arrows of a kind, or, if derived is on, the virtual ones of a derived kind."""
        return self.derived([kind]) if derived and kind in DERIVED else self.arr.where(F.col("kind") == kind)


def arrow_id(src: Column, kind: Column, dst: Column) -> Column:
    return F.concat_ws(":", src, kind, dst)


def one_row(df: DataFrame, key: str = "id") -> DataFrame:
    """One row for each key: of unequal ones the greatest by all other columns, so that every run keeps the same."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(*rest)).alias("_m")).select(key, *(F.col(f"_m.{c}").alias(c) for c in rest)).select(df.columns)


def element_id(module: str, line: int, col: int, kind: str, name: str) -> str:
    return f"module:{module}:{line}:{col}:{kind}:{name}"


def from_rows(elem: DataFrame, arr: DataFrame, prov: DataFrame | None = None) -> Graph:
    """A graph of frames that may lack id of arrows, span, attrs or provenance."""

    def padded(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
        return df.select(*(F.col(n) if n in df.columns else F.lit("{}" if n == "attrs" else None).cast("string").alias(n) for n in names))

    if "id" not in arr.columns:
        arr = arr.withColumn("id", arrow_id(F.col("src_id"), F.col("kind"), F.col("dst_id")))
    if prov is None:
        prov = elem.sparkSession.createDataFrame([], "elem_id string, source string, commit_sha string, ingested_at long, confidence string")
    return Graph(padded(elem, ("id", "kind", "name", "module", "span", "attrs")), padded(arr, ("id", "kind", "src_id", "dst_id", "attrs")), prov)


def store(g: Graph, scratch: Scratch) -> Graph:
    """The graph as Parquet tables in the shared folder, arrows partitioned by kind."""
    order = ("id", "src_id", "dst_id", "attrs", "kind")
    return Graph(scratch.write(g.elem, "elem"), scratch.write(g.arr.select(*order), "arr", by=["kind"]).select(g.arr.columns), scratch.write(g.prov, "prov"))


def code_graph(spark: SparkSession, sf_dir: str, bare: bool = False) -> Graph:
    """The delivered element, arrow and provenance tables: each id once, kinds without letter case and outer blanks
    where that gives a kind of the vocabulary. bare leaves out spans, attrs and provenance; the rows are the same, as
    of unequal rows of an id those columns decide last."""

    def kind(words: tuple[str, ...]) -> Column:
        known = F.create_map(*(F.lit(x) for w in words for x in (w.lower(), w)))
        return F.coalesce(F.try_element_at(known, plain_kind(F.col("kind"))), F.col("kind"))

    elem = table(spark, sf_dir, "olog_elem").unionByName(table(spark, sf_dir, "olog_elem_ext"))
    arr = table(spark, sf_dir, "olog_arr")
    if bare:
        elem, arr = elem.drop("span", "attrs"), arr.drop("attrs")
    elem = one_row(elem.where("id IS NOT NULL").withColumn("kind", kind(ELEMENT_KINDS)))
    arr = one_row(arr.where("id IS NOT NULL").withColumn("kind", kind(ARROW_KINDS)))
    if bare:
        return from_rows(elem, arr)
    return Graph(elem, arr, table(spark, sf_dir, "olog_prov"))
