"""Parent-child links into full hierarchies by heavy-path decomposition.

1. Links are normalised and made distinct; an id becomes a 128-bit surrogate (its MD5), so that among 10^11 ids a
   collision has a chance below 10^-16.
2. Pointer doubling separates cycles and adds up subtree sizes: after round k each node knows its 2^k-th ancestor and
   how many nodes lie within distance < 2^k below it. As depths have no gaps, the nodes whose pointer stays non-null
   from one round to the next are those on or below a cycle, and the rounds end.
3. The child with the largest subtree continues its parent's chain. Chain heads are found by doubling along heavy
   links only; a node keeps its place in its chain. A node that knows its head asks no more, so that every node is
   asked by one node at most.
4. Chains hang from chains; along a root path there are at most log2(n) of them. Doubling over the chain tree gives a
   head's root, depth and pre-order number; a node adds its place in the chain. A node's descendants are the interval
   (pre, pre + size) of its root's pre-order.
5. Paths: chains are cut into pieces of PIECE nodes; the text before a piece is found by doubling over the pieces, and
   a node's path is that text and the names of its piece up to the node. No row holds more than one piece or one path.

Steps are built when they are asked for: `cycles` needs no chains. Rounds number O(log depth), each a few joins of
narrow rows; every round is written to the shared folder, so that lost executors cost one round at most, and the
version before is removed. Where many rows ask one node (all children of one root), the question is salted: the
node's answer is repeated once per HOT rows that ask, for the 1000 most asked nodes.

Defined results: kinds are read without letter case and outer blanks; links with a null end are ignored; a link to
itself is a cycle of one. A child stated with several parents keeps the smallest parent id. Repeated links count once.
Nodes on or below a cycle have no path and no descendants. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, functions as F

from arrowlens.functions.text import plain_kind
from arrowlens.runtime import Scratch

#: Light siblings whose offsets one task adds up on average; larger families are split into parts.
SIBLINGS = 20_000
#: Rows that may ask one node before its answer is salted, and the number of nodes that are (the most asked).
HOT, MAX_HOT = 100_000, 1000
#: Nodes of one chain whose names lie in one row, and pre-order numbers in one block of the search for descendants.
PIECE, BLOCK = 256, 64


def surrogate(name: Column) -> Column:
    return F.unhex(F.md5(name))


def most_asked(counts: DataFrame, key: str, hot: int = HOT) -> list[tuple[bytes, int]]:
    """(key, salts) of counts (key, n): keys with `hot` rows or more, the MAX_HOT greatest of them. Keys beyond these
    have less than a thousandth of all rows."""
    rows = counts.where((F.col("n") >= hot) & F.col(key).isNotNull()).orderBy(F.desc("n")).limit(MAX_HOT).collect()
    return [(bytes(r[key]), -(-r["n"] // hot) + 1) for r in rows]


def asked(rows: DataFrame, answers: DataFrame, key: str, by: str, hot: list[tuple[bytes, int]], how: str = "left") -> DataFrame:
    """rows joined with answers (unique) on key; rows of hot keys are spread over salts by their column `by`."""
    if not hot:
        return rows.join(answers, key, how)
    salts = F.broadcast(rows.sparkSession.createDataFrame(hot, f"{key} binary, salts int"))
    spread = rows.join(salts, key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("salts")).cast("int"), F.lit(0))).drop("salts")
    copies = answers.join(salts, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return spread.join(copies, [key, "salt"], how).drop("salt")


class Hierarchy:
    """The decomposition of one set of links, as scratch tables of surrogates.

    nodes(id, name), parents(id, parent), tree(id, parent, size), cyclic(id, root, on_cycle), chains(id, head, place,
    rooted), hung(head, top, depth, done) and heads(head, top, depth).
    """

    def __init__(self, links: DataFrame, hot: int = HOT):
        """links has columns child and parent (text)."""
        self.spark, self.hot = links.sparkSession, hot
        self.scratch = Scratch(self.spark, "tree")
        edges = links.where("child is not null and parent is not null").groupBy("child").agg(F.min("parent").alias("parent"))
        coded = edges.select(surrogate(F.col("child")).alias("id"), surrogate(F.col("parent")).alias("parent"), F.col("child").alias("name"), F.col("parent").alias("above"))
        coded = self.scratch.write(coded, "links")
        ends = F.array(F.struct(F.col("id").alias("id"), F.col("name").alias("name")), F.struct(F.col("parent").alias("id"), F.col("above").alias("name")))
        self.nodes = self.scratch.write(coded.select(F.inline(ends)).distinct(), "nodes")
        self.parents = coded.select("id", "parent")

    def _most_asked(self, rows: DataFrame, key: str) -> list[tuple[bytes, int]]:
        return most_asked(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, self.hot)

    @cached_property
    def _doubled(self) -> tuple[DataFrame, list[DataFrame], bool]:
        """Pointers (id, far, size) left open after the last round, what each round added to subtree sizes (far, n,
        more), and whether there are open pointers. A round rewrites open pointers only."""
        s, gains, before = self.scratch, [], -1
        state = self.parents.select("id", F.col("parent").alias("far"), F.lit(1).cast("long").alias("size"))
        while True:
            asks = s.write(state.groupBy("far").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("more")), "asks")
            still, most = asks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
            if still in (0, before):
                return state, gains, still > 0
            gains.append(asks)
            before = still
            hot = most_asked(asks, "far", self.hot) if most >= self.hot else []
            answers = asks.select("far").join(state.select(F.col("id").alias("far"), F.col("far").alias("farther")), "far")
            moved = asked(state, answers, "far", "id", hot, "inner").select("id", F.col("farther").alias("far"), "size")
            grown = moved.join(asks.select(F.col("far").alias("id"), "more"), "id", "left").select("id", "far", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
            state = s.replace(grown, "state")

    @cached_property
    def tree(self) -> DataFrame:
        state, gains, has_cycles = self._doubled
        rows = self.nodes.select("id", F.lit(1).cast("long").alias("size"))
        for g in gains:
            rows = rows.unionByName(g.select(F.col("far").alias("id"), F.col("more").alias("size")))
        sizes = rows.groupBy("id").agg(F.sum("size").alias("size"))
        if has_cycles:
            sizes = sizes.join(state.select("id"), "id", "left_anti")
        return self.scratch.write(sizes.join(self.parents, "id", "left").select("id", "parent", "size"), "tree")

    @cached_property
    def cyclic(self) -> DataFrame | None:
        """far of an open node goes on until all of them lie on cycles; the least id is found by doubling around."""
        state, _, has_cycles = self._doubled
        if not has_cycles:
            return None
        s = self.scratch
        jump = state.select("id", "far")
        on = None
        while True:
            asks = s.replace(jump.groupBy("far").agg(F.count(F.lit(1)).alias("n")), "rings")
            now, most = asks.agg(F.count(F.lit(1)), F.max("n")).first()
            hot = most_asked(asks, "far", self.hot) if most >= self.hot else []
            if now == on:
                break
            on = now
            answers = asks.select("far").join(jump.select(F.col("id").alias("far"), F.col("far").alias("farther")), "far")
            jump = s.replace(asked(jump, answers, "far", "id", hot, "inner").select("id", F.col("farther").alias("far")), "jump")
        ring = asks.select(F.col("far").alias("id")).join(self.parents, "id").join(self.nodes, "id")
        ring = s.replace(ring.select("id", F.col("parent").alias("far"), F.col("name").alias("least")), "ring")
        while True:  # on a ring every node is asked by one other
            target = ring.select(F.col("id").alias("far"), F.col("far").alias("farther"), F.col("least").alias("other"))
            step = ring.join(target, "far").select("id", F.col("farther").alias("far"), F.least("least", "other").alias("least"), (F.col("other") < F.col("least")).alias("moved"))
            ring = s.replace(step, "ring")
            changed = not ring.where("moved").isEmpty()
            ring = ring.drop("moved")
            if not changed:
                break
        roots = ring.select(F.col("id").alias("far"), F.col("least").alias("root"))
        on_cycle = ring.select("id", F.lit(True).alias("on_cycle"))
        rooted = asked(jump, roots, "far", "id", hot, "inner").join(on_cycle, "id", "left")
        return s.write(rooted.select("id", "root", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle")), "cyclic")

    @cached_property
    def chains(self) -> DataFrame:
        """(id, head, place, rooted): rooted says whether the chain's head is a root."""
        heavy = self.tree.where("parent is not null").groupBy("parent").agg(F.max(F.struct("size", "id")).alias("m")).select(F.col("m.id").alias("id"), F.lit(True).alias("follows"))
        linked = self.tree.join(heavy, "id", "left").select("id", "parent", F.coalesce("follows", F.lit(False)).alias("follows"))
        linked = self.scratch.replace(linked, "linked")
        first = linked.where("NOT follows").select("id", F.col("id").alias("head"), F.lit(0).cast("long").alias("place"), F.lit(True).alias("done"), F.col("parent").isNull().alias("rooted"))
        above = linked.select(F.col("id").alias("head"), (~F.col("follows")).alias("done"), F.col("parent").isNull().alias("rooted"))
        rest = linked.where("follows").select("id", F.col("parent").alias("head")).join(above, "head").select("id", "head", F.lit(1).cast("long").alias("place"), "done", "rooted")
        state = self.scratch.replace(first.unionByName(rest), "chains")
        while not state.where("NOT done").isEmpty():
            target = state.select(F.col("id").alias("head"), F.col("head").alias("higher"), F.col("place").alias("more"), F.col("done").alias("there"), F.col("rooted").alias("r"))
            step = state.where("NOT done").drop("done", "rooted").join(target, "head").select("id", F.col("higher").alias("head"), (F.col("place") + F.col("more")).alias("place"), F.col("there").alias("done"), F.col("r").alias("rooted"))
            state = self.scratch.replace(state.where("done").unionByName(step), "chains")
        return state.drop("done")

    @cached_property
    def hung(self) -> DataFrame:
        """(head, top, depth, done): the chain that a chain hangs from and the number of its nodes above; done if that
        chain's head is a root."""
        heads = self.chains.where("place = 0").select(F.col("id").alias("head"), "rooted").join(self.tree.select(F.col("id").alias("head"), "parent"), "head")
        light = heads.where("parent is not null").select("head", "parent")
        up = self.chains.select(F.col("id").alias("parent"), F.col("head").alias("top"), F.col("place").alias("at"), F.col("rooted").alias("done"))
        below = asked(light, up, "parent", "head", self._most_asked(light, "parent"), "inner").select("head", "top", (F.col("at") + 1).alias("depth"), "done")
        roots = heads.where("parent is null").select("head", F.col("head").alias("top"), F.lit(0).cast("long").alias("depth"), F.lit(True).alias("done"))
        return self.scratch.write(roots.unionByName(below), "hung")

    @cached_property
    def heads(self) -> DataFrame:
        return self._climb(self.hung, "depth", "heads")

    def _climb(self, state: DataFrame, measure: str, name: str) -> DataFrame:
        """Adds `measure` along the chain tree up to the root's chain."""
        while True:
            open_ = state.where("NOT done")
            if open_.isEmpty():
                return state.drop("done")
            target = state.select(F.col("head").alias("top"), F.col("top").alias("higher"), F.col(measure).alias("more"), F.col("done").alias("there"))
            step = asked(open_.drop("done"), target, "top", "head", self._most_asked(open_, "top"), "inner").select("head", F.col("higher").alias("top"), (F.col(measure) + F.col("more")).alias(measure), F.col("there").alias("done"))
            state = self.scratch.replace(state.where("done").unionByName(step), name)

    def _rooted_heads(self) -> DataFrame:
        """(head, top, root_id, down): each chain with its root and the depth of its head."""
        roots = self.nodes.select(F.col("id").alias("top"), F.col("name").alias("root_id"))
        return asked(self.heads, roots, "top", "head", self._most_asked(self.heads, "top"), "inner").withColumnRenamed("depth", "down")

    def _placed(self) -> DataFrame:
        """(id, root_id, depth) of all nodes that lie in trees."""
        rows = asked(self.chains, self._rooted_heads(), "head", "id", self._most_asked(self.chains, "head"), "inner")
        return rows.select("id", "root_id", (F.col("down") + F.col("place")).alias("depth"))

    def positions(self) -> DataFrame:
        """(elem_id, root_id, depth): depth -1 and the cycle's smallest id on or below a cycle."""
        named = self._placed().join(self.nodes, "id").select(F.col("name").alias("elem_id"), "root_id", "depth")
        if self.cyclic is None:
            return named
        return named.unionByName(self.cyclic.join(self.nodes, "id").select(F.col("name").alias("elem_id"), F.col("root").alias("root_id"), F.lit(-1).cast("long").alias("depth")))

    def cycles(self) -> DataFrame:
        """(root_id, on_cycle, below): each cycle by its smallest id, its length and how many nodes hang below it."""
        if self.cyclic is None:
            return self.spark.createDataFrame([], "root_id string, on_cycle long, below long")
        c = F.col("on_cycle")
        return self.cyclic.groupBy(F.col("root").alias("root_id")).agg(F.count(F.when(c, 1)).alias("on_cycle"), F.count(F.when(~c, 1)).alias("below"))

    @cached_property
    def intervals(self) -> DataFrame:
        """(id, top, pre, size): pre-order in which the heavy child comes first; descendants are pre < x < pre + size.

        The offsets of light siblings are prefix sums in two levels: within parts of at most SIBLINGS children on
        average, and over the parts of a family.
        """
        light = self.chains.where("place = 0").select("id").join(self.tree, "id").where("parent is not null")
        largest = light.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        parted = light.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-largest // SIBLINGS)))).cast("int"))
        sums = parted.groupBy("parent", "part").agg(F.sum("size").alias("total"))
        before = F.sum("total").over(Window.partitionBy("parent").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        heavy = self.chains.where("place > 0").select("id").join(self.tree, "id").select("parent", F.col("size").alias("first"))
        up = self.chains.select(F.col("id").alias("parent"), F.col("place").alias("at"))
        starts = sums.withColumn("before", before).join(heavy, "parent", "left").join(up, "parent")
        starts = starts.select("parent", "part", (F.col("at") + 1 + F.coalesce("first", F.lit(0)) + F.coalesce("before", F.lit(0))).alias("start"))
        inside = Window.partitionBy("parent", "part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
        offset = parted.withColumn("within", F.sum("size").over(inside)).join(starts, ["parent", "part"]).select(F.col("id").alias("head"), (F.col("start") + F.coalesce("within", F.lit(0))).alias("pre"))
        hung = self.hung.select("head", "top", "done").join(offset, "head", "left").select("head", "top", F.coalesce("pre", F.lit(0)).alias("pre"), "done")
        pre = self._climb(self.scratch.write(hung, "offsets"), "pre", "pre")
        placed = asked(self.chains, pre, "head", "id", self._most_asked(self.chains, "head"), "inner")
        rows = placed.join(self.tree.select("id", "size"), "id").select("id", "top", (F.col("pre") + F.col("place")).alias("pre"), "size")
        return self.scratch.write(rows, "intervals")

    def _pieces(self, sep: str) -> DataFrame:
        """(piece, before, members, root_id, down): each piece of a chain with the text of all names above it."""
        piece = lambda head, place: F.concat(head, F.unhex(F.lpad(F.hex(F.floor(place / PIECE)), 16, "0")))
        cut = lambda members, n: F.array_join(F.transform(F.slice(members, F.lit(1), n), lambda m: F.concat(m["name"], F.lit(sep))), "")
        whole = self.chains.join(self.nodes, "id").join(self.intervals.select("id", "pre", "size"), "id")
        named = whole.select(piece(F.col("head"), F.col("place")).alias("piece"), "head", (F.col("rooted") & (F.col("place") < PIECE)).alias("base"), F.struct("place", "name", "pre", "size").alias("m"))
        pieces = named.groupBy("piece", "head", "base").agg(F.array_sort(F.collect_list("m")).alias("members"))
        pieces = pieces.withColumn("start", F.col("members")[0]["place"]).join(self._rooted_heads().drop("top"), "head")
        pieces = self.scratch.write(pieces, "pieces")
        above = self.hung.where("depth > 0").select("head", F.col("top").alias("over"), F.col("depth").alias("at"))
        first = pieces.where("start = 0 AND NOT base").select("piece", "head").join(above, "head").select("piece", piece(F.col("over"), F.col("at") - 1).alias("up"), ((F.col("at") - 1) % PIECE + 1).cast("int").alias("n"))
        later = pieces.where("start > 0").select("piece", piece(F.col("head"), F.col("start") - 1).alias("up"), F.lit(PIECE).alias("n"))
        links = self.scratch.write(first.unionByName(later), "links_up")
        over = pieces.select(F.col("piece").alias("up"), F.col("members").alias("names"), F.col("base").alias("done"))
        state = asked(links, over, "up", "piece", self._most_asked(links, "up"), "inner").select("piece", "up", cut(F.col("names"), F.col("n")).alias("before"), "done")
        roots = pieces.where("base").select("piece", F.col("piece").alias("up"), F.lit("").alias("before"), F.lit(True).alias("done"))
        state = self.scratch.replace(roots.unionByName(state), "above")
        while not (open_ := state.where("NOT done")).isEmpty():
            target = state.select(F.col("piece").alias("up"), F.col("up").alias("higher"), F.col("before").alias("more"), F.col("done").alias("there"))
            step = asked(open_.drop("done"), target, "up", "piece", self._most_asked(open_, "up"), "inner").select("piece", F.col("higher").alias("up"), F.concat("more", "before").alias("before"), F.col("there").alias("done"))
            state = self.scratch.replace(state.where("done").unionByName(step), "above")
        return state.select("piece", "before").join(pieces.select("piece", "members", "root_id", "down"), "piece")

    def paths(self, sep: str = " > ") -> DataFrame:
        """(elem_id, root_id, depth, path, pre, descendants): path from the root; nodes on or below cycles have none."""
        spread = self._pieces(sep).select("before", "members", "root_id", "down", F.posexplode("members").alias("k", "m"))
        own = F.array_join(F.transform(F.slice("members", F.lit(1), F.col("k") + 1), lambda m: m["name"]), sep)
        return spread.select(F.col("m.name").alias("elem_id"), "root_id", (F.col("down") + F.col("m.place")).alias("depth"), F.concat("before", own).alias("path"), F.col("m.pre").alias("pre"), (F.col("m.size") - 1).alias("descendants"))

    def descendants(self, ids: DataFrame | None = None) -> DataFrame:
        """(elem_id, descendant_id): every node below each of the ids (column id, text), or below every node.

        A node's interval meets only the blocks of BLOCK pre-order numbers that it covers, so that what is compared
        grows with the result.
        """
        named = self.intervals.join(self.nodes, "id").select("top", "pre", "size", "name")
        of = named.where("size > 1")
        if ids is not None:
            of = of.join(ids.select(F.col("id").alias("name")).distinct(), "name", "left_semi")
        block = lambda c: F.floor(c / BLOCK)
        last = F.col("pre") + F.col("size") - 1
        wanted = of.select("top", F.col("name").alias("elem_id"), F.col("pre").alias("low"), last.alias("high"), F.explode(F.sequence(block(F.col("pre") + 1), block(last))).alias("block"))
        points = named.select("top", block(F.col("pre")).alias("block"), "pre", F.col("name").alias("descendant_id"))
        return wanted.join(points, ["top", "block"]).where("pre > low AND pre <= high").select("elem_id", "descendant_id")


def hierarchy_links(arrows: DataFrame) -> DataFrame:
    """(child, parent) of the memberOf and contains arrows, as often as they are stated."""
    kind = plain_kind(F.col("kind"))
    up = kind == "memberof"
    return arrows.where(kind.isin("memberof", "contains")).select(F.when(up, F.col("src_id")).otherwise(F.col("dst_id")).alias("child"), F.when(up, F.col("dst_id")).otherwise(F.col("src_id")).alias("parent"))


def hierarchy(arrows: DataFrame, hot: int = HOT) -> Hierarchy:
    return Hierarchy(hierarchy_links(arrows), hot)
