"""Mining of path equations: which pairs of kind sequences reach the same sets from the same seeds.

All paths of one length are reached by one join: reach(path + kind) = reach(path) joined with the arrows, so that
d joins serve all paths of up to d kinds, and a path that reaches nothing is never extended. What decides which paths
are compared (kinds of seeds and ends) is reached from all seeds of a kind together. Mined equations are compared by
the least hashes of end sets, composed from the right; more of a set is made only where that leaves a pair open.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from arrowlens.operators.graph import Graph
from arrowlens.runtime import Scratch, shuffle_partitions

#: Kinds that mining follows and kinds it seeds from.
UNIVERSE = (
    "extends", "implements", "calls", "exports", "references", "returns", "param", "typeof", "instanceof", "definedIn",
    "memberOf", "callerOf", "calleeOf", "importsFrom", "hasProperty", "hasType", "implementedAs", "other",
)
SEED_KINDS = ("function", "method", "class", "interface", "type", "import", "module", "domain", "property")


def enumerate_paths(kinds: Sequence[str], depth: int, most: int = 10_000) -> list[tuple[str, ...]]:
    """All kind sequences of up to `depth` without the same kind twice in a row, shorter first; lengthening stops
    after the level on which there are more than `most`."""
    level: list[tuple[str, ...]] = [()]
    out: list[tuple[str, ...]] = []
    for _ in range(depth):
        level = [p + (k,) for p in level for k in kinds if not p or p[-1] != k]
        out += level
        if len(out) > most:
            break
    return out


def kinds_in_use(g: Graph, universe: Sequence[str] = UNIVERSE, touching: Sequence[str] | None = None) -> list[str]:
    """Arrow kinds of the universe that occur, in its order; with `touching` only those at elements of these kinds."""
    if touching is not None:
        near = {r["kind"] for r in g.kinds_touching(list(touching)).collect()}
        return [k for k in universe if k in near]
    used = {r["kind"] for r in g.arr.where(F.col("kind").isin(list(universe))).select("kind").distinct().collect()}
    return [k for k in universe if k in used]


def sample_seeds(g: Graph, kinds: Sequence[str] = SEED_KINDS, size: int | None = 100) -> DataFrame:
    """(seed, seed_kind, seed_name): of each kind the first `size` by module (nulls first), name, id; all if None."""
    e = g.elem.where(F.col("kind").isin(list(kinds)))
    if size is not None:
        w = Window.partitionBy("kind").orderBy(F.col("module").asc_nulls_first(), "name", "id")
        e = e.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= size)
    return e.select(F.col("id").alias("seed"), F.col("kind").alias("seed_kind"), F.col("name").alias("seed_name"))


def _lengthened(g: Graph, level: DataFrame, kinds: Sequence[str], depth: int) -> DataFrame:
    """(path, seed, id) of (seed, id): what every path of up to `depth` kinds reaches from the ids of a seed, ids
    without an element among it."""
    a = g.arr.where(F.col("kind").isin(list(kinds))).select(F.col("src_id").alias("id"), F.col("kind").alias("k"), "dst_id")
    level = level.select(F.array().cast("array<string>").alias("path"), "seed", "id")
    out = None
    for _ in range(depth):
        last = F.try_element_at("path", F.lit(-1))
        level = level.join(a, "id").where(last.isNull() | (last != F.col("k"))).select(F.concat("path", F.array("k")).alias("path"), "seed", F.col("dst_id").alias("id")).distinct()
        out = level if out is None else out.unionByName(level)
    return out


def path_reach(g: Graph, seeds: DataFrame, kinds: Sequence[str], depth: int) -> DataFrame:
    """(path, seed, id): the endpoint set of every path of up to `depth` kinds from every seed."""
    return _lengthened(g, seeds.select("seed", F.col("seed").alias("id")), kinds, depth).join(g.elem.select("id"), "id", "left_semi").select("path", "seed", "id")


def path_kinds(g: Graph, seeds: DataFrame, kinds: Sequence[str], depth: int) -> DataFrame:
    """The result of `annotate`, reached from all seeds of a kind together instead of from each."""
    ends = _lengthened(g, seeds.select(F.col("seed_kind").alias("seed"), F.col("seed").alias("id")), kinds, depth)
    named = ends.join(g.elem.select("id", F.col("kind").alias("end_kind")), "id").select("path", F.col("seed").alias("seed_kind"), "end_kind")
    return _annotated(named)


def annotate(g: Graph, reached: DataFrame, seeds: DataFrame) -> DataFrame:
    """(path, domain_kind, codomain_kinds): the one kind of seed that reaches something, null if several; and the
    sorted kinds reached."""
    named = reached.join(seeds.select("seed", "seed_kind"), "seed").join(g.elem.select("id", F.col("kind").alias("end_kind")), "id")
    return _annotated(named)


def _annotated(named: DataFrame) -> DataFrame:
    kinds = named.groupBy("path").agg(F.collect_set("seed_kind").alias("d"), F.array_sort(F.collect_set("end_kind")).alias("codomain_kinds"))
    return kinds.select("path", F.when(F.size("d") == 1, F.get("d", F.lit(0))).alias("domain_kind"), "codomain_kinds")


def candidate_pairs(paths: DataFrame) -> DataFrame:
    """(domain_kind, lhs, rhs): pairs of different paths of one domain kind (or both of none) whose codomains overlap,
    lhs before rhs in the order of enumeration (length, then text)."""
    p = paths.withColumn("ord", F.struct(F.size("path").alias("n"), F.array_join("path", ">").alias("t")))
    l, r = p.select(F.col("domain_kind"), F.col("path").alias("lhs"), F.col("codomain_kinds").alias("lc"), F.col("ord").alias("lo")), p.select(F.col("domain_kind").alias("rd"), F.col("path").alias("rhs"), F.col("codomain_kinds").alias("rc"), F.col("ord").alias("ro"))
    pairs = l.join(r, F.col("domain_kind").eqNullSafe(F.col("rd")) & (F.col("lo") < F.col("ro")) & F.arrays_overlap("lc", "rc"))
    return pairs.select("domain_kind", "lhs", "rhs")


def reach_sets(reached: DataFrame) -> DataFrame:
    return reached.groupBy("path", "seed").agg(F.array_sort(F.collect_set("id")).alias("ends"))


def evaluate(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(lhs, rhs, seed, lhs_ends, rhs_ends, same): a row for each seed from which at least one side reaches anything.

    Each pair meets the sets of each side once; the two halves are brought together by (pair, seed), so that no seed
    is paired with another.
    """
    keyed = pairs.select("lhs", "rhs").distinct()
    left = keyed.join(sets.withColumnRenamed("path", "lhs"), "lhs").select("lhs", "rhs", "seed", F.col("ends").alias("l"), F.lit(None).cast("array<string>").alias("r"))
    right = keyed.join(sets.withColumnRenamed("path", "rhs"), "rhs").select("lhs", "rhs", "seed", F.lit(None).cast("array<string>").alias("l"), F.col("ends").alias("r"))
    both = left.unionByName(right).groupBy("lhs", "rhs", "seed").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    empty = F.array().cast("array<string>")
    return both.select("lhs", "rhs", "seed", F.coalesce("l", empty).alias("lhs_ends"), F.coalesce("r", empty).alias("rhs_ends"), F.coalesce(F.col("l") == F.col("r"), F.lit(False)).alias("same"))


def coverage(evaluated: DataFrame) -> DataFrame:
    """(lhs, rhs, support, total, coverage)."""
    n = evaluated.groupBy("lhs", "rhs").agg(F.count(F.when(F.col("same"), 1)).alias("support"), F.count(F.lit(1)).alias("total"))
    return n.withColumn("coverage", F.col("support") / F.col("total"))


def counterexamples(evaluated: DataFrame, most: int = 5) -> DataFrame:
    """(lhs, rhs, seed, lhs_only, rhs_only): the first `most` seeds of each pair on which the sides differ."""
    w = Window.partitionBy("lhs", "rhs").orderBy("seed")
    bad = evaluated.where("NOT same").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most)
    return bad.select("lhs", "rhs", "seed", F.array_except("lhs_ends", "rhs_ends").alias("lhs_only"), F.array_except("rhs_ends", "lhs_ends").alias("rhs_only"))


def evaluate_one(g: Graph, seeds: DataFrame, lhs: Sequence[str], rhs: Sequence[str]) -> DataFrame:
    """The result of `coverage` for one pair of paths from the given seeds (column seed)."""
    kinds = sorted({*lhs, *rhs})
    reached = path_reach(g, seeds, kinds, max(len(lhs), len(rhs))).where(F.array_join("path", ">").isin(">".join(lhs), ">".join(rhs)))
    pair = g.spark.createDataFrame([(list(lhs), list(rhs))], "lhs array<string>, rhs array<string>")
    return coverage(evaluate(pair, reach_sets(reached)))


def dominant_kinds(evaluated: DataFrame, seeds: DataFrame) -> DataFrame:
    """(lhs, rhs, kind, n): the kind that most seeds of each pair have; of several the smallest."""
    n = evaluated.join(seeds.select("seed", "seed_kind"), "seed").groupBy("lhs", "rhs", "seed_kind").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("lhs", "rhs").orderBy(F.desc("n"), "seed_kind")
    return n.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("lhs", "rhs", F.col("seed_kind").alias("kind"), "n")


def rendered(mined: DataFrame) -> DataFrame:
    """(line): `a → b = c (12/15, 80.0%)` for each mined equation."""
    arrow = lambda c: F.array_join(c, " → ")
    return mined.select(F.concat(arrow("lhs"), F.lit(" = "), arrow("rhs"), F.format_string(" (%d/%d, %.1f%%)", "support", "total", F.col("coverage") * 100)).alias("line"))


def subsumed(lhs: Sequence[str], rhs: Sequence[str], kept: Sequence[tuple]) -> bool:
    """Whether a kept equation extended by a common suffix or prefix gives this one."""
    lhs, rhs = tuple(lhs), tuple(rhs)
    for a, b in kept:
        n, m = len(a), len(b)
        if lhs[:n] == a and rhs[:m] == b and lhs[n:] == rhs[m:] and lhs[n:]:
            return True
        if lhs[len(lhs) - n :] == a and rhs[len(rhs) - m :] == b and lhs[: len(lhs) - n] == rhs[: len(rhs) - m] and lhs[: len(lhs) - n]:
            return True
    return False


#: Ends of a set that are compared at first, and by how many times more where that leaves pairs open.
FIRST_COMPARED, TIMES_MORE = 32, 16
#: Members that sets of neighbours dealt into one part have at least, if there are as many, and about at most.
MEMBERS = 20_000, 2_000_000
#: Share of the elements with arrows from which on, if they are seeds, the sets of all are united: it is not asked
#: which of the others the seeds reach.
SEEDED = 0.75
#: Ends that a task of `_united` holds at once, besides those of one set of neighbours.
AT_ONCE = 4_000_000

_LEVEL = "kind int, rep binary, path array<int>, digest array<long>, cut array<boolean>, was array<boolean>, cuts array<int>, at array<int>, ends array<long>, to_at array<int>, to array<int>"


@dataclass(frozen=True)
class _Hoods:
    """Ids are numbers here (64-bit hashes), kinds their places in `kinds` and `named`. steps (kind, id, rep): the set
    of an element's neighbours; near (kind, rep, near): these sets, each once; elem (id, to): elements, kind in `named`."""

    steps: DataFrame
    near: DataFrame
    elem: DataFrame
    kinds: list[str]
    named: list[str]
    scratch: Scratch


def _neighbourhoods(g: Graph, kinds: Sequence[str]) -> _Hoods:
    scratch, kinds = Scratch(g.spark, "mine"), sorted(kinds)
    elem = scratch.write(g.elem.select(F.xxhash64("id").alias("id"), "kind"), "elem")
    place = lambda c, names: (F.array_position(F.lit(names) if names else F.array().cast("array<string>"), F.col(c)) - 1).cast("int")
    named = sorted(r["kind"] for r in elem.where("kind IS NOT NULL").select("kind").distinct().collect())
    elem = elem.select("id", place("kind", named).alias("to"))
    a = g.arr.where(F.col("kind").isin(kinds) & F.col("src_id").isNotNull() & F.col("dst_id").isNotNull())
    a = a.select(place("kind", kinds).alias("kind"), F.xxhash64("src_id").alias("id"), F.xxhash64("dst_id").alias("dst"))
    a = a.groupBy("kind", "id").agg(F.array_sort(F.collect_set("dst")).alias("near"))
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), "near")), 16, "0")
    a = scratch.write(a.withColumn("rep", F.unhex(F.concat(half(1), half(2)))), "neighbours")
    scratch.free()  # what made the arrows; the sets are shuffled once more
    near = scratch.write(a.groupBy("kind", "rep").agg(F.first("near").alias("near")), "near")
    steps = scratch.write(a.select("kind", "id", "rep"), "steps")
    scratch.drop("neighbours")
    scratch.free()
    return _Hoods(steps, near, elem, kinds, named, scratch)


def _laid(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges laid end to end: of each place the range and the number."""
    own = np.repeat(np.arange(len(count)), count)
    return own, np.arange(len(own)) + np.repeat(first - (np.cumsum(count) - count), count)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of lists: where each begins, its length, all values."""
    count = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    return np.cumsum(count) - count, count, pc.list_flatten(column).to_numpy()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _united(longer: np.ndarray, wanted: np.ndarray, most: int, before: int, last: bool):
    """Of one part of the sets of neighbours and what paths reach from their members: what the longer paths reach.
    longer[kind, path]: the path with the kind before it, or -1. Of the last, longest paths the ends are not kept."""

    def united(left: pa.Table, right: pa.Table) -> pa.Table:
        kind, many = left["kind"].to_numpy(), longer.shape[1]
        first, count, ids = _lists(left["near"])
        row = np.repeat(np.arange(len(kind)), count)
        order = np.argsort(right["id"].to_numpy(), kind="stable")
        known = right["id"].to_numpy()[order]
        low = np.searchsorted(known, ids, "left")
        own, at = _laid(low, np.searchsorted(known, ids, "right") - low)
        row, part = row[own], order[at]  # row does not fall
        if "at" in right.column_names:
            parts = {c: (*_lists(right[c]), None if v is None else _lists(right[v])[2]) for c, v in (("at", "ends"), ("to_at", "to"), ("cuts", None))}
        else:  # elements: the empty path reaches each itself
            one, to = np.ones(len(right), np.int64), right["to"].is_valid().to_numpy()
            at, none = np.zeros(len(right), np.int64), np.zeros(0, np.int64)
            parts = {"at": (np.arange(len(right)), one, at, right["id"].to_numpy()), "to_at": (np.cumsum(to) - to, to.astype(np.int64), at, right["to"].drop_null().to_numpy().astype(np.int32)), "cuts": (at, at, none, None)}
        held = np.cumsum(np.bincount(row, weights=parts["at"][1][part], minlength=len(kind))) // AT_ONCE
        out = {c: [] for c in ("path", "digest", "cut", "was", "cuts", "at", "ends", "to_at", "to")}
        owner = {c: [] for c in out}

        def put(rows: np.ndarray, **columns: np.ndarray) -> None:
            for c, v in columns.items():
                out[c].append(v)
                owner[c].append(rows)

        for b in np.unique(held):
            lo, hi = np.searchsorted(row, [np.searchsorted(held, b, "left"), np.searchsorted(held, b, "right")])
            r, p = row[lo:hi], part[lo:hi]

            def keyed(c: str):
                begin, n, paths, values = parts[c]
                o, i = _laid(begin[p], n[p])
                path = longer[kind[r[o]], paths[i]]
                kept = path >= 0
                return (r[o] * many + path)[kept], None if values is None else values[i][kept]

            key, ends = keyed("at")
            if not len(key):
                continue
            by = np.lexsort((ends, key))
            key, ends = key[by], ends[by]
            new = np.append(True, (key[1:] != key[:-1]) | (ends[1:] != ends[:-1]))
            key, ends = key[new], ends[new]
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(begin, len(key)))
            each = key[begin]
            cut = (size > most) | np.isin(each, keyed("cuts")[0])
            kept = np.arange(len(key)) - np.repeat(begin, size) < most
            key, ends = key[kept], ends[kept]
            digest = np.add.reduceat(_mixed(ends), np.flatnonzero(np.append(True, key[1:] != key[:-1]))).view(np.int64)
            told = wanted[each % many]
            put(each[told] // many, path=(each % many)[told], digest=digest[told], cut=cut[told], was=(size > before)[told])
            put(each[cut] // many, cuts=(each % many)[cut])
            if not last:
                put(key // many, at=key % many, ends=ends)
            key, to = keyed("to_at")
            both = np.unique(key * (int(to.max(initial=0)) + 1) + to)
            key, to = both // (int(to.max(initial=0)) + 1), both % (int(to.max(initial=0)) + 1)
            put(key // many, to_at=key % many, to=to)
        schema = {"path": pa.int32(), "digest": pa.int64(), "cut": pa.bool_(), "was": pa.bool_(), "cuts": pa.int32(), "at": pa.int32(), "ends": pa.int64(), "to_at": pa.int32(), "to": pa.int32()}
        columns, some = {}, np.zeros(len(kind), bool)
        for c, t in schema.items():
            rows = np.concatenate(owner[c]) if owner[c] else np.zeros(0, np.int64)
            offsets = np.append(0, np.cumsum(np.bincount(rows, minlength=len(kind))))
            columns[c] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(out[c]) if out[c] else [], t))
            some |= np.diff(offsets) > 0
        return pa.table({"kind": left["kind"].combine_chunks(), "rep": left["rep"].combine_chunks(), **columns}).filter(pa.array(some))

    return united


def _least_ends(hoods: _Hoods, seeds: DataFrame, paths: Sequence[tuple[str, ...]], most: int, before: int) -> tuple[DataFrame, dict[tuple[str, ...], int]]:
    """Of each set of neighbours what the paths that reach anything over it reach (the columns of _LEVEL), and the
    numbers of paths. digest is of the `most` least hashes of ends, cut says that there are more, was that there are
    more than `before`; (to_at, to) are the paths and the kinds of all ends.

    Composed from the right: ends(k + path) of an element is the union of ends(path) over its k-neighbours, and the
    least hashes of a union are the least of its parts' least. Sets of neighbours are dealt into parts; what an
    element's paths reach is sent once to each part that has the element, and united there.
    """
    scratch = hoods.scratch
    suffixes = sorted({p[i:] for p in paths for i in range(len(p))}, key=lambda p: (len(p), p))
    number = {(): 0} | {p: n for n, p in enumerate(suffixes, 1)}
    longest, place, asked = len(suffixes[-1]), {k: n for n, k in enumerate(hoods.kinds)}, set(paths)
    longer, wanted = np.full((len(place), len(number)), -1), np.array([p in asked for p in number])
    for p in suffixes:
        longer[place[p[0]], number[p[1:]]] = number[p]
    members = hoods.near.agg(F.sum(F.size("near"))).first()[0] or 0
    groups = max(min(shuffle_partitions(seeds.sparkSession), 1 + members // MEMBERS[0]), members // MEMBERS[1])
    part = F.pmod(F.xxhash64("rep"), F.lit(groups)).cast("int").alias("part")
    seeded = hoods.steps.join(seeds.select(F.col("seed").alias("id"), F.lit(1).alias("seeded")).distinct(), "id", "left").agg(F.count("seeded").alias("n"), F.count(F.lit(1)).alias("total")).first()
    if seeded.n >= SEEDED * seeded.total:
        steps, near = hoods.steps.withColumn("away", F.lit(0)), hoods.near.select("*", F.lit(0).alias("away"), part)
    else:
        # how far from the seeds an element is met at least: paths of n kinds matter up to longest - n away
        away = seeds.select(F.col("seed").alias("id")).distinct().withColumn("away", F.lit(0))
        for n in range(1, longest):
            met = hoods.steps.join(away.where(F.col("away") == n - 1), "id", "left_semi").select("kind", "rep").distinct().join(hoods.near, ["kind", "rep"])
            away = away.unionByName(met.select(F.explode("near").alias("id")).distinct().withColumn("away", F.lit(n))).groupBy("id").agg(F.min("away").alias("away"))
            away = scratch.replace(away, "away")
        steps = scratch.replace(hoods.steps.join(away, "id"), "near_steps")
        near = hoods.near.join(steps.groupBy("kind", "rep").agg(F.min("away").alias("away")), ["kind", "rep"])
        near = scratch.replace(near.select("*", part), "parts")
        scratch.free()
    level = hoods.elem
    if longest > 1:  # of each part the members that have neighbours, found once for all levels
        members = near.select(F.col("part").alias("for"), F.col("away").alias("by"), F.explode("near").alias("id")).groupBy("for", "id").agg(F.min("by").alias("by"))
        members = scratch.replace(members.join(steps, "id"), "members")
        scratch.free()
    out = None
    for n in range(1, longest + 1):
        rows = near.where(F.col("away") <= longest - n).select("part", "kind", "rep", "near")
        if n == 1:
            had = rows.select(F.col("part").alias("for"), F.explode("near").alias("id")).distinct().join(level, "id")
        else:
            had = members.where((F.col("by") <= longest - n) & (F.col("away") <= longest - n + 1)).select("for", "id", "kind", "rep").join(level, ["kind", "rep"])
        had = had.select("for", "id", *(() if n == 1 else ("cuts", "at", "ends", "to_at")), "to")
        level = rows.groupBy("part").cogroup(had.groupBy("for")).applyInArrow(_united(longer, wanted, most, before, n == longest), _LEVEL)
        level = scratch.replace(level, f"level{n}")
        scratch.free()
        out = level if out is None else out.unionByName(level)
    return out, number


def _profiles(seeds: DataFrame, steps: DataFrame, told: DataFrame) -> DataFrame:
    """(seed, profile): of each seed the paths that reach anything, which of them reach the same (`like`), and what is
    not told of that."""
    sets = told.where(F.size("path") > 0).select("kind", "rep", F.arrays_zip("path", "digest", "cut", "was").alias("sets"))
    of = steps.withColumnRenamed("id", "seed").join(seeds.select("seed"), "seed", "left_semi").join(sets, ["kind", "rep"])
    of = of.groupBy("seed").agg(F.array_sort(F.flatten(F.collect_list("sets"))).alias("sets"))
    of = of.withColumn("kept", F.transform("sets", lambda s: F.struct(s["digest"], s["cut"])))
    return of.select("seed", F.transform("sets", lambda s: F.struct(s["path"].alias("path"), F.array_position("kept", F.struct(s["digest"], s["cut"])).cast("int").alias("like"), s["cut"].alias("cut"), s["was"].alias("was"))).alias("profile"))


def _met(profiles: DataFrame) -> DataFrame:
    """(l, r, n, same, open): of each two paths l <= r that reach anything from one seed, from how many seeds both do,
    and of those not told before from how many their sets are equal, and from how many that cannot be told yet.

    What counts of a seed is which of its sets are equal. Seeds are counted by that before paths are paired, so that
    pairs are made for each such profile and not for each seed.
    """
    counted = profiles.groupBy("profile").agg(F.count(F.lit(1)).alias("n"))
    two = counted.select("n", "profile", F.explode("profile").alias("a")).select("n", "a", F.explode("profile").alias("b")).where("a.path <= b.path")
    like = (F.col("a.like") == F.col("b.like")) & F.col("a.was")
    return two.groupBy(F.col("a.path").alias("l"), F.col("b.path").alias("r")).agg(
        F.sum("n").alias("n"), F.sum(F.when(like & ~F.col("a.cut"), F.col("n")).otherwise(0)).alias("same"), F.sum(F.when(like & F.col("a.cut"), F.col("n")).otherwise(0)).alias("open")
    )


def agreement(g: Graph, seeds: DataFrame, pairs: Sequence[tuple[Sequence[str], Sequence[str]]], first: int = FIRST_COMPARED) -> DataFrame:
    """The result of `coverage` of `evaluate` for pairs of paths, without making the sets where less tells.

    Sets are compared by their `first` least hashes (64 bits). Where those differ, or no more ends are left out, that
    settles it; what stays open is compared again by more, from the seeds that leave it open, until nothing is.
    """
    pairs, seeds = [(tuple(l), tuple(r)) for l, r in pairs], seeds.select(F.xxhash64("seed").alias("seed"))
    return _agreement(seeds, pairs, _neighbourhoods(g, {k for pair in pairs for p in pair for k in p}), first)


def _agreement(seeds: DataFrame, pairs: Sequence[tuple[tuple, tuple]], hoods: _Hoods, most: int, told: tuple[DataFrame, dict] | None = None) -> DataFrame:
    """told, if given: the result of `_least_ends` for the first comparison."""
    spark, scratch, left, before = seeds.sparkSession, hoods.scratch, sorted(set(pairs)), 0
    out = spark.createDataFrame([], "lhs array<string>, rhs array<string>, support long, total long")
    while left:
        asked = sorted({p for pair in left for p in pair})
        sets, number = told or _least_ends(hoods, seeds, asked, most, before)
        profiles, told = _profiles(seeds, hoods.steps, sets), None
        met = scratch.write(_met(profiles), "met")
        rows = [(list(l), list(r), number[l], number[r], min(number[l], number[r]), max(number[l], number[r])) for l, r in left]
        two = spark.createDataFrame(rows, "lhs array<string>, rhs array<string>, i int, j int, l int, r int")
        alone = met.where("l = r")
        two = two.join(met, ["l", "r"], "left").join(alone.select(F.col("l").alias("i"), F.col("n").alias("i_n")), "i", "left").join(alone.select(F.col("l").alias("j"), F.col("n").alias("j_n")), "j", "left")
        n = lambda c: F.coalesce(c, F.lit(0))
        total = n("i_n") + n("j_n") - n("n") if not before else F.lit(0).cast("long")  # later only some seeds are met
        two = scratch.write(two.select("lhs", "rhs", n("same").alias("support"), total.alias("total"), n("open").alias("open")), "pairs")
        out = out.unionByName(two.drop("open"))
        left = sorted((tuple(r.lhs), tuple(r.rhs)) for r in two.where("open > 0").collect())
        if left:
            among = F.lit(sorted({number[p] for pair in left for p in pair}))
            still = F.filter("profile", lambda x: x["cut"] & x["was"] & F.array_contains(among, x["path"]))
            kept = profiles.select("seed", still.alias("p")).where(F.size(F.array_distinct(F.transform("p", lambda x: x["like"]))) < F.size("p"))
            seeds = scratch.write(kept.select("seed"), "open")
        before, most = most, min(most * TIMES_MORE, 2**31 - 1)
    out = out.groupBy("lhs", "rhs").agg(F.sum("support").alias("support"), F.sum("total").alias("total")).where("total > 0")
    return out.withColumn("coverage", F.col("support") / F.col("total"))


def mine_equations(g: Graph, kinds: Sequence[str] | None = None, seed_kinds: Sequence[str] = SEED_KINDS, depth: int = 3, min_coverage: float = 1.0, sample: int | None = 100) -> DataFrame:
    """(lhs, rhs, support, total, coverage): all equations with enough coverage; rank and prune with `prune`.

    The kinds of paths and the candidate pairs (at most the pairs of enumerated paths, whatever the graph's size) pass
    through the driver.
    """
    hoods, found, told = _neighbourhoods(g, UNIVERSE if kinds is None else kinds), [], None
    if kinds is None:
        used = {hoods.kinds[r["kind"]] for r in hoods.near.select("kind").distinct().collect()}
        kinds = [k for k in UNIVERSE if k in used]
    paths = enumerate_paths(kinds, depth, 10**9)
    if sample is None:
        of = F.lit(hoods.named) if hoods.named else F.array().cast("array<string>")
        seeds = hoods.elem.select(F.col("id").alias("seed"), F.get(of, "to").alias("seed_kind")).where(F.col("seed_kind").isin(list(seed_kinds)))
    else:
        seeds = sample_seeds(g, seed_kinds, sample).select(F.xxhash64("seed").alias("seed"), "seed_kind")
    seeds = hoods.scratch.write(seeds, "seeds")
    if paths:
        sets, number = told = _least_ends(hoods, seeds, paths, FIRST_COMPARED, 0)
        path = {n: p for p, n in number.items()}
        at = hoods.steps.join(seeds.withColumnRenamed("seed", "id"), "id").select("kind", "rep", "seed_kind").distinct()
        notes = at.join(sets, ["kind", "rep"]).select("seed_kind", F.explode(F.arrays_zip("to_at", "to")).alias("x")).groupBy(F.col("x.to_at").alias("path")).agg(F.collect_set("seed_kind").alias("d"), F.collect_set("x.to").alias("to")).collect()
        notes = g.spark.createDataFrame([(list(path[r.path]), r.d[0] if len(r.d) == 1 else None, sorted(hoods.named[k] for k in r.to)) for r in notes], "path array<string>, domain_kind string, codomain_kinds array<string>")
        found = [(tuple(r.lhs), tuple(r.rhs)) for r in candidate_pairs(notes).select("lhs", "rhs").distinct().collect()]
    return _agreement(seeds, found, hoods, FIRST_COMPARED, told).where(F.col("coverage") >= min_coverage)


def prune(mined: DataFrame, most: int = 50) -> list[dict]:
    """The best `most` by coverage, total and path text, without those that a better one of equal coverage implies.

    Rows come to the driver one partition of the sorted result at a time, until enough are kept or none are left.
    """
    order = [F.desc("coverage"), F.desc("total"), F.array_join("lhs", ">"), F.array_join("rhs", ">")]
    kept: list[dict] = []
    for r in mined.orderBy(*order).toLocalIterator():
        same = [(tuple(k["lhs"]), tuple(k["rhs"])) for k in kept if k["coverage"] == r["coverage"]]
        if not subsumed(r["lhs"], r["rhs"], same):
            kept.append(r.asDict())
        if len(kept) >= most:
            break
    return kept
