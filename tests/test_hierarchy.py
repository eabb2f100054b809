import random

from arrowlens.operators.hierarchy import Hierarchy, hierarchy

ARR = "id string, kind string, src_id string, dst_id string, parent string, child string"


def links(spark, pairs):
    return spark.createDataFrame(pairs, "child string, parent string")


def brute(parent):
    out = {}
    for n in {*parent, *parent.values()}:
        path, x = [n], n
        while x in parent and parent[x] not in path:
            x = parent[x]
            path.append(x)
        if x in parent:
            ring, y = [parent[x]], parent[parent[x]]
            while y != ring[0]:
                ring.append(y)
                y = parent[y]
            out[n] = (min(ring), -1, None)
        else:
            out[n] = (x, len(path) - 1, " > ".join(reversed(path)))
    return out


def check(spark, parent, **kw):
    want = brute(parent)
    h = Hierarchy(links(spark, list(parent.items())), **kw)
    got = {r.elem_id: (r.root_id, r.depth) for r in h.positions().collect()}
    assert got == {k: v[:2] for k, v in want.items()}
    rows = h.paths().collect()
    assert {r.elem_id: r.path for r in rows} == {k: v[2] for k, v in want.items() if v[2]}
    below = {n: {m for m, v in want.items() if v[2] and v[2].startswith(want[n][2] + " > ")} for n in want if want[n][2]}
    at = {r.elem_id: r for r in rows}
    for n, d in below.items():
        inside = {m for m, r in at.items() if r.root_id == at[n].root_id and at[n].pre < r.pre <= at[n].pre + at[n].descendants}
        assert inside == d and at[n].descendants == len(d)
    assert sorted(map(tuple, h.descendants().collect())) == sorted((n, m) for n, d in below.items() for m in d)
    some = sorted(below)[::7]
    asked = h.descendants(spark.createDataFrame([(i,) for i in [*some, *some, "nobody", None]], "id string"))
    assert sorted(map(tuple, asked.collect())) == sorted((n, m) for n in some for m in below[n])


def test_random_forests_with_cycles(spark):
    rng = random.Random(3)
    names = [f"n{i:03d}" for i in range(120)]
    parent = {names[i]: names[rng.randrange(i)] for i in range(1, 120) if rng.random() < 0.9}
    parent |= {"c1": "c2", "c2": "c3", "c3": "c1", "t1": "c2", "t2": "t1", "self": "self", "u": "self"}
    check(spark, parent)


def test_a_long_chain_and_a_wide_star(spark):
    check(spark, {f"x{i:03d}": f"x{i - 1:03d}" for i in range(1, 70)} | {f"leaf{i}": "hub" for i in range(60)})


def test_salted_questions_and_small_pieces_change_nothing(spark, monkeypatch):
    from arrowlens.operators import hierarchy as module

    monkeypatch.setattr(module, "PIECE", 4)
    monkeypatch.setattr(module, "BLOCK", 3)
    ring = {"k1": "k2", "k2": "k1"} | {f"k{i}": "k1" for i in range(3, 30)}
    check(spark, {f"x{i:03d}": f"x{i - 1:03d}" for i in range(1, 30)} | {f"leaf{i}": "x028" for i in range(40)} | {f"m{i}": f"leaf{i % 3}" for i in range(30)} | ring, hot=3)


def test_a_chain_of_20000_and_a_star_of_a_million(spark):
    from pyspark.sql import functions as F

    chain = spark.range(1, 20_000).select(F.format_string("n%05d", "id").alias("child"), F.format_string("n%05d", F.col("id") - 1).alias("parent"))
    star = spark.range(1_000_000).select(F.format_string("leaf%d", "id").alias("child"), F.lit("hub").alias("parent"))
    h = Hierarchy(chain.unionByName(star))
    got = h.paths().groupBy("root_id").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("deep"), F.sum(F.length("path")).alias("text"), F.max("descendants").alias("below")).collect()
    assert {tuple(r) for r in got} == {
        ("n00000", 20_000, 19_999, sum(6 * (d + 1) + 3 * d for d in range(20_000)), 19_999),
        ("hub", 1_000_001, 1, 3 + sum(len(f"hub > leaf{i}") for i in range(1_000_000)), 1_000_000),
    }
    assert h.descendants(spark.createDataFrame([("hub",), ("n19990",)], "id string")).count() == 1_000_009


def test_kinds_directions_repeats_and_nulls(spark):
    rows = [("1", " MemberOf ", "a", "b", "x", "y"), ("2", "contains", "b", "a", None, None), ("3", "CONTAINS", "c", "b", None, None), ("4", "calls", "q", "r", None, None), ("5", "memberOf", None, "b", None, None), ("6", None, "a", "b", None, None)]
    h = hierarchy(spark.createDataFrame(rows + rows, ARR))
    assert sorted((r.elem_id, r.root_id, r.depth) for r in h.positions().collect()) == [("a", "c", 2), ("b", "c", 1), ("c", "c", 0)]
    assert h.cycles().collect() == []


def test_two_parents_keep_the_smaller_and_empty(spark):
    h = Hierarchy(links(spark, [("a", "z"), ("a", "m")]))
    assert {(r.elem_id, r.root_id) for r in h.positions().collect()} == {("a", "m"), ("m", "m")}
    e = Hierarchy(spark.createDataFrame([], "child string, parent string"))
    assert e.positions().collect() == [] and e.paths().collect() == []


def test_split_families_keep_intervals_disjoint(spark, monkeypatch):
    from arrowlens.operators import hierarchy as module

    monkeypatch.setattr(module, "SIBLINGS", 7)
    check(spark, {f"leaf{i}": "hub" for i in range(60)} | {f"g{i}": f"leaf{i % 9}" for i in range(30)})
