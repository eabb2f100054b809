"""What mining costs: pairs of paths must not be made for each seed, nor whole sets where less tells them apart."""

import pytest

import __spark_entry__ as entry
from arrowlens.operators import mining
from arrowlens.operators.graph import from_rows


def shuffled(spark, f):
    """MB that f() shuffles."""

    def total():
        store, out = spark.sparkContext._jsc.sc().statusStore(), 0
        for k in range(stages_begun(spark)):
            try:
                out += store.lastStageAttempt(k).shuffleWriteBytes()
            except Exception:  # skipped stages
                pass
        return out

    before = total()
    f()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return (total() - before) / 1e6


def stages_begun(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().nextStageId()


@pytest.mark.parametrize("name, most", [("mine_coverage_code", 2), ("mine_equations", 1)])
def test_mining_shuffles_little(spark, sf, name, most):
    assert shuffled(spark, lambda: entry.queries()[name](spark, sf).collect()) < most


@pytest.mark.parametrize("first", [1, 2, 8])
def test_sets_that_differ_late_or_never(spark, first):
    """x and y reach the same 300 ends; z one more or less, wherever its hash lies; u and w are empty on one side."""
    ends = [f"t{i}" for i in range(300)]
    arr = [(k, s, e) for s in "pqz" for k in ("x", "y") for e in ends if (k, s) != ("y", "z") or e != "t77"]
    arr += [("x", "u", "t1"), ("y", "w", "t1"), ("x", "v", "gone"), *[("y", m, "m") for m in "pq"], *[("x", "m", e) for e in ends]]
    elem = [(i, "class") for i in "pqzuwvm"] + [(e, "type") for e in ends]
    g = from_rows(spark.createDataFrame([(i, k, i, "m") for i, k in elem], "id string, kind string, name string, module string"), spark.createDataFrame(arr, "kind string, src_id string, dst_id string"))
    seeds = mining.sample_seeds(g, ["class"], None)
    pairs = [(["x"], ["y"]), (["x"], ["y", "x"]), (["y"], ["y", "x"])]
    want = {(tuple(r.lhs), tuple(r.rhs), r.support, r.total) for r in mining.coverage(mining.evaluate(
        spark.createDataFrame(pairs, "lhs array<string>, rhs array<string>"), mining.reach_sets(mining.path_reach(g, seeds, ["x", "y"], 2)))).collect()}
    got = {(tuple(r.lhs), tuple(r.rhs), r.support, r.total) for r in mining.agreement(g, seeds, pairs, first).collect()}
    assert got == want and (("x",), ("y", "x"), 2, 5) in got
    assert mining.agreement(g, seeds, []).collect() == []


@pytest.mark.parametrize("name", ["analogues_topk", "analogues_all", "brief_elements"])
def test_pairs_of_analogues_are_shuffled_once(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1  # the exchange of pairs by target; no other meets both ends of a pair
    assert "hashpartitioning(target" in plan and not any("target" in x and ", id" in x for x in plan.split("Exchange hashpartitioning(")[1:] for x in [x.split(")")[0]])


def test_a_sample_unites_only_what_its_seeds_reach(spark, sf):
    """The end sets of what no seed reaches are not made: before, those of all elements were."""
    g = from_rows(
        spark.range(40).selectExpr("concat('a', id) AS id", "IF(id < 20, 'class', 'type') AS kind", "concat('n', lpad(id, 2, '0')) AS name", "'m' AS module"),
        spark.range(20).selectExpr("'x' AS kind", "concat('a', id) AS src_id", "concat('a', id + 20) AS dst_id"),
    )
    seeds = mining.sample_seeds(g, ["class"], 3).selectExpr("xxhash64(seed) AS seed")
    sets, number = mining._least_ends(mining._neighbourhoods(g, ["x"]), seeds, [("x",)], 8, 0)
    assert number == {(): 0, ("x",): 1} and sets.count() == 3


def test_whole_ends_are_not_sent_for_each_neighbour(spark):
    """300 seeds share 200 neighbours that reach 100 ends each: sets go once to each part, not along 60,000 arrows."""
    arr = spark.range(300).selectExpr("'x' AS kind", "concat('s', id) AS src_id", "explode(sequence(0, 199)) AS d", "id").where("pmod(xxhash64(id, d), 17) > 0").selectExpr("kind", "src_id", "concat('m', d) AS dst_id")
    arr = arr.unionByName(spark.range(200).selectExpr("'y' AS kind", "concat('m', id) AS src_id", "explode(sequence(0, 99)) AS d", "id").selectExpr("kind", "src_id", "concat('t', (id * 31 + d * d) % 5000) AS dst_id"))
    elem = arr.selectExpr("explode(array(src_id, dst_id)) AS id", "'class' AS kind").distinct().selectExpr("id", "kind", "id AS name", "'m' AS module")
    g = from_rows(elem, arr)
    assert shuffled(spark, lambda: mining.agreement(g, mining.sample_seeds(g, ["class"], None), [(["x"], ["x", "y"]), (["y"], ["x", "y"])], 128).collect()) < 6


@pytest.mark.parametrize("size, walked", [(None, False), (3, True)])
def test_sets_are_copied_only_for_few_seeds(spark, size, walked):
    """Where all elements with arrows are seeds, nothing is stored a second time to tell which sets they reach."""
    g = from_rows(
        spark.range(40).selectExpr("concat('a', id) AS id", "IF(id < 20, 'class', NULL) AS kind", "concat('n', id) AS name", "'m' AS module"),
        spark.range(20).selectExpr("explode(array('x', 'y')) AS kind", "concat('a', id) AS src_id", "concat('a', id + 20) AS dst_id"),
    )
    seeds = mining.sample_seeds(g, ["class"], size).selectExpr("xxhash64(seed) AS seed")
    hoods = mining._neighbourhoods(g, ["x", "y"])
    sets, _ = mining._least_ends(hoods, seeds, [("x",), ("x", "y")], 8, 0)
    assert ("parts" in hoods.scratch._version) == walked and sets.where("size(path) > 0").count() == (size or 20)
    if size is None:
        assert sets.selectExpr("sum(size(to))").first()[0] is None or sets.selectExpr("sum(size(to))").first()[0] == 0


def test_the_bare_code_graph_is_mined_without_a_copy(spark, sf, monkeypatch):
    from arrowlens.plans import code_queries

    monkeypatch.setattr(code_queries, "Scratch", None)
    assert entry.queries()["mine_coverage_code"](spark, sf).count() > 0


def test_equations_are_mined_without_a_stored_lens(spark, sf, tmp_path):
    from arrowlens.sources import lens

    (tmp_path / "tables").symlink_to(sf)
    entry.queries()["mine_equations"](spark, str(tmp_path / "tables"))
    assert not any(d == str(tmp_path / "tables") for _, d in lens._STORED)
