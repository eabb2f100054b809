import random
from collections import defaultdict

import pytest

from arrowlens.llm import copies

E = "id string, kind string, name string, module string, span string, attrs string, h string, maybe string"


def frame(spark, rows):
    return spark.createDataFrame([(i, k, n, m, None, a, "clash", "clash") for i, k, n, m, a in rows], E)


def pairs(spark, rows, **kw):
    return sorted(map(tuple, copies.copy_pairs(frame(spark, rows), **kw).collect()))


def test_formatting_makes_no_difference_but_content_does(spark):
    rows = [
        ("b", "function", "fetchData", "m", '{"a":1,"b":[1,2]}'),
        ("a", "<FUNCTION>", "fetch-data", "m", '{ "b": [1, 2.0],\n "a": 1 }'),
        ("c", "func tion", "FETCH_DATA", "m", '{"b":[1,2],"a":1}'),
        ("d", "function", "fetchData", None, '{"a":1,"b":[1,2]}'),
        ("e", "function", "fetchData", "M", '{"a":1,"b":[1,2]}'),
        ("f", "function", "fetchData", "m", '{"a":1,"b":[2,1]}'),
        ("g", "function", "fetchData2", "m", '{"a":1,"b":[1,2]}'),
        ("h", "function", "fetchData", None, '{"b":[1,2],"a":1}'),
    ]
    assert pairs(spark, rows) == [("a", "b"), ("a", "c"), ("d", "h")]


def test_nulls_repeats_unreadable_and_fields_that_run_together(spark):
    rows = [("a", None, None, None, None), ("b", None, None, None, None), ("c", None, None, "", None), (None, None, None, None, None), ("d", "x", "yz", "m", "{"), ("e", "xy", "z", "m", "{"), ("f", "x", "Y.Z", "m", " { "), ("a", None, None, None, None)]
    assert pairs(spark, rows) == [("a", "b"), ("d", "f")]
    out = {(r.id, r.copies, r.ids) for r in copies.collapse(frame(spark, rows)).collect()}
    assert out == {("a", 4, 2), ("c", 1, 1), ("d", 2, 2), ("e", 1, 1)}


def test_random_groups_equal_brute_force_at_any_filter_size(spark):
    rng = random.Random(5)
    rows = [(f"id{i:05d}", "k", f"n{rng.randrange(400)}", None, "{}") for i in range(900)] + [(f"hot{i:05d}", "K", "Hot", None, "{}") for i in range(2500)]
    groups = defaultdict(list)
    for i, k, n, m, a in rows:
        groups[k.lower(), n.lower()].append(i)
    want = sorted((min(g), x) for g in groups.values() for x in g if x != min(g))
    assert pairs(spark, rows) == want == pairs(spark, rows, max_filter_bytes=1)
    c = copies.collapse(frame(spark, rows)).collect()
    assert len(c) == len(groups) and sum(r.copies for r in c) == len(rows)


@pytest.mark.parametrize("most", [copies.MAX_FILTER_BYTES, 1])
@pytest.mark.parametrize("range_bits", [copies.RANGE_BITS, 1 << 14])
def test_little_more_than_the_repeats_is_shuffled(spark, monkeypatch, most, range_bits):
    """At any number of hash ranges, with the filter broadcast or far too large for that."""
    from pyspark.sql import functions as F

    base = spark.range(20_000).select(F.xxhash64("id").alias("h"), F.col("id").cast("string").alias("id"))
    hot = spark.range(9_000).select(F.xxhash64(F.lit("hot")).alias("h"), F.lit("x").alias("id"))
    rows = base.unionByName(base.limit(500)).unionByName(hot).repartition(7).cache()
    n = rows.groupBy("h").count()
    monkeypatch.setattr(copies, "RANGE_BITS", range_bits)
    if range_bits == 1 << 14:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(copies)  # workers see the small ranges too
    try:
        marked = copies.mark_repeats(rows, most)
        assert marked.count() == rows.count()
        assert marked.join(n.where("count > 1"), "h").where("NOT maybe").isEmpty()
        assert marked.join(n.where("count = 1"), "h").where("maybe").count() < (1200 if most > 1 else 2000)
    finally:
        if range_bits == 1 << 14:
            cloudpickle.unregister_pickle_by_value(copies)
    assert copies.filter_ranges(20 * 10**9) * range_bits >= 16 * 20 * 10**9


def test_packed_positions_come_back():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 10, copies.RANGE_BITS // 8):
        at = np.unique(rng.integers(0, copies.RANGE_BITS, n))
        data = copies._packed(at)
        assert (copies._unpacked(data) == at).all() and len(data) <= 1 + copies.RANGE_BITS // 8


def test_empty_and_long(spark):
    assert pairs(spark, []) == [] and copies.collapse(frame(spark, [])).collect() == []
    long = '{"t":"' + "x" * 300_000 + '"}'
    assert pairs(spark, [("a", "k", "n", None, long), ("b", "k", "n", None, long.replace(":", " : "))]) == [("a", "b")]
