from collections import defaultdict

from arrowlens.operators.hotkeys import dominant_keys, element_summary, salted_counts
from arrowlens.runtime import Scratch

ARR = "id string, kind string, src_id string, dst_id string, attrs string, side string, salt int"


def arrows(spark, triples):
    return spark.createDataFrame([(f"{s}:{k}:{d}", k, s, d, "{}", "clash", 3) for s, k, d in triples], ARR)


def brute(triples):
    out = defaultdict(lambda: (set(), set(), set()))
    for s, k, d in triples:
        for key, other in ((("dst", d), s), (("src", s), d)):
            a, n, c = out[key]
            a.add(f"{s}:{k}:{d}"), n.add(other), c.add(k.strip().lower())
    return {(s, e): tuple(map(len, v)) for (s, e), v in out.items()}


def test_summary_equals_brute_force_with_a_hot_key_and_repeats(spark):
    rows = [(f"s{i}", ("calls", " CALLS ", "refs")[i % 3], "hub") for i in range(3000)] + [("s1", "refs", f"d{i % 50}") for i in range(400)] + [("s1", "refs", "d1")] * 2000
    got = {(r.side, r.elem_id): (r.arrows, r.neighbours, r.kinds) for r in element_summary(arrows(spark, rows)).collect()}
    assert got == brute(rows)


def test_salts_add_up(spark):
    rows = [(f"s{i % 700}", f"k{i % 4}", "hub") for i in range(5000)]
    a = arrows(spark, rows)
    one = sorted(map(tuple, salted_counts(a, Scratch(spark, "t"), tasks=1).collect()))
    many = sorted(map(tuple, salted_counts(a, Scratch(spark, "t"), tasks=50).collect()))
    assert one == many


def test_share_of_distinct_arrows(spark):
    rows = [(f"s{i}", "k", f"d{i}") for i in range(98)] + [("a", "k", "x"), ("b", "k", "x")] + [("s5", "k", "d5")] * 50
    got = {(r.side, r.elem_id) for r in dominant_keys(arrows(spark, rows), (2, 100)).collect()}
    assert got == {("dst", "x")}
    assert len(dominant_keys(arrows(spark, rows)).collect()) == 99 + 100


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, None, None, None, None, None, None), (None, None, None, "d", None, None, None), ("i", "k", "s", "d", None, None, None)], ARR)
    assert {(r.side, r.elem_id) for r in dominant_keys(df).collect()} <= {("dst", "d"), ("src", "s")}
    assert dominant_keys(df.limit(0)).collect() == []
    assert element_summary(df.limit(0)).collect() == []
