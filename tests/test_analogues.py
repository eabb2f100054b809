"""Analogues held against brute force, and what a name that many elements have costs."""

import itertools
import random

import pytest
from test_mining import stages_begun

from arrowlens.operators import context
from arrowlens.operators.graph import from_rows

ELEM, ARR = "id string, kind string, name string, module string", "kind string, src_id string, dst_id string"


@pytest.mark.parametrize("other_module, bonus", [(True, False), (False, True), (True, True)])
def test_equal_to_brute_force(spark, other_module, bonus):
    rng = random.Random(3)
    elem = {f"e{i}": (rng.choice(["function", "function", "class", None]), rng.choice(["a", "b", None]), rng.choice(["m", "n", "o", None])) for i in range(70)}
    calls = {i: {f"p{rng.randrange(40)}" for _ in range(rng.randrange(4))} for i in elem}
    near = {i for i in elem if bonus and rng.random() < 0.2}
    want = set()
    for t, (kind, name, module) in elem.items():
        scores = []
        for i, (k, n, m) in elem.items():
            if i != t and k == kind and k is not None and not (other_module and m == module):
                both = len(calls[t] & calls[i])
                s = min(1.0, max(both / len(calls[t] | calls[i]) if both else 0.0, 0.5 if n == name and n is not None else 0.0) + 0.3 * (i in near))
                if both or (n == name and n is not None):
                    scores.append((-s, i))
        want |= {(t, i, round(-s, 9), rank) for rank, (s, i) in enumerate(sorted(scores)[:3], 1)}
    g = from_rows(spark.createDataFrame([(i, *e) for i, e in elem.items()], ELEM), spark.createDataFrame([("callerOf", i, p) for i in calls for p in calls[i]], ARR))
    working_set = spark.createDataFrame([(i,) for i in near], "id string") if bonus else None
    got = context.analogues(g, g.elem.select("id"), 3, working_set=working_set, other_module=other_module).collect()
    assert {(r.target, r.id, round(r.similarity, 9), r["rank"]) for r in got} == want and len(got) == len(want)


def rows_shuffled(spark, f):
    before = stages_begun(spark)
    f()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, out = spark.sparkContext._jsc.sc().statusStore(), 0
    for k in range(before, stages_begun(spark)):
        try:
            out += store.lastStageAttempt(k).shuffleWriteRecords()
        except Exception:  # skipped stages
            pass
    return out


def test_a_name_of_many_makes_few_pairs(spark):
    """1500 functions of one name in 3 modules: of a name only those that come first are paired."""
    elem = [(f"e{i:04}", "function", "same", f"m{i % 3}") for i in range(1500)]
    g = from_rows(spark.createDataFrame(elem, ELEM), spark.createDataFrame([], ARR))
    got = []
    assert rows_shuffled(spark, lambda: got.extend(context.analogues(g, g.elem.select("id")).collect())) < 50_000
    by = {t: [r.id for r in sorted(rows, key=lambda r: r["rank"])] for t, rows in itertools.groupby(sorted(got, key=lambda r: r.target), lambda r: r.target)}
    assert by == {t: [i for i, _, _, m in elem if m != module][:3] for t, _, _, module in elem}


def test_a_callee_of_many_makes_few_pairs(spark):
    """600 functions of 10 names call 8 of 40 each, so that nearly all share a callee: only pairs that can reach the 0.5
    that a name makes are formed. Some are equal, some half equal, and one has a name of its own."""
    rng = random.Random(5)
    elem = {f"e{i:03}": (f"n{i % 10}" if i else "alone", f"m{i % 7}") for i in range(600)}
    calls = {i: frozenset(rng.sample(range(40), 8)) for i in elem}
    for i in range(100, 160, 2):
        a, b = f"e{i:03}", f"e{i + 1:03}"
        calls[b] = calls[a] if i % 4 else frozenset(rng.sample(sorted(calls[a]), 4))  # Jaccard 1, or 0.5 as a name's
    g = from_rows(
        spark.createDataFrame([(i, "function", *e) for i, e in elem.items()], ELEM),
        spark.createDataFrame([("callerOf", i, f"p{p}") for i in calls for p in calls[i]], ARR),
    )
    got = []
    assert rows_shuffled(spark, lambda: got.extend(context.analogues(g, g.elem.select("id")).collect())) < 60_000
    want = set()
    for t, (name, module) in elem.items():
        scores = [(-max(len(calls[t] & calls[i]) / len(calls[t] | calls[i]), 0.5 * (n == name)), i) for i, (n, m) in elem.items() if m != module]
        want |= {(t, i, round(-s, 9), rank) for rank, (s, i) in enumerate(sorted(x for x in scores if x[0])[:3], 1)}
    assert {(r.target, r.id, round(r.similarity, 9), r["rank"]) for r in got} == want and any(r.similarity == 1 for r in got)


def test_a_brief_joins_each_call_once(spark):
    """300 functions with 30 callees each: a brief shuffles each call a few times, not once or twice for every part."""
    elem = [(f"e{i}", "function", f"n{i % 5}", f"m{i % 3}") for i in range(300)] + [(f"p{i}", "interface", f"p{i}", "x") for i in range(900)]
    arr = [("callerOf", f"e{i}", f"p{(i * 7 + k * 31) % 900}") for i in range(300) for k in range(30)]
    g = from_rows(spark.createDataFrame(elem, ELEM), spark.createDataFrame(arr, ARR))
    got = []
    n = rows_shuffled(spark, lambda: got.extend(context.brief(g, g.elem.where("kind = 'function'").select("id")).collect()))
    want = {s: sorted({d for _, x, d in arr if x == s}) for _, s, _ in arr}
    assert {r.id: r.must_call for r in got} == want and {r.id: r.missing_imports for r in got} == want
    assert n < 60_000, n
