import datetime as dt

from arrowlens.operators.snapshots import snapshot_changes

SNAP = "commit_sha string, delivered_at timestamp, id string, kind string, name string, module string, span string, attrs string, sha string"
C = [c * 40 for c in "abc"]


def t(n):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=n)


def changes(spark, rows, log=None):
    full = [(c, t(d), i, k, n, m, s, a, "extra") for c, d, i, k, n, m, s, a in rows]
    l = spark.createDataFrame(log if log is not None else [(c, t(i)) for i, c in reversed(list(enumerate(C)))], "commit_sha string, committed_at timestamp")
    out = snapshot_changes(spark.createDataFrame(full, SNAP), l).collect()
    return sorted((r.commit_sha[0], r.elem_id, r.change_kind, r.changed_fields) for r in out)


def test_added_removed_changed_and_notation(spark):
    a, b, c = C
    got = changes(
        spark,
        [
            (a, 0, "same", "k", "n", None, "p.ts:1:2-3:4", '{"a":1,"b":[1,2]}'),
            (b[:9], 1, "same", "k", "n", None, "1:2-3:4", '{ "b": [1, 2], "a": 1 }'),
            (c.upper(), 2, "same", "k", "n", None, "p.ts:01:2-3:4", '{"b":[1,2],"a":1.0}'),
            (a, 0, "gone", "k", "n", None, None, "{}"),
            (c, 2, "late", "k", "n", None, None, "{}"),
            (a, 0, "moves", "k", "n", "m", "1:1-1:2", "{}"),
            (b, 1, "moves", "k", "n", "m", None, '{"x":null}'),
            (c, 2, "moves", "k", "N", None, None, '{"x":null}'),
        ],
    )
    assert got == [("b", "gone", "removed", None), ("b", "moves", "changed", ["attrs", "span"]), ("c", "late", "added", None), ("c", "moves", "changed", ["module", "name"])]


def test_the_latest_delivery_of_a_commit_counts(spark):
    a, b, _ = C
    rows = [(a, 0, "x", "k", "old", None, None, "{}"), (a, 50, "x", "k", "new", None, None, "{}"), (b, 1, "x", "k", "new", None, None, "{}"), (b, 1, "x", "k", "new", None, None, "{}")]
    assert changes(spark, rows, [(a, t(0)), (b, t(1))]) == []


def test_nulls_unknown_and_ambiguous_commits(spark):
    a, b, _ = C
    rows = [(a, 0, None, "k", "n", None, None, None), ("ffff", 0, "x", "k", "n", None, None, None), (None, 0, "x", "k", "n", None, None, None), (a, None or 0, "n", None, None, None, None, None), (b, 1, "n", None, None, None, "", None)]
    assert changes(spark, rows, [(a, t(0)), (b, t(1))]) == [("b", "n", "changed", ["span"])]
    near = ["aaaa1" + "0" * 35, "aaaa2" + "0" * 35]
    assert changes(spark, [("aaaa", 0, "x", "k", "n", None, None, "{}")], [(near[0], t(0)), (near[1], t(1))]) == []
    assert changes(spark, [("aaaa2", 0, "x", "k", "n", None, None, "{}")], [(near[0], t(0)), (near[1], t(1))]) == [("a", "x", "added", None)]


def test_short_abbreviations_that_are_unique_count(spark):
    log = [("ab" + "0" * 38, t(0)), ("ac" + "0" * 38, t(1))]
    assert changes(spark, [("AB", 0, "x", "k", "n", None, None, "{}"), ("ac0", 1, "y", "k", "n", None, None, "{}"), ("a", 1, "z", "k", "n", None, None, "{}")], log) == [("a", "x", "removed", None), ("a", "y", "added", None)]


def test_empty(spark):
    assert changes(spark, []) == []
    assert changes(spark, [], []) == []
    assert changes(spark, [(C[0], 0, "x", "k", "n", None, None, "{}")], [(C[0], t(0)), (C[1], t(1))]) == [("b", "x", "removed", None)]
