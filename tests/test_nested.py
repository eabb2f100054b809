import json

from arrowlens.operators import nested

S = "id string, status string, candidates_json string, equations_json string, updated_at long, pos string, entity string"
E = "id string, kind string, attrs string, root_id string"


def run(spark, sessions, elems=()):
    s = spark.createDataFrame([(i, "x", c, q, u, "clash", "clash") for i, c, q, u in sessions], S)
    e = spark.createDataFrame([(i, "k", a, "clash") for i, a in elems], E)
    return sorted(((r.root_id, r.entity, r.parent_id, r.item_id, r.pos) for r in nested.all_items(s, e).collect()), key=str)


CAND = {"id": "c1", "proposedArrows": [{"id": "a1"}, {"id": "a2"}], "bridgeArrow": {"id": "b1"}, "questions": ["q: one?", "[draft]"]}
WANT = sorted([("s", "candidate", "s", "c1", 0), ("s", "arrow", "c1", "a1", 0), ("s", "arrow", "c1", "a2", 1), ("s", "bridge", "c1", "b1", 0), ("s", "question", "c1", "q: one?", 0), ("s", "question", "c1", "[draft]", 1)], key=str)


def test_spelling_and_wrapping_make_no_difference(spark):
    snake = {"ID": "c1", "proposed_arrows": CAND["proposedArrows"], "Bridge-Arrow": CAND["bridgeArrow"], "QUESTIONS": CAND["questions"]}
    for value in ([CAND], CAND, {"candidates": [CAND]}, {"Candidates": CAND}, [snake]):
        for text in (json.dumps(value), json.dumps(value, indent=2), json.dumps(json.dumps(value)), json.dumps(json.dumps(json.dumps(value)))):
            assert run(spark, [("s", text, None, 1)]) == WANT


def test_the_latest_row_of_a_session(spark):
    assert run(spark, [("s", "[]", None, 5), ("s", json.dumps([CAND]), "x", 4), ("s", json.dumps([CAND]), None, None)]) == []


def test_equations_params_and_gaps(spark):
    eqs = {"equations": [{"id": "e1", "lhs": {"arrows": "one"}, "rhs": {"arrows": ["r1", None, "r3"]}}, {"id": None, "lhs": None}]}
    attrs = {"signature": {"params": {"name": "p", "typeRefs": "T"}}}
    got = run(spark, [("s", None, json.dumps(eqs), 1)], [("x", json.dumps(attrs)), ("x", json.dumps(attrs, indent=1)), ("y", "{}"), ("z", '{"signature":null}'), ("bad", "{"), (None, json.dumps(attrs)), ("n", None)])
    assert got == sorted([("s", "equation", "s", "e1", 0), ("s", "equation", "s", None, 1), ("s", "lhs_step", "e1", "one", 0), ("s", "rhs_step", "e1", "r1", 0), ("s", "rhs_step", "e1", "r3", 2), ("x", "param", "x", "p", 0), ("x", "type_ref", "p", "T", 0)], key=str)


def test_empty_and_unreadable(spark):
    assert run(spark, [("s", "", "null", 1), ("t", "not json", '"text"', 1), (None, "[]", "[]", 1)]) in ([], [("t", "equation", "t", None, 0)])
    assert run(spark, []) == []


def test_tables_one_by_one(spark):
    df = spark.createDataFrame([("s", "x", json.dumps([CAND]), None, 1, None, None)], S)
    t = nested.session_tables(df)
    assert set(t) == {"candidate", "arrow", "bridge", "question", "equation", "lhs_step", "rhs_step"}
    assert [(r.parent_id, r.item_id, r.pos) for r in t["arrow"].orderBy("pos").collect()] == [("c1", "a1", 0), ("c1", "a2", 1)]
    assert nested.element_tables(spark.createDataFrame([], E))["param"].collect() == []
