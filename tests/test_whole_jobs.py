"""Registered queries that must do the whole job: held against their SQL, or against brute force, over small tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from arrowlens.operators import mining
from arrowlens.sources.lens import star_graph

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def same_as_sql(spark, sf, db, name):
    df = entry.queries()[name](spark, sf)
    got, want = rows(df), sorted(db.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[name]}) q").fetchall(), key=repr)
    assert got == want
    return got


def test_analogues_of_every_function(spark, sf, db):
    got = same_as_sql(spark, sf, db, "analogues_all")
    every = {f"customer:{k}" for (k,) in db.execute("SELECT c_custkey FROM customer").fetchall()}
    assert {r[0] for r in got} == every
    assert {r[:4] for r in got if int(r[0][9:]) % 20 == 0} == {tuple(r) for r in rows(entry.queries()["analogues_topk"](spark, sf))}


@pytest.mark.parametrize("name", ["mine_path_annotations_all", "mine_candidate_pairs_all", "mine_coverage_all", "mine_coverage", "mine_dominant_kinds"])
def test_mining_of_all_kinds_and_seeds(spark, sf, db, name):
    got = same_as_sql(spark, sf, db, name)
    assert got
    if name == "mine_path_annotations_all":
        assert {k for r in got for k in r[0].split(">")} >= {"param", "returns", "typeof", "definedIn", "hasProperty"}


def test_equations_of_all_kinds_and_seeds(spark, sf, db):
    """Brute force over sets of the whole lens to depth 3."""
    prefix = entry.oracle_sql()["degrees"].rpartition("SELECT e.id, coalesce")[0]
    out, kinds = {}, dict(db.execute(prefix + "SELECT id, kind FROM elem").fetchall())
    for k, s, d in db.execute(prefix + "SELECT kind, src_id, dst_id FROM arr").fetchall():
        out.setdefault(s, {}).setdefault(k, set()).add(d)
    sets, notes = {}, {}
    for seed in (i for i, k in kinds.items() if k in mining.SEED_KINDS):
        level = {(): {seed}}
        for _ in range(3):
            nxt = {}
            for path, at in level.items():
                for i in at:
                    for k, ends in out.get(i, {}).items():
                        if not path or path[-1] != k:
                            nxt.setdefault((*path, k), set()).update(ends)
            level = nxt
            for path, ends in level.items():
                sets.setdefault(path, {})[seed] = ends
                n = notes.setdefault(path, (set(), set()))
                n[0].add(kinds[seed])
                n[1].update(kinds[e] for e in ends)
    domain = {p: min(n[0]) if len(n[0]) == 1 else None for p, n in notes.items()}
    want = set()
    for l in notes:
        for r in notes:
            if (len(l), ">".join(l)) < (len(r), ">".join(r)) and domain[l] == domain[r] and notes[l][1] & notes[r][1]:
                seeds = sets[l].keys() | sets[r].keys()
                want.add((l, r, sum(sets[l].get(s) == sets[r].get(s) for s in seeds), len(seeds)))
    got = mining.mine_equations(star_graph(spark, sf), None, mining.SEED_KINDS, 3, 0.0, None).collect()
    assert {(tuple(r.lhs), tuple(r.rhs), r.support, r.total) for r in got} == want and len(got) == len(want)
    kept = entry.queries()["mine_equations"](spark, sf).collect()
    assert kept and {(tuple(r.lhs.split(">")), tuple(r.rhs.split(">")), r.support, r.total) for r in kept} <= {w for w in want if w[2] >= 0.8 * w[3]}
    assert any(r.lhs[0] == "param" for r in got)


def test_briefs_of_every_function(spark, sf, db):
    prefix = entry.oracle_sql()["degrees"].rpartition("SELECT e.id, coalesce")[0]
    call = dict(db.execute(prefix + "SELECT src_id, count(DISTINCT dst_id) FROM arr WHERE kind = 'callerOf' GROUP BY 1").fetchall())
    away = dict(db.execute(prefix + "SELECT a.src_id, count(DISTINCT a.dst_id) FROM arr a JOIN elem s ON s.id = a.src_id JOIN elem d ON d.id = a.dst_id WHERE a.kind = 'callerOf' AND s.module <> d.module GROUP BY 1").fetchall())
    like = dict(db.execute(f"SELECT target, count(*) FROM ({entry.oracle_sql()['analogues_all']}) q GROUP BY 1").fetchall())
    every = [f"customer:{k}" for (k,) in db.execute("SELECT c_custkey FROM customer").fetchall()]
    got = sorted((r[:4] for r in same_as_sql(spark, sf, db, "brief_elements")), key=repr)
    assert got == sorted(((i, call.get(i), like.get(i), away.get(i)) for i in every), key=repr)
