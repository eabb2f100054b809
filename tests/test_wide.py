import datetime as dt

from arrowlens.operators import wide

ROWS = "elem_id string, key string, value string, recorded_at timestamp, attr_key string, extra string"
DEFS = [("loc", "int"), ("Ratio", "dec"), ("is_ok", "bool"), ("seen_at", "ts"), ("note", "str")]


def day(n):
    return dt.datetime(2024, 1, n, tzinfo=dt.timezone.utc)


def cells(spark, rows, defs=DEFS):
    df = spark.createDataFrame([(e, k, v, day(d) if d else None, "clash", "x") for e, k, v, d in rows], ROWS)
    d = spark.createDataFrame(defs, "attr_key string, attr_type string")
    out = wide.wide_cells(wide.attributes_to_wide(df, d, buckets=3))
    return sorted((r.elem_id, r.attr_key, r.attr_value) for r in out.collect())


def test_notations(spark):
    ints = {"7": "7", " 007 ": "7", "+5": "5", "-0": "0", "-12.0": "-12", "1,234": "1234", "1_000_000": "1000000", "3.5": None, "12 lines": None, "1,2": None, "": None, "n/a": None, None: None, "99999999999999999999": None}
    decs = {"1,5": "1.500", "12.5 %": "0.125", "50%": "0.500", ".003": "0.003", "-0.0": "0.000", "NaN": None, "1/3": None, "0..5": None, "%": None, "2": "2.000", "0.0005": "0.001"}
    bools = {"Yes": "true", "0": "false", "off": "false", " T ": "true", "tru": None, "both": None}
    times = {"1664088796": "1664088796000", "1664074494123": "1664074494123", "2024-02-01": "1706745600000", "2024-02-01T01:00:00+02:00": "1706742000000", "2024-02-01 00:00:01": "1706745601000", "2024-02-01T00:00:00.250Z": "1706745600250", "2023-02-30": None, "0000-00-00": None, "2024-13-45T00:00:00Z": None, "123": None}
    texts = {"  a b ": "a b", "n/a": "n/a", " ": None, " ": None}
    for key, table in (("LOC", ints), ("ratio", decs), ("isOk", bools), ("seen.at", times), ("Note", texts)):
        rows = [(f"e{i}", key, v, 1) for i, v in enumerate(table)]
        got = {e: v for e, _, v in cells(spark, rows)}
        assert [got.get(f"e{i}") for i in range(len(table))] == list(table.values()), key


def test_latest_row_decides_even_if_unreadable(spark):
    rows = [("a", "loc", "1", 1), ("a", "L.O.C", "2", 3), ("a", "loc", "9", 2), ("b", "loc", "1", 1), ("b", "loc", "n/a", 2), ("c", "loc", "4", None), ("c", "loc", "3", 1), (None, "loc", "1", 1), ("d", "loc2", "1", 1)]
    assert cells(spark, rows) == [("a", "loc", "2"), ("c", "loc", "3")]


def test_ties_and_repeats(spark):
    assert cells(spark, [("a", "loc", "1", 1), ("a", "loc", "2", 1), ("a", "loc", "2", 1)]) == [("a", "loc", "2")]


def test_unknown_keys_leave_a_wide_row_of_nulls(spark):
    df = spark.createDataFrame([("a", "zzz", "1", day(1), None, None)], ROWS)
    row = wide.attributes_to_wide(df, spark.createDataFrame(DEFS, "attr_key string, attr_type string")).first()
    assert row.asDict() == {"elem_id": "a", "Ratio": None, "is_ok": None, "loc": None, "note": None, "seen_at": None}


def test_empty_tables_and_clashing_names(spark):
    assert cells(spark, []) == []
    assert cells(spark, [("a", "loc", "1", 1)], []) == []
    assert cells(spark, [("a", "elem_id", "7", 1)], [("elem_id", "int")]) == [("a", "elem_id_attr", "7")]


def test_an_entity_goes_on_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rows = [(e, k, "1", 1) for e in "abc" for k in ("loc", "ratio", "note")] + [("hot", "loc", str(i), 1 + i % 28) for i in range(2000)]
        got = cells(spark, rows)
        assert len(got) == 10 and ("a", "note", "1") in got and len([g for g in got if g[0] == "hot"]) == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_text(spark):
    assert cells(spark, [("a", "note", "x" * 200_000, 1)])[0][2] == "x" * 200_000


def test_blocks_of_entities_change_nothing(spark, monkeypatch):
    from arrowlens.operators import wide

    rows = [(f"e{i % 37:02d}", k, v, None) for i in range(37) for k, v in (("n", str(i)), ("d", f"-{i}.5"), ("s", f"t{i}"), ("b", "yes"), ("unknown", "x"))]
    df = spark.createDataFrame(rows, "elem_id string, key string, value string, recorded_at timestamp")
    defs = spark.createDataFrame([("n", "int"), ("d", "dec"), ("s", "str"), ("b", "bool"), ("t", "ts"), ("m", "dec")], "attr_key string, attr_type string")
    whole = sorted(map(tuple, wide.attributes_to_wide(df, defs).collect()))
    monkeypatch.setattr(wide, "BLOCK_CELLS", 6)
    assert sorted(map(tuple, wide.attributes_to_wide(df, defs).collect())) == whole and len(whole) == 37
    assert whole[3] == ("e03", True, __import__("decimal").Decimal("-3.500"), None, 3, "t3", None)
