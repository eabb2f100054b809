"""Attribute-value rows into a wide table with typed columns.

Entities are hash-bucketed; within a bucket, sorted by entity, entity and attribute are dictionary-encoded and the
values scattered by (row, column) into one numpy array per type, which leave as Arrow tables. Before the bucketing
the deciding row of each (entity, attribute) is chosen with map-side partial aggregation, so that an entity that holds
a third of all rows reaches its bucket as one row per attribute.

Defined results: a row without entity makes no cell and no wide row. An entity whose keys are all unknown has a wide
row of nulls. Equal times are decided by the greater value text, null being the least; a null time is earlier than any
other. Blank, null or not wholly readable deciding values leave null in the cell. Integers are 64-bit and decimals
have at most 15 digits before the point; beyond that a value is not readable. Columns of the input other than the four
named are ignored. An attribute named like the entity column is called `<name>_attr` in the wide table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, functions as F, types as T

from arrowlens.functions.text import alnum_key, trim_blank
from arrowlens.runtime import shuffle_partitions

#: The definitions become columns, so they are read to the driver; more than this is an error, not a slow plan.
MAX_ATTRIBUTES = 10_000

_TYPES = {
    "int": T.LongType(),
    "bool": T.BooleanType(),
    "dec": T.DecimalType(18, 3),
    "ts": T.TimestampType(),
    "str": T.StringType(),
}
#: Cells (rows x columns of one type) that are scattered at once; what one block of entities takes in memory.
BLOCK_CELLS = 1 << 20
_TRUE = ("true", "t", "yes", "y", "on", "1")
_FALSE = ("false", "f", "no", "n", "off", "0")


def read_int(v: Column) -> Column:
    """Whole numbers: sign, leading zeros, digit groups of three (, _ ' or a space) and zero decimals are readable."""
    s = F.regexp_replace(v, "−", "-")
    ok = s.rlike(r"^[+-]?(\d+|\d{1,3}([,_'\x{2019} \x{A0}\x{202F}]\d{3})+)(\.0*)?$")
    digits = F.regexp_replace(F.regexp_replace(s, r"\.0*$", ""), r"[^0-9-]", "")
    return F.when(ok, digits.try_cast("bigint"))


def read_bool(v: Column) -> Column:
    s = F.lower(v)
    return F.when(s.isin(*_TRUE), F.lit(True)).when(s.isin(*_FALSE), F.lit(False))


def read_dec(v: Column) -> Column:
    """Finite decimals, rounded half up to three places; a comma is the decimal sign, % means hundredths."""
    s = F.regexp_replace(v, "−", "-")
    ok = s.rlike(r"^[+-]?(\d+([.,]\d*)?|[.,]\d+)([eE][+-]?\d{1,2})?[\s\x{A0}\x{202F}]*%?$")
    number = F.regexp_replace(F.regexp_replace(s, r"[\s\x{A0}\x{202F}]*%$", ""), ",", ".").try_cast("decimal(38,18)")
    scaled = F.when(s.endswith("%"), number * F.lit("0.01").cast("decimal(3,2)")).otherwise(number)
    return F.when(ok, F.round(scaled, 3).try_cast("decimal(18,3)"))


def read_ts(v: Column) -> Column:
    """ISO notations (UTC where no zone stands, a date alone is its midnight), 10 or 13 digits as epoch s or ms."""
    iso = r"^(\d{4})-?(\d{2})-?(\d{2})(?:[Tt ]+(\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?\s*([Zz]|[+-]\d{2}(?::?\d{2})?)?)?$"
    part = lambda i: F.regexp_extract(v, iso, i)
    or0 = lambda i: F.when(part(i) == "", F.lit("00")).otherwise(part(i))
    zone = F.when(part(8).isin("", "Z", "z"), F.lit("+00:00")).otherwise(
        F.concat(F.substring(part(8), 1, 3), F.lit(":"), F.rpad(F.regexp_replace(F.substring(part(8), 4, 3), ":", ""), 2, "0"))
    )
    text = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit("T"), or0(4), F.lit(":"), or0(5), F.lit(":"), or0(6), F.lit("."), F.rpad(F.substring(part(7), 1, 6), 6, "0"), zone)
    return (
        F.when(v.rlike(r"^\d{10}$"), F.timestamp_seconds(v.try_cast("bigint")))
        .when(v.rlike(r"^\d{13}$"), F.timestamp_millis(v.try_cast("bigint")))
        .when(v.rlike(iso), text.try_cast("timestamp"))
    )


def definitions(defs: DataFrame) -> list[tuple[str, str, str]]:
    """(normal key, attr_key, attr_type), sorted by attr_key; of equal normal keys the first attr_key stays."""
    rows = (
        defs.select(F.col("attr_key").alias("k"), F.lower(trim_blank(F.col("attr_type"))).alias("t"))
        .where("k is not null")
        .withColumn("n", alnum_key(F.col("k")))
        .distinct()
        .limit(MAX_ATTRIBUTES + 1)
        .collect()
    )
    if len(rows) > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes")
    out: dict[str, tuple[str, str, str]] = {}
    for r in sorted(rows, key=lambda r: (r["k"], r["t"] or "")):
        out.setdefault(r["n"], (r["n"], r["k"], r["t"] if r["t"] in _TYPES else "str"))
    return sorted(out.values(), key=lambda d: d[1])


def latest_cells(rows: DataFrame, defs: list[tuple[str, str, str]], entity: str, key: str, value: str, time: str) -> DataFrame:
    """(entity, attr, v_int, v_bool, v_dec, v_ts, v_str): the deciding value of each cell, read as its type.

    attr is the index in `defs`; -1 stands for all unknown keys of an entity together.
    """
    spark = rows.sparkSession
    known = spark.createDataFrame([(n, i) for i, (n, _, _) in enumerate(defs)], "norm string, attr int")
    picked = rows.select(F.col(entity).alias("entity"), alnum_key(F.col(key)).alias("norm"), F.col(value).cast("string").alias("value"), F.col(time).alias("at")).where("entity is not null")
    keyed = picked.join(F.broadcast(known), "norm", "left").select("entity", F.coalesce("attr", F.lit(-1)).alias("attr"), "at", F.when(F.col("attr").isNotNull(), F.col("value")).alias("value"))
    last = keyed.groupBy("entity", "attr").agg(F.max(F.struct("at", "value")).alias("m")).select("entity", "attr", trim_blank(F.col("m.value")).alias("v"))
    kinds: dict[str, list[int]] = {t: [i for i, d in enumerate(defs) if d[2] == t] for t in _TYPES}
    of = lambda t: F.col("attr").isin(kinds[t]) if kinds[t] else F.lit(False)
    v = F.when(F.col("v") != "", F.col("v"))
    return last.select(
        "entity",
        "attr",
        F.when(of("int"), read_int(v)).alias("v_int"),
        F.when(of("bool"), read_bool(v)).alias("v_bool"),
        F.when(of("dec"), (read_dec(v) * 1000).cast("bigint")).alias("v_dec"),
        F.when(of("ts"), F.unix_micros(read_ts(v))).alias("v_ts"),
        F.when(of("str"), v).alias("v_str"),
    )


def _scatter(names: list[str], types: list[str], entity_name: str):
    """mapInArrow function over rows that are sorted by entity: Arrow batches of one row per entity, made in blocks of
    as many entities as fit BLOCK_CELLS cells of the type with most columns."""

    import numpy as np

    of_type = {t: [i for i, x in enumerate(types) if x == t] for t in _TYPES}
    place = np.full(len(types) + 1, -1, dtype="int64")  # the last place serves attr -1
    for cols in of_type.values():
        place[cols] = np.arange(len(cols))
    entities = max(1, BLOCK_CELLS // max([1, *map(len, of_type.values())]))

    def decimals(values, gone):
        """128-bit decimals with three places from scaled 64-bit integers."""
        import pyarrow as pa

        raw = np.empty((len(values), 2), dtype="int64")
        raw[:, 0], raw[:, 1] = values, values >> 63
        there = pa.array(~gone).buffers()[1]
        return pa.Array.from_buffers(pa.decimal128(18, 3), len(values), [there, pa.py_buffer(raw.tobytes())])

    def block(names_of_rows, row, attr, sources):
        """One row per entity of the block, a column per attribute."""
        import pyarrow as pa

        n = len(names_of_rows)
        columns: dict[int, pa.Array] = {}
        for kind, dtype in (("int", "int64"), ("bool", "bool"), ("dec", "int64"), ("ts", "int64"), ("str", "object")):
            cols = of_type[kind]
            if not cols:
                continue
            source = sources[kind]
            take = source.is_valid().to_numpy(zero_copy_only=False)
            values, there = np.zeros((n, len(cols)), dtype=dtype), np.zeros((n, len(cols)), dtype=bool)
            at = (row[take], place[attr[take]])
            values[at] = source.filter(pa.array(take)).to_numpy(zero_copy_only=False)
            there[at] = True
            for j, i in enumerate(cols):
                v, gone = np.ascontiguousarray(values[:, j]), ~there[:, j]
                if kind == "ts":
                    columns[i] = pa.array(v.astype("datetime64[us]"), mask=gone).cast(pa.timestamp("us", tz="UTC"))
                elif kind == "dec":
                    columns[i] = decimals(v, gone)
                elif kind == "str":
                    columns[i] = pa.array(v, type=pa.string(), mask=gone)
                else:
                    columns[i] = pa.array(v, mask=gone)
        return pa.RecordBatch.from_arrays([names_of_rows, *(columns[i] for i in range(len(names)))], names=[entity_name, *names])

    def emit(table):
        table = table.combine_chunks()
        coded = table.column("entity").chunk(0).dictionary_encode()
        row = coded.indices.to_numpy(zero_copy_only=False)  # rising, as rows are sorted by entity
        attr = table.column("attr").to_numpy()
        for first in range(0, len(coded.dictionary), entities):
            a, b = np.searchsorted(row, [first, first + entities])
            sources = {t: table.column(f"v_{t}").chunk(0).slice(a, b - a) for t in of_type}
            yield block(coded.dictionary.slice(first, entities), row[a:b] - first, attr[a:b], sources)

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table]).combine_chunks()
            if not len(table):
                continue
            same = pc.equal(table.column("entity"), table.column("entity")[len(table) - 1])
            cut = pc.index(same, True).as_py()  # the last entity may go on in the next batch
            if cut:
                yield from emit(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None and len(held):
            yield from emit(held)

    return run


def attributes_to_wide(rows: DataFrame, defs: DataFrame, entity: str = "elem_id", key: str = "key", value: str = "value", time: str = "recorded_at", buckets: int | None = None) -> DataFrame:
    """One row per entity, a column of the right type per attr_key of `defs` (columns attr_key, attr_type)."""
    known = definitions(defs)
    names = [f"{k}_attr" if k.lower() == entity.lower() else k for _, k, _ in known]
    schema = T.StructType([T.StructField(entity, T.StringType()), *(T.StructField(n, _TYPES[d[2]]) for n, d in zip(names, known))])
    cells = latest_cells(rows, known, entity, key, value, time)
    bucketed = cells.repartition(buckets or shuffle_partitions(rows.sparkSession), "entity").sortWithinPartitions("entity")
    return bucketed.mapInArrow(_scatter(names, [d[2] for d in known], entity), schema)


def wide_cells(wide: DataFrame, entity: str = "elem_id") -> DataFrame:
    """The filled cells of a wide table as (entity, attr_key, attr_value text)."""
    cells = []
    for f in wide.schema.fields:
        if f.name == entity:
            continue
        c = F.col(f"`{f.name}`")
        text = F.unix_millis(c).cast("string") if isinstance(f.dataType, T.TimestampType) else c.cast("string")
        cells.append(F.struct(F.lit(f.name).alias("attr_key"), text.alias("attr_value")))
    if not cells:
        return wide.select(entity, F.lit(None).cast("string").alias("attr_key"), F.lit(None).cast("string").alias("attr_value")).where("false")
    return wide.select(entity, F.inline(F.filter(F.array(*cells), lambda x: x["attr_value"].isNotNull())))
