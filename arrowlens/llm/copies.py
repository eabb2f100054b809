"""Duplicates hidden by formatting differences.

Records get a canonical form (letters and digits of kind and name in one case, module as it is, attrs as a JSON value)
and a hash of it.

1. Each partition builds two Bloom filters: hashes seen, and hashes seen again. They are cut by ranges of the hash and
   travel sparse (positions, or bits where those are shorter), about eight bytes a row. Each range is merged on its
   own: a bit of "again" is set if it was set in either filter, or if both have it in "seen"; so every hash that
   stands in two rows anywhere passes the merged "again" filter. A range has RANGE_BITS bits whatever the number of
   rows; with the rows the number of ranges grows, not what a task holds.
2. What has to reach the rows is the merged "again" filter, which holds repeats only. It is folded to about 16 bits a
   repeat (positions modulo a smaller power of two) and, if that is at most `max_filter_bytes`, broadcast. Rows that
   miss it are singletons and leave at once, unshuffled. A larger one stays where it is, and rows meet its positions
   in a shuffled join, which a few per cent of the singletons pass; rows of the most frequent hashes, which are repeats anyhow, do not take part in that join.
3. Only possible repeats are grouped exactly, as SHA-256 fingerprints with ids.

Groups that hold very many rows are combined on the map side; to attach members to their representative, fingerprints
with at least a thousandth of all possible repeats (a thousand at most) are joined by broadcast, the rest by shuffle.

Defined results: null kind, name, module or attrs equal null only (for kind and name, null and a text without letters
and digits differ). Unreadable JSON stands for itself without outer blanks. Rows without id are records and count as
copies but never stand in pairs; the representative is the smallest id that is not null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

from arrowlens.functions.text import alnum_key, canonical_json
from arrowlens.runtime import Scratch

#: Bits of one hash range of the filters, rows that a partition adds at a time, bits of a piece of the folded filter.
RANGE_BITS, CHUNK_ROWS, SEGMENT_BITS = 1 << 25, 1 << 22, 1 << 19
#: Greatest filter that is broadcast; it holds some thirty million repeats.
MAX_FILTER_BYTES = 1 << 26
HASHES, BITS_PER_ROW = 2, 16
#: Frequent hashes that keep out of the shuffled join: those with a thousandth of all rows, 500 at most.
FREQUENT, FREQUENT_SHARE = 500, 0.001


def canonical(elems: DataFrame) -> DataFrame:
    """(id, c_kind, c_name, module, c_attrs, h): the canonical form of each row and its 64-bit hash."""
    form = elems.select("id", alnum_key(F.col("kind")).alias("c_kind"), alnum_key(F.col("name")).alias("c_name"), F.col("module"), canonical_json(F.col("attrs")).alias("c_attrs"))
    return form.withColumn("text", _text()).withColumn("h", F.xxhash64("text"))


def _text() -> Column:
    """One text for the canonical form: each field with its length, null apart."""
    part = lambda c: F.when(F.col(c).isNull(), F.lit("~")).otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)))
    return F.concat(part("c_kind"), part("c_name"), part("module"), part("c_attrs"))


def filter_ranges(rows: int) -> int:
    """Hash ranges (a power of two) that give each row BITS_PER_ROW bits."""
    ranges = 1
    while ranges * RANGE_BITS < rows * BITS_PER_ROW:
        ranges *= 2
    return ranges


def _places(h, ranges: int):
    """(range, positions in it) of 64-bit hashes: the range by the highest bits, HASHES positions by the others."""
    import numpy as np

    u = h.astype(np.uint64)
    shift = 64 - (ranges.bit_length() - 1)
    in_range = (u >> np.uint64(shift)).astype(np.int64) if ranges > 1 else np.zeros(len(u), np.int64)
    step = (u >> np.uint64(25)) | np.uint64(1)
    return in_range, [((u + np.uint64(i) * step) & np.uint64(RANGE_BITS - 1)).astype(np.int64) for i in range(HASHES)]


def _packed(positions) -> bytes:
    """Positions of a range as 32-bit numbers or as bits, whichever is shorter; the first byte says which."""
    import numpy as np

    at = np.unique(positions)
    if 4 * len(at) <= RANGE_BITS // 8:
        return b"p" + at.astype("<u4").tobytes()
    bits = np.zeros(RANGE_BITS, bool)
    bits[at] = True
    return b"b" + np.packbits(bits, bitorder="little").tobytes()


def _unpacked(data: bytes):
    import numpy as np

    body = np.frombuffer(data, np.uint8, offset=1)
    return body.view("<u4").astype(np.int64) if data[:1] == b"p" else np.flatnonzero(np.unpackbits(body, bitorder="little"))


def _build(ranges: int):
    """mapInArrow: the filters of each CHUNK_ROWS rows of a partition, a row for each range that has a bit."""

    def emit(held):
        import numpy as np
        import pyarrow as pa

        once, counts = np.unique(np.concatenate(held).astype(np.uint64), return_counts=True)  # in order of ranges
        at, positions = _places(once, ranges)
        cuts = np.flatnonzero(np.diff(at)) + 1
        rows = []
        for a, b in zip([0, *cuts], [*cuts, len(at)]):
            twice = counts[a:b] > 1
            rows.append((int(at[a]), _packed(np.concatenate([p[a:b] for p in positions])), _packed(np.concatenate([p[a:b][twice] for p in positions]))))
        r, s, g = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(s, pa.binary()), pa.array(g, pa.binary())], ["range", "seen", "again"])

    def run(batches: Iterable) -> Iterator:
        held, n = [], 0
        for b in batches:
            if len(b):
                held.append(b.column(0).to_numpy(zero_copy_only=False))
                n += len(b)
            if n >= CHUNK_ROWS:
                yield emit(held)
                held, n = [], 0
        if n:
            yield emit(held)

    return run


def _merge(pdf):
    """All filters of one range: the bits that stand for more than one row."""
    import numpy as np
    import pandas as pd

    seen, again = np.zeros(RANGE_BITS, bool), np.zeros(RANGE_BITS, bool)
    for s, a in zip(pdf["seen"], pdf["again"]):
        at = _unpacked(s)
        again[_unpacked(a)] = True
        again[at[seen[at]]] = True
        seen[at] = True
    at = np.flatnonzero(again)
    return pd.DataFrame({"range": [pdf["range"].iloc[0]], "again": [_packed(at)], "n": [len(at)]})


def _fold(bits: int):
    """mapInArrow: merged ranges as pieces of a filter of `bits` bits."""

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for r, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = np.unique((_unpacked(a) + r * RANGE_BITS) & (bits - 1))
                piece = at // SEGMENT_BITS
                for s in np.unique(piece):
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([(at[piece == s] % SEGMENT_BITS).astype("<u4").tobytes()], pa.binary())], ["piece", "at"])

    return run


def _joined(pdf):
    import numpy as np
    import pandas as pd

    bits = np.zeros(SEGMENT_BITS, bool)
    for a in pdf["at"]:
        bits[np.frombuffer(a, "<u4")] = True
    return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})


def _numbers(batches: Iterable) -> Iterator:
    """mapInArrow: the positions of merged ranges, counted over all ranges."""
    import pyarrow as pa

    for b in batches:
        for r, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(_unpacked(a) + r * RANGE_BITS, pa.int64())], ["place"])


def mark_repeats(rows: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """Adds `maybe`: whether the hash h of a row may stand in another row too (never false if it does)."""
    spark = rows.sparkSession
    ranges = filter_ranges(rows.count())
    parts = rows.select("h").mapInArrow(_build(ranges), "range int, seen binary, again binary")
    merged = Scratch(spark, "bloom").write(parts.groupBy("range").applyInPandas(_merge, "range int, again binary, n long"), "again")
    set_bits = merged.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = SEGMENT_BITS
    while bits < set_bits * BITS_PER_ROW // HASHES:
        bits *= 2
    if bits // 8 <= max_filter_bytes:
        return rows.withColumn("maybe", _in_filter(merged, min(bits, ranges * RANGE_BITS), ranges)(F.col("h")))
    return _meet(rows, merged, ranges)


def _in_filter(merged: DataFrame, bits: int, ranges: int):
    """A function of h that says whether the broadcast folded filter has it."""
    flat = bytearray(bits // 8)
    pieces = merged.select("range", "again").mapInArrow(_fold(bits), "piece int, at binary").groupBy("piece").applyInPandas(_joined, "piece int, bits binary")
    for r in pieces.toLocalIterator():
        flat[r["piece"] * SEGMENT_BITS // 8 : (r["piece"] + 1) * SEGMENT_BITS // 8] = r["bits"]
    shared = merged.sparkSession.sparkContext.broadcast(bytes(flat))

    @F.pandas_udf("boolean")
    def maybe(h):
        import numpy as np
        import pandas as pd

        have = np.frombuffer(shared.value, np.uint8)
        r, positions = _places(h.to_numpy(), ranges)
        hit = np.ones(len(h), bool)
        for p in positions:
            at = (p + r * RANGE_BITS) & (bits - 1)
            hit &= (have[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return pd.Series(hit)

    return maybe


def _meet(rows: DataFrame, merged: DataFrame, ranges: int) -> DataFrame:
    """`maybe` by a join of each row's first position with the filter's positions."""
    shift = ranges.bit_length() - 1
    in_range = F.shiftrightunsigned(F.col("h"), 64 - shift) if shift else F.lit(0).cast("long")
    place = in_range * RANGE_BITS + F.col("h").bitwiseAND(F.lit(RANGE_BITS - 1))
    n, top = rows.agg(F.count(F.lit(1)), F.expr(f"approx_top_k(h, {FREQUENT}, 8192)")).first()
    frequent = [x["item"] for x in top or [] if x["count"] >= max(2, FREQUENT_SHARE * n)]
    often = F.col("h").isin(frequent) if frequent else F.lit(False)
    apart = -1 - F.pmod(F.xxhash64("id", F.col("h")), F.lit(1 << 20))  # no place; spreads what does not take part
    places = merged.select("range", "again").mapInArrow(_numbers, "place long").withColumn("hit", F.lit(True))
    keyed = rows.withColumn("often", often).withColumn("place", F.when(F.col("often"), apart).otherwise(place))
    return keyed.join(places, "place", "left").withColumn("maybe", F.col("often") | F.coalesce("hit", F.lit(False))).drop("place", "often", "hit")


def collapse(elems: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """(id, kind, name, module, attrs, copies, ids): each record once in canonical form, with its number of rows
    (copies) and of different ids; id is the smallest."""
    marked = mark_repeats(canonical(elems), max_filter_bytes)
    single = marked.where("NOT maybe").select("id", "c_kind", "c_name", "module", "c_attrs", F.lit(1).cast("long").alias("copies"), F.when(F.col("id").isNull(), 0).otherwise(1).cast("long").alias("ids"))
    form = F.struct("c_kind", "c_name", "module", "c_attrs")
    by_id = marked.where("maybe").groupBy(F.sha2("text", 256).alias("fp"), "id").agg(F.count(F.lit(1)).alias("n"), F.max(form).alias("form"))
    groups = by_id.groupBy("fp").agg(F.min("id").alias("id"), F.sum("n").alias("copies"), F.count("id").alias("ids"), F.max("form").alias("form"))
    out = single.unionByName(groups.select("id", "form.*", "copies", "ids"))
    return out.select("id", F.col("c_kind").alias("kind"), F.col("c_name").alias("name"), "module", F.col("c_attrs").alias("attrs"), "copies", "ids")


def copy_pairs(elems: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """(elem_id_a, elem_id_b): the smallest id of each group of copies with each other id of the group."""
    marked = mark_repeats(canonical(elems), max_filter_bytes)
    members = marked.where("maybe AND id IS NOT NULL").select(F.unhex(F.sha2("text", 256)).alias("fp"), "id").groupBy("fp", "id").agg(F.lit(1).alias("one")).drop("one")
    members = Scratch(elems.sparkSession, "copies").write(members, "members")
    groups = members.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    share = max(1000, members.count() // 1000)
    heavy = groups.where(F.col("n") >= share).select("fp", "first")
    light = groups.where(F.col("n") < share).select("fp", "first")
    pairs = members.join(F.broadcast(heavy), "fp").unionByName(members.join(light, "fp"))
    return pairs.where("id <> first").select(F.col("first").alias("elem_id_a"), F.col("id").alias("elem_id_b"))

