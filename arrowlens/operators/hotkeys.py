"""Per-key results where a few keys hold most rows: two-stage salted aggregation.

1. A mergeable frequent-items sketch names the keys that may be heavy (a bounded list) and how many salts each needs.
2. Repeated deliveries of an arrow are removed, with map-side combining, on 128-bit hashes of its id.
3. Each distinct fact of a key (an arrow, a neighbour, a kind) gets a salt from its own hash if the key is heavy: the
   salt is as good as random, the same on every retry of a task, and puts equal facts under one salt, so that
   distinct counts of the salts add up.
4. Partial results are made for each (key, salt), then merged by key.

The sketch only decides how work is spread; every result is exact and covers all rows.

Defined results: a null id is one arrow of its own and a null key a key of its own. Ids are compared as exact text,
kinds without letter case and outer blanks. If rows of one id disagree on its ends, one of them stands for the arrow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from arrowlens.functions.text import plain_kind, wide_hash
from arrowlens.runtime import Scratch, shuffle_partitions

#: Keys that the sketch reports for each side; a key with a share of more than 1/SKETCH_ITEMS is among them.
TOP_KEYS, SKETCH_ITEMS, MAX_SALTS = 500, 8192, 1024


def heavy_keys(arrows: DataFrame, sides: dict[str, str], share: float = 0.001) -> tuple[list[tuple[str, str, int]], int]:
    """(side, key, estimated rows) of keys that hold `share` or more of the rows, at most TOP_KEYS a side; and the
    number of rows."""
    cols = [F.expr(f"approx_top_k(coalesce(`{c}`, '\u0000null'), {TOP_KEYS}, {SKETCH_ITEMS})").alias(s) for s, c in sides.items()]
    row = arrows.agg(F.count(F.lit(1)).alias("rows"), *cols).first()
    return [(s, x["item"], x["count"]) for s in sides for x in (row[s] or []) if x["count"] >= share * row["rows"]], row["rows"]


def _salts(spark: SparkSession, heavy: list[tuple[str, str, int]], share: int) -> DataFrame:
    """Salts of each heavy key: one for each fair share of a task that its rows make up."""
    rows = [(s, None if k == "\u0000null" else k, min(MAX_SALTS, -(-n // share))) for s, k, n in heavy]
    df = spark.createDataFrame(rows, "side string, key string, salts int")
    k1, k2 = wide_hash(F.col("key"))
    return df.select("side", k1.alias("k1"), k2.alias("k2"), "salts")


def salted_counts(arrows: DataFrame, scratch: Scratch, measures: tuple[str, ...] = ("arrows", "neighbours", "kinds"), tasks: int | None = None) -> DataFrame:
    """(side, k1, k2, and a count for each measure): both sides of every distinct arrow, keys as 128-bit hashes.

    A key gets a salt for each fair share of one of `tasks` (the shuffle partitions) that it holds, whatever the size.
    """
    spark = arrows.sparkSession
    sides = {"dst": "dst_id", "src": "src_id"}
    heavy, n = heavy_keys(arrows, sides)
    salts = F.broadcast(_salts(spark, heavy, max(1, n // (tasks or shuffle_partitions(spark)))))
    hashes = {n: wide_hash(c) for n, c in {"i": F.col("id"), "s": F.col("src_id"), "d": F.col("dst_id"), "c": plain_kind(F.col("kind"))}.items()}
    wanted = ["i", "s", "d", *(["c"] if "kinds" in measures else [])]
    narrow = arrows.select(*(h.alias(f"{n}{j}") for n in wanted for j, h in enumerate(hashes[n], 1)))
    distinct = narrow.groupBy("i1", "i2").agg(*(F.first(f"{n}{j}").alias(f"{n}{j}") for n in wanted[1:] for j in (1, 2)))

    def facts(of: dict[str, str]) -> F.Column:
        """Both ends of an arrow as (side, key, fact), of[side] naming the fact."""
        ends = (("dst", "d"), ("src", "s"))
        return F.inline(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{k}1").alias("k1"), F.col(f"{k}2").alias("k2"), F.col(f"{of[s]}1").alias("h1"), F.col(f"{of[s]}2").alias("h2")) for s, k in ends)))

    def salted(rows: DataFrame) -> DataFrame:
        return rows.join(salts, ["side", "k1", "k2"], "left").withColumn("salt", F.when(F.col("salts") > 1, F.pmod("h1", F.col("salts"))).otherwise(F.lit(0)).cast("int"))

    key, zero = ["side", "k1", "k2"], F.lit(0).cast("long")
    if measures == ("arrows",):  # an arrow is a fact of its own already
        partial = salted(distinct.select(facts({"dst": "i", "src": "i"}))).groupBy(*key, "salt").agg(F.count(F.lit(1)).alias("arrows"))
    else:
        # arrows with one other end make one fact; kinds are few for each key and are combined before the shuffle
        pairs = salted(distinct.select(facts({"dst": "s", "src": "d"}))).groupBy(*key, "salt", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        near = pairs.groupBy(*key, "salt").agg(F.sum("n").alias("arrows"), F.count(F.lit(1)).alias("neighbours")).select(*key, "arrows", "neighbours", zero.alias("kinds"))
        kinds = distinct.select(facts({"dst": "c", "src": "c"})).groupBy(*key, "h1", "h2").agg(F.lit(1).alias("one")).groupBy(*key).agg(F.count(F.lit(1)).alias("kinds"))
        partial = near.unionByName(kinds.select(*key, zero.alias("arrows"), zero.alias("neighbours"), "kinds"))
    return partial.groupBy(*key).agg(*(F.sum(m).alias(m) for m in measures))


def _ends(arrows: DataFrame) -> DataFrame:
    e = arrows.select(F.inline(F.array(F.struct(F.lit("dst").alias("side"), F.col("dst_id").alias("elem_id")), F.struct(F.lit("src").alias("side"), F.col("src_id").alias("elem_id")))))
    k1, k2 = wide_hash(F.col("elem_id"))
    return e.select("side", "elem_id", k1.alias("k1"), k2.alias("k2"))


def element_summary(arrows: DataFrame) -> DataFrame:
    """(side, elem_id, arrows, neighbours, kinds): exact counts of distinct arrows, other ends and kinds of each key."""
    scratch = Scratch(arrows.sparkSession, "hot")
    counts = salted_counts(arrows, scratch)
    names = _ends(arrows).groupBy("side", "k1", "k2", "elem_id").agg(F.lit(1).alias("one")).drop("one")
    return names.join(counts, ["side", "k1", "k2"]).select("side", "elem_id", "arrows", "neighbours", "kinds")


def dominant_keys(arrows: DataFrame, share: tuple[int, int] = (1, 100)) -> DataFrame:
    """(side, elem_id, arrows): the keys that at least share[0]/share[1] of the distinct arrows have.

    At most share[1]/share[0] keys a side can qualify, which bounds what is broadcast to find their names.
    """
    spark = arrows.sparkSession
    scratch = Scratch(spark, "hot")
    counts = scratch.write(salted_counts(arrows, scratch, ("arrows",)), "counts")
    total = counts.where("side = 'dst'").agg(F.coalesce(F.sum("arrows"), F.lit(0))).first()[0]
    over = counts.where(F.col("arrows") * share[1] >= F.lit(total) * share[0])
    named = _ends(arrows).join(F.broadcast(over), ["side", "k1", "k2"]).where("elem_id is not null")
    return named.groupBy("side", "elem_id").agg(F.max("arrows").alias("arrows"))
