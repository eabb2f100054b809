"""Filling fixed-capacity containers with documents by vector best-fit.

An item is a document, or, only if it is longer than the capacity, its whole pieces of that capacity (each a container
of its own) and its remainder. Items have three sizes: tokens, one document, and attention cost. Attention within a
document is worked off in square tiles, so that its cost is the square of the tiles that its tokens begin; many short
documents cost more than their tokens say. A container has a residual capacity in each size; an item goes, largest
first, into an open container that has room in all three: the one with the least weighted norm of what would be left
("norm") or with the largest weighted dot-product of item and residual ("dot"); if none has room, a new one is opened.

Capacities: tokens as the window says; places, by default a 32nd of the tokens, 16 at least; cost, by default N(N+1)
tiles for a window of N tiles, N = 16: one document that fills the window and a strip beside it. An item alone always
fits by default; an item that exceeds a given cost alone has a container of its own.

Items are dealt by a hash over shards of SHARD items on average, which are packed on their own; that number, and not
the number of documents, is what a task holds, on every level. Containers that a shard leaves emptier than
`again_below` are opened again and their items dealt anew, over as many shards as these items need, until one shard is
left or a level closes less than an eighth of its items. So what is left unused does not grow with the shards.

Defined results: a null or empty text has no tokens and takes a document place and no more; containers of nothing but
such texts, where no place is left elsewhere, are not opened again. Windows with a null or non-positive capacity are
ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from arrowlens.runtime import Scratch

SHARD, MAX_WINDOWS, TILES = 8192, 1000, 16
_ITEM = "window_id string, capacity long, doc_id long, piece int, tokens long"
_PLACED = _ITEM + ", bin string, filled long"


def limits(capacity: int, places: int | None = None, cost: float | None = None, tile: int | None = None) -> tuple[int, float, int]:
    """(places, cost in tiles, side of a tile) of a window, with defaults for what is not given."""
    side = tile or max(1, -(-capacity // TILES))
    n = -(-capacity // side)
    return places or max(16, capacity // 32), cost or float(n * (n + 1)), side


def best_fit(tokens, capacity: int, places: int, cost: float, rule: str = "norm", weights=(1.0, 0.05, 0.05), tile: int = 1):
    """Container numbers of items given by their tokens, in the order in which they are given."""
    import numpy as np

    n = len(tokens)
    out = np.full(n, -1, np.int64)
    wt, wd, wc = weights
    room = np.zeros(n + 1)  # residual shares of the three capacities of the open containers, and their numbers
    left_docs, left_cost, number = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, np.int64)
    used = opened = 0
    smallest = min((int(t) for t in tokens if t > 0), default=0)
    for k in range(n):
        t = float(tokens[k])
        d, p, c = t / capacity, 1.0 / places, float(-(-int(t) // tile)) ** 2 / cost
        r, q, s = room[:used], left_docs[:used], left_cost[:used]
        fits = (r >= d - 1e-12) & (q >= p - 1e-12) & (s >= c - 1e-12)
        at = -1
        if fits.any():
            if rule == "norm":
                score = -(wt * (r - d) ** 2 + wd * (q - p) ** 2 + wc * (s - c) ** 2)
            else:
                score = wt * d * r + wd * p * q + wc * c * s
            at = int(np.argmax(np.where(fits, score, -np.inf)))
        if at < 0:
            at = used
            used += 1
            room[at], left_docs[at], left_cost[at], number[at] = 1.0, 1.0, 1.0, opened
            opened += 1
        room[at] -= d
        left_docs[at] -= p
        left_cost[at] -= c
        out[k] = number[at]
        if room[at] * capacity < smallest - 1e-6 or left_docs[at] < p - 1e-12:  # nothing that follows has room here
            last = used - 1
            for a in (room, left_docs, left_cost, number):
                a[at] = a[last]
            used = last
    return out


def _packer(level: int, places: int | None, cost: float | None, tile: int | None, rule: str):
    def run(key, pdf):
        import numpy as np

        window, shard = key
        capacity = int(pdf["capacity"].iloc[0])
        pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        most_docs, most_cost, side = limits(capacity, places, cost, tile)
        number = best_fit(pdf["tokens"].to_numpy(), capacity, most_docs, most_cost, rule, tile=side)
        filled = np.bincount(number, weights=pdf["tokens"].to_numpy(float)).astype(np.int64)
        pdf["bin"] = [f"{window}-{level}-{shard}-{b}" for b in number]
        pdf["filled"] = filled[number]
        return pdf[["window_id", "capacity", "doc_id", "piece", "tokens", "bin", "filled"]]

    return run


def pack(sizes: DataFrame, windows: DataFrame, places: int | None = None, cost: float | None = None, tile: int | None = None, rule: str = "norm", again_below: float = 0.97, shard: int = SHARD) -> DataFrame:
    """(window_id, bin_id, doc_id, piece, first_token, tokens): where each piece of each document goes.

    sizes has doc_id and tokens, windows has window_id and capacity.
    """
    spark = sizes.sparkSession
    scratch = Scratch(spark, "pack")
    wins = windows.select("window_id", F.col("capacity").cast("long").alias("capacity")).where("window_id IS NOT NULL AND capacity > 0").distinct().limit(MAX_WINDOWS + 1).collect()
    if len(wins) > MAX_WINDOWS:
        raise ValueError(f"more than {MAX_WINDOWS} windows")
    every = F.from_json(F.lit(json.dumps([w.asDict() for w in wins])), "array<struct<window_id:string,capacity:bigint>>")
    sized = scratch.write(sizes.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")), "sizes")
    whole = F.floor(F.col("size") / F.col("capacity")).cast("int")
    rest = F.col("size") % F.col("capacity")
    each = sized.select("doc_id", F.col("tokens").alias("size"), F.inline(every))
    pieces = F.sequence(F.lit(0), F.when((rest == 0) & (whole > 0), whole - 1).otherwise(whole))
    items = each.select("window_id", "capacity", "doc_id", whole.alias("whole"), rest.alias("rest"), F.explode(pieces).alias("piece"))
    full = items.where("piece < whole").select("window_id", F.concat_ws("-", "window_id", F.lit("full"), "doc_id", "piece").alias("bin_id"), "doc_id", "piece", F.col("capacity").alias("tokens"), "capacity")
    loose = items.where("piece = whole").select("window_id", "capacity", "doc_id", "piece", F.col("rest").alias("tokens"))
    done, level = [], 0
    n = sized.count()
    waiting = {r["window_id"]: n for r in wins if n}  # each document leaves one loose piece a window
    while waiting:
        shards = {w: -(-n // shard) for w, n in waiting.items()}
        dealing = F.broadcast(spark.createDataFrame(list(shards.items()), "window_id string, shards int"))
        dealt = loose.join(dealing, "window_id").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), "shards").cast("int")).drop("shards")
        packed = scratch.write(dealt.groupBy("window_id", "shard").applyInPandas(_packer(level, places, cost, tile, rule), _PLACED), f"level{level}")
        poor = (F.col("filled") < F.col("capacity") * again_below) & (F.col("filled") > 0)
        left = {r["window_id"]: r["n"] for r in packed.where(poor).groupBy("window_id").agg(F.count(F.lit(1)).alias("n")).collect()}
        waiting = {w: n for w, n in left.items() if shards[w] > 1 and 8 * n <= 7 * waiting[w]}
        again = poor & F.col("window_id").isin(list(waiting)) if waiting else F.lit(False)
        done.append(packed.where(~again))
        loose = packed.where(again).select("window_id", "capacity", "doc_id", "piece", "tokens")
        level += 1
    out = full
    for d in done:
        out = out.unionByName(d.select("window_id", F.col("bin").alias("bin_id"), "doc_id", "piece", "tokens", "capacity"))
    return out.select("window_id", "bin_id", "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), "tokens")


def fill_report(placed: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_id, capacity, bins, tokens, unused_share): how full the containers are."""
    per = placed.groupBy("window_id", "bin_id").agg(F.sum("tokens").alias("t")).groupBy("window_id").agg(F.count(F.lit(1)).alias("bins"), F.sum("t").alias("tokens"))
    return per.join(F.broadcast(windows.select("window_id", "capacity").distinct()), "window_id").select("window_id", "capacity", "bins", "tokens", (1 - F.col("tokens") / (F.col("bins") * F.col("capacity"))).alias("unused_share"))
