"""What changed between consecutive full snapshots.

Each record is unpivoted into cells (key, field, value) plus a marker that the key is present; in the pair of two
consecutive snapshots the earlier one's cells count -1 and the later one's +1. Sums that are not zero classify a key:
marker +1 added, marker -1 removed, marker 0 with another sum left over changed, in those fields.

Values travel as 64-bit hashes: two values are compared within one key and field only, so that a wrong "unchanged"
has a chance of 2^-64 for each comparison. The deciding delivery of each (snapshot, key) is chosen first with partial
aggregation, so that a key delivered very often reaches one task as one row; the narrow rows are then partitioned by
key once, and unpivoting, summing and classifying all stay within that partitioning.

Defined results: rows without id, or whose commit is unknown or abbreviated so far that several commits fit, make no
record. Deliveries with equal times are decided by the greater field hashes. Commits with equal committed_at are
ordered by sha. Extra columns are ignored. A snapshot without rows removes all keys of the one before.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from arrowlens.functions.text import canonical_json, span_numbers, trim_blank, value_hash
from arrowlens.runtime import shuffle_partitions

#: The log is read to the driver to order it; more commits than this are an error.
MAX_COMMITS = 10_000


def commit_order(log: DataFrame) -> list[tuple[str, int]]:
    """(full sha in lower case, least length at which an abbreviation is unique), ordered by committed_at, sha."""
    rows = log.select(F.lower(trim_blank(F.col("commit_sha"))).alias("sha"), F.col("committed_at").alias("at")).where("sha is not null").groupBy("sha").agg(F.min("at").alias("at")).limit(MAX_COMMITS + 1).collect()
    if len(rows) > MAX_COMMITS:
        raise ValueError(f"more than {MAX_COMMITS} commits")
    shas = [r["sha"] for r in sorted(rows, key=lambda r: (r["at"] is not None, r["at"], r["sha"]))]
    near = sorted(shas)
    shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    need = {s: 1 + max([0, *(shared(s, near[j]) for j in (i - 1, i + 1) if 0 <= j < len(near))]) for i, s in enumerate(near)}
    return [(s, need[s]) for s in shas]


def default_fields() -> dict[str, Column]:
    return {
        "kind": F.col("kind"),
        "name": F.col("name"),
        "module": F.col("module"),
        "span": span_numbers(F.col("span")),
        "attrs": canonical_json(F.col("attrs")),
    }


def snapshot_changes(snaps: DataFrame, log: DataFrame, fields: Mapping[str, Column] | None = None, key: str = "id", commit: str = "commit_sha", delivered: str = "delivered_at") -> DataFrame:
    """(commit_sha, elem_id, change_kind, changed_fields): added, removed or changed against the commit before.

    commit_sha is the later commit in full; changed_fields is sorted, and null for added and removed.
    """
    fields = dict(fields or default_fields())
    names = list(fields)
    commits = commit_order(log)
    spark = snaps.sparkSession
    order = spark.createDataFrame([(s, i) for i, (s, _) in enumerate(commits)], "sha string, at int")
    spelt = spark.createDataFrame([(s[:n], i) for i, (s, need) in enumerate(commits) for n in range(need, len(s) + 1)], "given string, at int")
    sha = F.lower(trim_blank(F.col(commit)))
    rows = snaps.select(F.col(key).alias("id"), sha.alias("given"), F.col(delivered).alias("delivered"), *(value_hash(c).alias(f"f{i}") for i, c in enumerate(fields.values()))).where("id is not null")
    placed = rows.join(F.broadcast(spelt), "given")
    held = [f"f{i}" for i in range(len(names))]
    records = placed.groupBy("id", "at").agg(F.max(F.struct("delivered", *held)).alias("m")).select("id", "at", *(f"m.{h}" for h in held))

    together = records.repartition(shuffle_partitions(spark), "id")
    sides = F.array(F.struct(F.col("at").alias("pair"), F.lit(1).alias("sign")), F.struct((F.col("at") + 1).alias("pair"), F.lit(-1).alias("sign")))
    signed = together.select("id", *held, F.inline(sides)).where((F.col("pair") > 0) & (F.col("pair") < len(commits)))
    cells = F.array(F.struct(F.lit(-1).alias("field"), F.lit(0).cast("long").alias("value")), *(F.struct(F.lit(i).alias("field"), F.col(h).alias("value")) for i, h in enumerate(held)))
    sums = signed.select("id", "pair", "sign", F.inline(cells)).groupBy("id", "pair", "field", "value").agg(F.sum("sign").alias("left")).where("left != 0")
    classed = sums.groupBy("id", "pair").agg(F.sum(F.when(F.col("field") == -1, F.col("left")).otherwise(0)).alias("marker"), F.sort_array(F.collect_set(F.when(F.col("field") >= 0, F.col("field")))).alias("which"))
    labels = F.array(*(F.lit(n) for n in names))
    kind = F.when(F.col("marker") > 0, "added").when(F.col("marker") < 0, "removed").otherwise("changed")
    return classed.join(F.broadcast(order.select(F.col("at").alias("pair"), "sha")), "pair").select(
        F.col("sha").alias("commit_sha"),
        F.col("id").alias("elem_id"),
        kind.alias("change_kind"),
        F.when(F.col("marker") == 0, F.sort_array(F.transform("which", lambda i: F.get(labels, i)))).alias("changed_fields"),
    )
