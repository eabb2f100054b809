"""Change feed of working sets, and graph updates by micro-batch, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from arrowlens.operators.graph import Graph, one_row

CHANGES = "set_id string, updated_at timestamp, deleted boolean"
EVENTS = "set_id string, event string, updated_at timestamp"


def feed_batch(changes: DataFrame) -> DataFrame:
    """(set_id, event, updated_at) of a closed log: `updated` whenever updated_at is later than all before it,
    `deleted` once, nothing after it."""
    w = Window.partitionBy("set_id").orderBy("updated_at", "deleted").rowsBetween(Window.unboundedPreceding, -1)
    seen = changes.select("set_id", "updated_at", "deleted", F.max("updated_at").over(w).alias("before"), F.max("deleted").over(w).alias("gone"))
    live = seen.where("NOT coalesce(gone, false)")
    return live.where("deleted OR before IS NULL OR updated_at > before").select("set_id", F.when(F.col("deleted"), "deleted").otherwise("updated").alias("event"), "updated_at")


def feed_stream(changes: DataFrame, heartbeat_ms: int | None = None) -> DataFrame:
    """The same on a stream, with one small state per set: the last updated_at and whether the set is gone.

    With heartbeat_ms a set that saw no change for so long emits `heartbeat`.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, batches, state: GroupState):
        import pandas as pd

        last, gone = state.get if state.exists else (None, False)
        out = []
        if state.hasTimedOut:
            out.append((key[0], "heartbeat", pd.Timestamp(last)))
        else:
            rows = pd.concat(list(batches)).sort_values(["updated_at", "deleted"], kind="stable")
            for at, deleted in zip(rows["updated_at"], rows["deleted"]):
                if gone:
                    break
                if deleted:
                    out.append((key[0], "deleted", at))
                    gone = True
                elif last is None or at.value > last:
                    out.append((key[0], "updated", at))
                last = max(last or at.value, at.value)
        state.update((last, gone))
        if heartbeat_ms and not gone:
            state.setTimeoutDuration(heartbeat_ms)
        yield pd.DataFrame(out, columns=["set_id", "event", "updated_at"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if heartbeat_ms else GroupStateTimeout.NoTimeout
    return changes.groupBy("set_id").applyInPandasWithState(run, EVENTS, "last long, gone boolean", "append", timeout)


def fingerprints(files: DataFrame) -> DataFrame:
    """(file, sha): what of files (file, text) is kept to find changes later."""
    return files.select("file", F.sha2(F.coalesce("text", F.lit("\0")), 256).alias("sha"))


def is_fresh(stored_sha: str | None, sha: str | None) -> bool:
    """Whether a graph stored at a commit needs no ingest at another; an unknown commit always does."""
    return bool(sha) and stored_sha == sha


def changed_files(before: DataFrame, files: DataFrame) -> DataFrame:
    """(file, change): added, changed or deleted against the fingerprints before."""
    now = fingerprints(files).withColumnRenamed("sha", "now")
    both = before.select("file", "sha").join(now, "file", "full_outer")
    change = F.when(F.col("sha").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("sha") != F.col("now"), "changed")
    return both.select("file", change.alias("change")).where("change IS NOT NULL")


def ingest(g: Graph | None, before: DataFrame | None, files: DataFrame, sha: str = "", at: int = 0) -> tuple[Graph, DataFrame]:
    """(graph, fingerprints) after files (file, text): everything without a graph, else only what changed.

    Names of changed files are resolved against everything that is there, so all files are staged (extraction is one
    pass without a shuffle), but only modules that were added, changed or deleted are replaced; manual facts stay.
    """
    from arrowlens.sources.code import build_graph, replace_extracted, stage

    whole = build_graph(stage(files), sha, at)
    marks = fingerprints(files)
    if g is None:
        return whole, marks
    if before is None:
        return replace_extracted(g, whole), marks
    changes = changed_files(before, files).select(F.col("file").alias("module"))
    fresh = whole.elem.join(changes, "module", "left_semi").select(whole.elem.columns)
    return merged(g, changes, fresh, whole.arr, sha, at), marks


def merge_each(batches: DataFrame, merge: Callable[[DataFrame], None], checkpoint: str):
    """Starts a stream that hands every micro-batch of changed files to `merge` (exactly one batch at a time)."""
    return batches.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: merge(df)).trigger(availableNow=True).start()


def merged(g: Graph, changed_modules: DataFrame, elem: DataFrame, arr: DataFrame, sha: str = "", at: int = 0) -> Graph:
    """The graph after the elements and arrows extracted from changed modules replace the extracted ones before.

    Elements with a provenance source other than tree-sitter stay. Arrows between unchanged modules stay, and so do
    arrows into changed modules whose end is extracted again, so that this equals a full extraction.
    """
    manual = g.prov.where("source <> 'tree-sitter'").select(F.col("elem_id").alias("id")).distinct()
    stale = g.elem.join(changed_modules.select("module").distinct(), "module", "left_semi").join(manual, "id", "left_anti").select("id")
    kept = g.elem.join(stale, "id", "left_anti").select(g.elem.columns)
    fresh = one_row(elem.join(kept.select("id"), "id", "left_anti").select(g.elem.columns))
    all_elem = kept.unionByName(fresh)
    ids = all_elem.select("id")
    old = g.arr.join(stale.withColumnRenamed("id", "src_id"), "src_id", "left_anti").select(g.arr.columns)
    new = one_row(arr.join(old.select("id"), "id", "left_anti").select(g.arr.columns))
    a = old.unionByName(new).join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
    prov = g.prov.join(ids.withColumnRenamed("id", "elem_id"), "elem_id", "left_semi").select(g.prov.columns)
    known = fresh.select(F.col("id").alias("elem_id"), F.lit("tree-sitter").alias("source"), F.lit(sha).alias("commit_sha"), F.lit(at).cast("long").alias("ingested_at"), F.lit("resolved").alias("confidence"))
    return Graph(all_elem, a.select(g.arr.columns), prov.unionByName(known.join(prov.select("elem_id"), "elem_id", "left_anti").select(prov.columns)))
