"""Review sessions of proposed concepts and motifs: rows of a table, each action gives new rows.

A session is (id, kind, status, scope_regex, candidates, created_at, updated_at); candidates is an array of
(id, code_id, name, status, arrows array<struct<name, dst, status, total>>). Actions touch active sessions only.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from arrowlens.operators import domain
from arrowlens.operators.graph import Graph

ARROWS = "array<struct<name:string,dst:string,status:string,total:boolean>>"
CANDIDATES = f"array<struct<id:string,code_id:string,name:string,status:string,arrows:{ARROWS}>>"
SESSIONS = f"id string, kind string, status string, scope_regex string, candidates {CANDIDATES}, created_at long, updated_at long"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SESSIONS)


def start(sessions: DataFrame, kind: str, candidates: DataFrame, at: int, scope: str | None = None) -> tuple[DataFrame, str]:
    """(sessions with a new active one, its id). candidates: (id, code_id, name, status, arrows)."""
    sid = hashlib.sha256(f"{kind}\0{scope}\0{at}".encode()).hexdigest()[:32]
    packed = candidates.select(F.struct("id", "code_id", "name", "status", F.col("arrows").cast(ARROWS).alias("arrows")).alias("c")).agg(F.array_sort(F.collect_list("c")).cast(CANDIDATES).alias("candidates"))
    row = packed.select(F.lit(sid).alias("id"), F.lit(kind).alias("kind"), F.lit("active").alias("status"), F.lit(scope).cast("string").alias("scope_regex"), "candidates", F.lit(at).cast("long").alias("created_at"), F.lit(at).cast("long").alias("updated_at"))
    return sessions.unionByName(row), sid


def discovered(g: Graph, scope: str | None = None) -> DataFrame:
    """(id, code_id, name, status, arrows): what type-driven discovery proposes, as candidates of a session."""
    cand = domain.candidates(g, scope=scope).select(F.col("candidate").alias("id"), F.col("candidate").alias("code_id"), F.col("phrase").alias("name"), F.lit("proposed").alias("status"))
    arrows = domain.field_arrows(g, scope=scope).groupBy(F.col("candidate").alias("id")).agg(F.array_sort(F.collect_list(F.struct("name", F.col("codomain").alias("dst"), F.lit("proposed").alias("status"), "total"))).alias("arrows"))
    return cand.join(arrows, "id", "left").withColumn("arrows", F.coalesce("arrows", F.array().cast(ARROWS)))


def candidates_of(sessions: DataFrame, sid: str) -> DataFrame:
    return sessions.where(F.col("id") == sid).select(F.inline("candidates"))


def summaries(sessions: DataFrame) -> DataFrame:
    """(id, kind, status, proposed, accepted, rejected, arrows), latest first: candidates by status and proposed arrows."""
    n = lambda s: F.size(F.filter("candidates", lambda c: c["status"] == s)).alias(s)
    arrows = F.aggregate("candidates", F.lit(0), lambda a, c: a + F.coalesce(F.size(c["arrows"]), F.lit(0)))
    return sessions.select("id", "kind", "status", n("proposed"), n("accepted"), n("rejected"), arrows.alias("arrows"), "updated_at").orderBy(F.desc("updated_at"), "id")


def _is_active(sessions: DataFrame, sid: str) -> None:
    row = sessions.where(F.col("id") == sid).select("status").first()
    if row is None or row["status"] != "active":
        raise ValueError(f"no active session {sid}")


def refine(sessions: DataFrame, sid: str, responses: DataFrame, at: int) -> DataFrame:
    """Candidates after responses (id, status, name_override, arrows): new status and name, arrows with the status and
    total that an override of the same name gives, none to rejected candidates."""
    _is_active(sessions, sid)
    kept = domain.refine(candidates_of(sessions, sid), responses)
    packed = kept.select(F.struct("id", "code_id", "name", "status", F.col("arrows").cast(ARROWS).alias("arrows")).alias("c")).agg(F.array_sort(F.collect_list("c")).cast(CANDIDATES).alias("now")).withColumn("id", F.lit(sid))
    out = sessions.join(packed, "id", "left").withColumn("candidates", F.coalesce("now", "candidates")).withColumn("updated_at", F.when(F.col("id") == sid, F.lit(at)).otherwise(F.col("updated_at")))
    return out.select(sessions.columns)


def commit(sessions: DataFrame, sid: str, g: Graph, at: int) -> tuple[DataFrame, Graph]:
    """(sessions, graph) with what the accepted candidates add; a session without any is refused."""
    _is_active(sessions, sid)
    mine = candidates_of(sessions, sid)
    if mine.where("status = 'accepted'").isEmpty():
        raise ValueError("no accepted candidate")
    elem, arr = domain.commit(g, mine)
    prov = elem.select(F.col("id").alias("elem_id"), F.lit("session").alias("source"), F.lit("").alias("commit_sha"), F.lit(at).cast("long").alias("ingested_at"), F.lit("resolved").alias("confidence"))
    new_e = elem.join(g.elem.select("id"), "id", "left_anti").select(g.elem.columns)
    new_a = arr.join(g.arr.select("id"), "id", "left_anti").select(g.arr.columns)
    done = sessions.withColumn("status", F.when(F.col("id") == sid, "committed").otherwise(F.col("status"))).withColumn("updated_at", F.when(F.col("id") == sid, F.lit(at)).otherwise(F.col("updated_at")))
    return done, Graph(g.elem.unionByName(new_e), g.arr.unionByName(new_a), g.prov.unionByName(prov.select(g.prov.columns)))


def motif_templates(candidates: DataFrame, accepted: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """(templates, instances) of accepted shapes (shape_hash): templates (id, name, description, created_at) and
    instances (id, template_id, seed, mapping). candidates is the result of motifs.candidates."""
    ok = candidates.join(accepted.select("shape_hash").distinct(), "shape_hash", "left_semi")
    templates = ok.groupBy("shape_hash").agg(F.min("name").alias("name"), F.min("description").alias("description")).select(F.concat(F.lit("motif:"), "shape_hash").alias("id"), "name", "description", F.lit(at).cast("long").alias("created_at"))
    rows = ok.select(F.concat_ws(":", F.lit("motif"), "shape_hash", "seed").alias("id"), F.concat(F.lit("motif:"), "shape_hash").alias("template_id"), "seed", "mapping")
    return templates, rows
