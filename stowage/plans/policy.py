"""Policies over candidate recommendations: safe target, role-aware target, contradictions; then evidence and next steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import EVIDENCE, _flat
from ..tables import landed, temporary

SAFE, ROLE, AGAIN = "safe_target_policy", "role_aware_target_policy", "contradiction_detector"
COLD_ROLES = ("media_library", "archive", "backup_target")
PLACEMENT = "active-workload-placement"


def judge(recs: DataFrame, disks: DataFrame) -> DataFrame:
    """recs (scan_id, pos, id, target_mount, policy_rules_applied, ...) with policy_safe, blocked_by (null if allowed),
    decisions (array in order) and policy_rules_blocked.  Disks are looked up by mount: the last of equals counts."""
    last = F.row_number().over(W.partitionBy("scan_id", "mount_point").orderBy(F.desc("pos")))
    d = disks.withColumn("_n", last).where("_n = 1").select("scan_id", F.col("mount_point").alias("target_mount"), F.col("eligible_for_local_target").alias("_ok"),
                                                             F.col("ineligible_reasons").alias("_why"), F.col("role").alias("_role"), F.lit(True).alias("_found"))
    r = recs.join(d, ["scan_id", "target_mount"], "left")
    has = F.col("target_mount").isNotNull()
    safe = F.when(~has, True).otherwise(F.coalesce(F.col("_found") & F.col("_ok"), F.lit(False)))
    looked = has & safe & (F.col("id") == PLACEMENT)
    fits = ~F.coalesce(F.col("_role").isin(*COLD_ROLES), F.lit(False))
    act = lambda ok: F.when(ok, "allowed").otherwise("blocked")
    why = (F.when(~has, "no target").when(F.col("_found").isNull(), F.concat(F.lit("target not found: "), "target_mount"))
           .when(F.col("_ok"), "target may be used").otherwise(F.concat(F.lit("target not eligible: "), F.array_join("_why", " | "))))
    first = F.struct(F.lit(SAFE).alias("policy_id"), act(safe).alias("action"), why.alias("rationale"))
    second = F.when(looked, F.struct(F.lit(ROLE).alias("policy_id"), act(fits).alias("action"), F.concat(F.lit("target role "), F.coalesce("_role", F.lit("unknown"))).alias("rationale")))
    out = r.withColumn("decisions", F.array_compact(F.array(first, second)))
    blocked = F.filter("decisions", lambda x: x["action"] == "blocked")
    return out.withColumns({
        "policy_safe": F.size(blocked) == 0, "blocked_by": F.try_element_at(blocked, F.lit(1))["policy_id"], "blocked_why": F.try_element_at(blocked, F.lit(1))["rationale"],
        "policy_rules_applied": F.concat("policy_rules_applied", F.transform(F.filter("decisions", lambda x: x["action"] == "allowed"), lambda x: x["policy_id"])),
        "policy_rules_blocked": F.transform(blocked, lambda x: x["policy_id"]),
    }).drop("_ok", "_why", "_role", "_found")


def enforce(recs: DataFrame, disks: DataFrame) -> dict[str, DataFrame]:
    """recommendations (kept), policy_decisions, rejection_traces, contradictions (scan_id, contradiction_count)."""
    judged = judge(recs, disks)
    again = F.row_number().over(W.partitionBy("scan_id", "id").orderBy("pos"))
    safe = judged.where("policy_safe").withColumn("_n", again)
    kept = safe.where("_n = 1").drop("_n", "decisions", "blocked_by", "blocked_why")
    double = safe.where("_n > 1")
    note = F.lit("an earlier recommendation has this id")
    decided = judged.select("scan_id", "pos", F.posexplode("decisions").alias("k", "d"), F.col("id").alias("recommendation_id")).select(
        "scan_id", "pos", "k", F.col("d.policy_id").alias("policy_id"), "recommendation_id", F.col("d.action").alias("action"), F.col("d.rationale").alias("rationale"))
    decided = decided.unionByName(double.select("scan_id", (F.col("pos") + 1_000_000).alias("pos"), F.lit(0).alias("k"), F.lit(AGAIN).alias("policy_id"), F.col("id").alias("recommendation_id"),
                                                F.lit("blocked").alias("action"), note.alias("rationale")))
    refused = judged.where(~F.col("policy_safe")).select("scan_id", "pos", F.col("blocked_by").alias("rule_id"), F.lit("rejected").alias("status"), F.col("blocked_why").alias("detail"),
                                                        F.col("id").alias("recommendation_id"))
    refused = refused.unionByName(double.select("scan_id", (F.col("pos") + 1_000_000).alias("pos"), F.lit(AGAIN).alias("rule_id"), F.lit("rejected").alias("status"), note.alias("detail"),
                                                F.col("id").alias("recommendation_id")))
    return {"recommendations": kept, "policy_decisions": decided, "rejection_traces": refused,
            "contradictions": double.groupBy("scan_id").agg(F.count(F.lit(1)).alias("contradiction_count"))}


def _item(kind: str, label: str, detail, path=None, mount=None, digest=None):
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    return F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), detail.alias("detail"), text(path).alias("path"), text(mount).alias("mount_point"), text(digest).alias("duplicate_hash"))


def enrich(recs: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """recs with evidence (only where it has none) and next_steps.  Each piece of evidence is one row a scan or mount
    found before the join: first or last as the order of the report says."""
    s = ["scan_id"]
    disks, dirs = t["disks"], t["path_directories"]
    disk = disks.groupBy("scan_id", F.col("mount_point").alias("target_mount")).agg(F.min_by(_item(
        "disk", "Target disk", F.concat_ws(" | ", "name", F.concat(F.lit("role "), "role"), F.concat(F.lit("locality "), "locality_class"), F.concat(F.lit("performance "), "performance_class")),
        mount=F.col("mount_point")), "pos").alias("_disk"))
    g = t["duplicate_groups"].where(F.col("intent") == "likely_redundant")
    group = g.groupBy(*s).agg(F.max_by(_item(
        "duplicate_group", "Largest redundant group", F.concat(F.col("file_count").cast("string"), F.lit(" files, "), F.col("total_wasted_bytes").cast("string"), F.lit(" bytes wasted")),
        F.col("first_file.path"), F.col("first_file.disk_mount"), F.col("hash")), F.struct("total_wasted_bytes", "pos", -F.col("file_count"), -F.col("size_bytes"), "hash")).alias("_group"))
    where = F.struct("size_bytes", "path_pos", "pos")
    directory = dirs.groupBy(*s).agg(F.max_by(_item("directory", "Largest directory", F.concat(F.col("size_bytes").cast("string"), F.lit(" bytes")), F.col("path")), where).alias("_dir"))
    out_of = disks.where(~F.col("eligible_for_local_target")).withColumn("_n", F.row_number().over(W.partitionBy(*s).orderBy("pos"))).where("_n <= 2")
    excluded = out_of.groupBy(*s).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", _item(
        "disk", "Left out as target", F.array_join("ineligible_reasons", " | "), mount=F.col("mount_point")).alias("e")))), lambda x: x["e"]).alias("_excluded"))
    paths = t["paths"].withColumn("_n", F.row_number().over(W.partitionBy("scan_id", "disk_mount").orderBy("pos"))).where("_n = 1")
    first_dir = dirs.where(F.col("pos") == 0).select("scan_id", "path_pos", F.col("path").alias("_p"), F.col("size_bytes").alias("_b"))
    root = paths.select("scan_id", F.col("pos").alias("path_pos"), F.col("disk_mount").alias("_mount")).join(first_dir, ["scan_id", "path_pos"]).select(
        F.col("scan_id").alias("_scan"), "_mount", _item("directory", "Largest directory of a root there", F.concat(F.col("_b").cast("string"), F.lit(" bytes")), F.col("_p"), F.col("_mount")).alias("_root"))
    warning = t["warnings"].groupBy(*s).agg(F.min_by(_item("warning", "Scan warning", F.col("text")), "pos").alias("_warning")) if "warnings" in t else None
    r = recs.join(disk, ["scan_id", "target_mount"], "left")
    for part in (group, directory, excluded, warning):
        r = r if part is None else r.join(part, s, "left")
    # a recommendation without a target meets a root without a mount
    r = r.join(root, (F.col("scan_id") == F.col("_scan")) & F.col("target_mount").eqNullSafe(F.col("_mount")), "left")
    history = F.col("id").rlike("^(disk|path)-growth-")
    one = F.array_compact(F.array(F.col("_disk"), F.when(F.col("id").contains("duplicate"), F.col("_group")), F.when(F.startswith("id", F.lit("cleanup-")), F.col("_dir")),
                                  F.when(history, _item("history_delta", "Change since the last snapshot", F.col("rationale"), mount=F.col("target_mount")))))
    cloud = F.when(F.col("id").contains("cloud") & F.col("_excluded").isNotNull(), F.col("_excluded")).otherwise(F.array().cast(f"array<{_flat(EVIDENCE)}>"))
    two = F.array_compact(F.array(F.col("_root"), F.col("_warning") if warning is not None else F.lit(None).cast(_flat(EVIDENCE))))
    every = F.concat(one, cloud, two)
    fallback = F.array(_item("other", "Why the rule fired", F.col("rationale"), mount=F.col("target_mount")))
    found = F.when(F.size(every) > 0, every).otherwise(fallback)
    steps = (F.when(F.col("id") == PLACEMENT, F.array(F.lit("Check that the target has room."), F.lit("Look at the move by hand first.")))
             .when(F.col("id") == "backup-gap", F.array(F.lit("Make sure that a second copy exists."), F.lit("Use a backup or archive disk for it.")))
             .when(F.col("id").contains("duplicate"), F.array(F.lit("Pick the copy that counts."), F.lit("Export diagnostics for the whole group.")))
             .when(F.startswith("id", F.lit("cleanup-")), F.array(F.lit("Look at the paths named."), F.lit("Use the tool's own clean command.")))
             .otherwise(F.array(F.lit("Look at the evidence."), F.lit("Export diagnostics to compare."))))
    kept_e = F.when(F.size("evidence") > 0, F.col("evidence")).otherwise(found) if "evidence" in recs.columns else found
    kept_s = F.when(F.size("next_steps") > 0, F.col("next_steps")).otherwise(steps) if "next_steps" in recs.columns else steps
    return r.withColumns({"evidence": kept_e, "next_steps": kept_s}).drop("_disk", "_group", "_dir", "_excluded", "_root", "_warning", "_scan", "_mount")


#: Tables that many rules read; a row a disk, root, retained directory, suggestion or duplicate group.
SHARED = ("disks", "paths", "path_directories", "categories", "duplicate_groups")


def settled(t: dict[str, DataFrame], small: bool = False) -> dict[str, DataFrame]:
    """t with the shared tables written once they are made: else each rule would work them out again.  They go when the
    driver ends, and nothing is cached."""
    from .rules import scores

    if small:
        return t | {"scores": landed(scores(t))}
    t = t | {k: temporary(t[k], k) for k in SHARED if k in t}
    return t | {"scores": temporary(scores(t), "scores")}


def recommend(t: dict[str, DataFrame], rules=None, small: bool = False) -> dict[str, DataFrame]:
    """The bundle: recommendations, rule_traces, policy_decisions, contradictions.  History is part of t, never read from
    the machine.  small: t is of one scan and its tables (but for duplicate groups) are local ones, so scores and
    candidates, a row a disk or rule, are made local too."""
    from . import rules as r

    rules = rules or r.RULES
    t = settled(t, small)
    cand = r.candidates(t, rules)
    cand = landed(cand) if small else temporary(cand, "candidates")
    out = enforce(cand, t["disks"])
    ran = r.traces(t, cand, rules).select("scan_id", F.col("rule_pos").cast("bigint").alias("a"), F.coalesce("pos", F.lit(0)).cast("bigint").alias("b"), "rule_id", "status", "detail", "recommendation_id", "confidence")
    refused = out["rejection_traces"].select("scan_id", F.lit(1_000).cast("bigint").alias("a"), F.col("pos").cast("bigint").alias("b"), "rule_id", "status", "detail", "recommendation_id", F.lit(None).cast("double").alias("confidence"))
    order = W.partitionBy("scan_id").orderBy("a", "b")
    traces = ran.unionByName(refused).withColumn("pos", F.row_number().over(order) - 1).drop("a", "b")
    return {"recommendations": enrich(out["recommendations"], t), "rule_traces": traces, "policy_decisions": out["policy_decisions"], "contradictions": out["contradictions"]}
