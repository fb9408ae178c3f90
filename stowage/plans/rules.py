"""The recommendation rules, each over all scans at once, and their traces.

`t` is a dict of tables: scans (scan_id), disks (enriched, with role and performance_rank), paths, path_directories,
categories, duplicate_groups; optional disk_snapshots, path_snapshots, cache_targets.  A rule returns rows of COLUMNS;
rule_pos is its place in RULES and pos the order within the rule, so "first" and "last" mean what they meant in a list.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import clamped_confidence, dashed_id, human_bytes, human_days
from ..operators.classify import score_pivot
from ..operators.duplicates import redundant_waste
from ..tables import local_table
from . import trend

GIB = 1 << 30
COLUMNS = ("scan_id", "pos", "id", "title", "rationale", "confidence", "target_mount", "space_saving_bytes", "performance", "risk_notes", "risk_level")
SAFE = "safe_target_policy"


def _rec(rows: DataFrame, *, id: Column, title: str, rationale: Column, confidence: Column, risk: str, target: Column | None = None,  # noqa: A002
         saving: Column | None = None, pos: Column | None = None, performance: str | None = None, risk_notes: str | None = None) -> DataFrame:
    none = F.lit(None)
    return rows.select(
        "scan_id", (F.lit(0) if pos is None else pos).cast("bigint").alias("pos"), id.alias("id"), F.lit(title).alias("title"), rationale.alias("rationale"),
        confidence.cast("double").alias("confidence"), (none if target is None else target).cast("string").alias("target_mount"),
        (none if saving is None else saving).cast("bigint").alias("space_saving_bytes"), F.lit(performance).cast("string").alias("performance"),
        F.lit(risk_notes).cast("string").alias("risk_notes"), F.lit(risk).alias("risk_level"))


def eligible(disks: DataFrame) -> DataFrame:
    """Local physical disks that may be a target and do not hold the operating system."""
    return disks.where(F.col("eligible_for_local_target") & ~F.col("is_os_drive") & (F.col("locality_class") == "local_physical"))


def scores(t: dict[str, DataFrame]) -> DataFrame:
    if "scores" in t:
        return t["scores"]
    return score_pivot(t["categories"], t["disks"].select("scan_id", "pos", "mount_point")).withColumnRenamed("disk_mount", "mount_point")


def _with_scores(disks: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    cols = ("games", "work", "media", "archive", "backup")
    plain = disks.drop(*cols)
    return plain.join(scores(t), ["scan_id", "mount_point"], "left").withColumns({c: F.round(F.coalesce(c, F.lit(0.0)), 6) for c in cols})


def _first(rows: DataFrame, *order) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("scan_id").orderBy(*order))).where("_n = 1").drop("_n")


def observed_bytes(paths: DataFrame) -> DataFrame:
    return paths.where(F.col("disk_mount").isNotNull()).groupBy("scan_id", F.col("disk_mount").alias("mount_point")).agg(F.sum("total_size_bytes").alias("observed_bytes"))


def coverage(disks: DataFrame, paths: DataFrame, least: float = 0.35) -> DataFrame:
    """disks with observed_bytes, coverage (null without scanned bytes or used space) and covered."""
    d = disks.join(observed_bytes(paths), ["scan_id", "mount_point"], "left")
    share = F.when((F.col("used_bytes") > 0) & F.col("observed_bytes").isNotNull(), F.col("observed_bytes") / F.col("used_bytes"))
    return d.withColumn("coverage", share).withColumn("covered", F.coalesce(F.col("coverage") >= least, F.lit(False)))


def fastest(disks: DataFrame) -> DataFrame:
    """The eligible disk with the highest rank in each scan; of equals the last."""
    return _first(eligible(disks).withColumn("_r", F.round("performance_rank", 6)), F.desc("_r"), F.desc("pos")).drop("_r")


def active_workload_placement(t):
    best = fastest(t["disks"]).select("scan_id", F.col("mount_point").alias("_target"), F.col("performance_rank").alias("_rank"))
    d = _with_scores(eligible(t["disks"]), t).join(best, "scan_id")  # one row a scan
    active, cold = F.col("work") + F.col("games"), F.col("media") + F.col("archive")
    d = d.withColumns({"_active": active, "_cold": cold}).where(
        (F.col("mount_point") != F.col("_target")) & (F.col("performance_rank") < F.col("_rank")) & (F.col("_active") > F.col("_cold") + 0.25))
    d = d.withColumn("_score", F.round(F.col("_active") - F.col("_cold") + F.col("_rank") - F.col("performance_rank"), 6))
    return _rec(_first(d, F.desc("_score"), "pos"), id=F.lit("active-workload-placement"), title="Keep active data on the fastest disk",
                rationale=F.concat(F.lit("Games or work data sits on "), "mount_point", F.lit(", which is slower than "), "_target", F.lit(".")),
                confidence=clamped_confidence(F.col("_score")), target=F.col("_target"), risk="low", performance="Faster access to active data.")


def consolidation_pair(d: DataFrame, least: int = 50 * GIB) -> DataFrame:
    """d: scan_id, mount_point, pos, used_bytes, free_space_bytes, performance_rank, _active, _cold.  For each scan the
    first pair (s_ and t_ columns) of a source by falling used bytes and pos, and a target by pos, where the target has
    room for 1.25 times the source and the move does not put active data on a cold disk that is no faster.  A mount that is
    listed twice counts as its last row.

    No disks are paired to find it.  Which targets a source may have depends on its class: all, or, for an active source,
    those that are not cold and the cold ones of a higher rank.  So the most room that a source can find is the most free
    space of another disk (of all, or of those not cold), and a running maximum over cold disks by falling rank; the first
    source that it is enough for meets the disks of its scan once."""
    w = W.partitionBy("scan_id")
    d = d.withColumn("_n", F.row_number().over(W.partitionBy("scan_id", "mount_point").orderBy(F.desc("pos")))).where("_n = 1").drop("_n")
    d = d.withColumns({"_hot": F.col("_active") > F.col("_cold") + 0.25, "_still": F.col("_cold") > F.col("_active") + 0.25})
    room = F.struct("free_space_bytes", "mount_point")
    first = lambda c: F.max(F.when(c, room))
    tops = d.groupBy("scan_id").agg(first(F.lit(True)).alias("_any"), first(~F.col("_still")).alias("_warm"))
    d = d.join(tops, "scan_id")  # one row a scan
    most = lambda top, c: F.when(F.col(f"{top}.mount_point") != F.col("mount_point"), F.col(f"{top}.free_space_bytes")).otherwise(
        F.max(F.when(c & (F.col("mount_point") != F.col(f"{top}.mount_point")), F.col("free_space_bytes"))).over(w))
    by_rank = d.where("_still").groupBy("scan_id", "performance_rank").agg(F.max("free_space_bytes").alias("_free"))
    ranks = d.select("scan_id", "performance_rank").distinct().join(by_rank, ["scan_id", "performance_rank"], "left")
    faster = F.max("_free").over(w.orderBy(F.desc("performance_rank")).rowsBetween(W.unboundedPreceding, -1))
    d = d.join(ranks.withColumn("_faster", faster).drop("_free"), ["scan_id", "performance_rank"], "left")
    d = d.withColumns({"_most_any": most("_any", F.lit(True)), "_most_warm": most("_warm", ~F.col("_still"))})
    need = F.floor(F.col("used_bytes") * 1.25)
    found = F.when(F.col("_hot"), F.greatest("_most_warm", "_faster")).otherwise(F.col("_most_any"))  # greatest leaves nulls out
    cols = ["mount_point", "pos", "used_bytes", "free_space_bytes", "performance_rank", "_hot", "_still"]
    s = _first(d.where((F.col("used_bytes") >= least) & (found > need)), F.desc("used_bytes"), "pos").select("scan_id", *(F.col(c).alias(f"s_{c}") for c in cols))
    p = d.select("scan_id", *(F.col(c).alias(f"t_{c}") for c in cols)).join(s, "scan_id")  # one row a scan
    inverted = F.col("s__hot") & F.col("t__still") & (F.col("t_performance_rank") <= F.col("s_performance_rank"))
    fits = (F.col("s_mount_point") != F.col("t_mount_point")) & ~inverted & (F.col("t_free_space_bytes") > F.floor(F.col("s_used_bytes") * 1.25))
    return _first(p.where(fits), "t_pos")


def consolidation_opportunity(t):
    d = coverage(_with_scores(eligible(t["disks"]), t), t["paths"]).where("covered").withColumns({
        "_active": F.col("work") + F.col("games"), "_cold": F.col("media") + F.col("archive") + F.col("backup")})
    return _rec(consolidation_pair(d), id=F.lit("consolidation-opportunity"), title="One disk could be emptied into another",
                rationale=F.concat("s_mount_point", F.lit(" uses "), human_bytes(F.col("s_used_bytes")), F.lit(", which fits on "), "t_mount_point", F.lit(".")),
                confidence=F.lit(0.74), target=F.col("t_mount_point"), saving=F.col("s_used_bytes"), risk="medium", risk_notes="Check a backup before moving data.")


def low_space(disks: DataFrame, ratio: float = 0.12) -> DataFrame:
    return disks.where(F.col("locality_class").isin("local_physical", "unknown") & (F.col("total_space_bytes") > 0) & (F.col("free_space_bytes") / F.col("total_space_bytes") <= ratio))


def risky_disk(t):
    d = _with_scores(low_space(t["disks"]), t)
    d = d.where((F.round(F.col("work") + F.col("games") + F.col("media"), 6) >= 0.8) & (F.col("backup") < 0.6))
    share = F.format_string("%.1f%%", F.col("free_space_bytes") / F.col("total_space_bytes") * 100)
    return _rec(d, id=F.concat(F.lit("risky-disk-"), dashed_id(F.col("mount_point"))), title="Important data on a disk that is nearly full",
                rationale=F.concat("mount_point", F.lit(" has "), share, F.lit(" left and no sign of a backup.")), confidence=F.lit(0.82), risk="high", pos=F.col("pos"),
                risk_notes="Data may be lost if the disk fills up.")


def backup_gap(t):
    os_mount = _first(t["disks"].where("is_os_drive"), "pos").select("scan_id", "mount_point")
    looked_at = eligible(t["disks"]).select("scan_id", "mount_point").unionByName(os_mount).distinct()
    has = scores(t).join(looked_at, ["scan_id", "mount_point"], "left_semi").groupBy("scan_id").agg(
        F.bool_or(F.round("work", 6) >= 0.5).alias("has_work"), F.bool_or(F.round("backup", 6) >= 0.5).alias("has_backup"))
    return _rec(has.where(F.col("has_work") & ~F.col("has_backup")), id=F.lit("backup-gap"), title="Work data without a backup",
                rationale=F.lit("There is work data on local disks, and nothing looks like a backup of it."), confidence=F.lit(0.8), risk="high")


def duplicate_cleanup(t):
    return _rec(redundant_waste(t["duplicate_groups"]), id=F.lit("duplicate-cleanup-candidate"), title="Redundant copies take up space",
                rationale=F.concat(F.lit("Redundant copies hold "), human_bytes(F.col("wasted_bytes")), F.lit(".")), confidence=F.lit(0.7), saving=F.col("wasted_bytes"),
                risk="medium", risk_notes="Look at each group before anything is removed.")


def os_headroom(t, ratio: float = 0.15):
    d = _with_scores(_first(t["disks"].where("is_os_drive"), "pos"), t)
    d = d.where((F.col("total_space_bytes") > 0) & (F.col("free_space_bytes") / F.col("total_space_bytes") < ratio))
    cold = F.round(F.col("media") + F.col("archive"), 6)
    return _rec(d, id=F.lit("os-headroom"), title="The system disk runs out of room",
                rationale=F.concat("mount_point", F.lit(" has "), F.format_string("%.1f%%", F.col("free_space_bytes") / F.col("total_space_bytes") * 100), F.lit(" left.")),
                confidence=F.when(cold > 0.6, 0.86).otherwise(0.72), risk="high")


def cloud_exclusion_notice(t):
    d = t["disks"].where(F.col("locality_class") == "cloud_backed").groupBy("scan_id").agg(F.array_join(F.array_sort(F.collect_list("mount_point")), ", ").alias("_m"))
    return _rec(d, id=F.lit("cloud-backed-target-exclusion"), title="Cloud drives are no local targets",
                rationale=F.concat(F.lit("Left out as targets: "), "_m"), confidence=F.lit(0.95), risk="low")


def build_artifacts(directories: DataFrame) -> DataFrame:
    """Bytes of retained directories called node_modules or target, by scan."""
    name = F.element_at(F.split(F.translate("path", "\\", "/"), "/"), -1)
    kind = F.when(name == "node_modules", "node_modules").when(name == "target", "target")
    return directories.withColumn("kind", kind).where("kind is not null").groupBy("scan_id", "kind").agg(F.sum("size_bytes").alias("bytes"), F.count(F.lit(1)).alias("directories"))


def dev_artifacts(t):
    d = build_artifacts(t["path_directories"])
    limit = F.when(F.col("kind") == "node_modules", 1_000_000_000).otherwise(2_000_000_000)
    return _rec(d.where(F.col("bytes") > limit), id=F.when(F.col("kind") == "node_modules", "cleanup-node-modules").otherwise("cleanup-target-dirs"),
                title="Build output can be made again", rationale=F.concat(F.lit("Directories called "), "kind", F.lit(" hold "), human_bytes(F.col("bytes")), F.lit(".")),
                confidence=F.lit(0.8), saving=F.col("bytes"), risk="low", pos=F.when(F.col("kind") == "node_modules", 0).otherwise(1))


def cache_sizes(directories: DataFrame, targets: DataFrame) -> DataFrame:
    """targets: id, path.  Bytes of the retained directories that are a target's."""
    return directories.join(F.broadcast(targets), "path").groupBy("scan_id", "id").agg(F.sum("size_bytes").alias("bytes"))  # targets are a fixed list


def system_caches(t):
    spark = t["path_directories"].sparkSession
    targets = t.get("cache_targets")
    if targets is None:  # no list of caches for this platform
        targets = local_table(spark, [], "id string, path string")
    d = cache_sizes(t["path_directories"], targets).where(F.col("bytes") > 500_000_000)
    return _rec(d, id=F.concat(F.lit("cleanup-"), "id"), title="A system cache can be emptied", rationale=F.concat(F.lit("The cache holds "), human_bytes(F.col("bytes")), F.lit(".")),
                confidence=F.lit(0.7), saving=F.col("bytes"), risk="medium")


def trend_growth(t):
    """The last two stored snapshots, whatever scan they are of; their findings go to every scan of t."""
    if "disk_snapshots" not in t:
        return None
    scans = t["scans"].select("scan_id")
    d = trend.disk_growth(t["disk_snapshots"].drop("scan_id")).crossJoin(scans)  # growth rows are at most the disks of one snapshot
    p = trend.path_growth(t["path_snapshots"].drop("scan_id")).crossJoin(scans)
    when = F.concat(F.lit(" in the last "), human_days(F.col("days")), F.lit("."))
    disk = _rec(d, id=F.col("id"), title="A disk fills up", rationale=F.concat("mount_point", F.lit(" lost "), human_bytes(F.col("growth_bytes")), when), confidence=F.col("confidence"),
                target=F.col("mount_point"), risk="medium")
    path = _rec(p, id=F.col("id"), title="A root grows", rationale=F.concat("root_path", F.lit(" grew by "), human_bytes(F.col("growth_bytes")), when), confidence=F.col("confidence"), risk="low",
                pos=F.lit(1_000_000))
    return disk.unionByName(path)


class Analyzer(Protocol):
    """The extension point: rows of COLUMNS from the tables, or None for nothing."""

    def __call__(self, t: dict[str, DataFrame]) -> DataFrame | None: ...


#: (rule id, rule, how it is traced): one trace a scan, one for all of its recommendations, or one each.
RULES: tuple[tuple[str, Callable, str], ...] = (
    ("active_workload_placement", active_workload_placement, "one"), ("consolidation_opportunity", consolidation_opportunity, "one"),
    ("risky_disk", risky_disk, "many"), ("backup_gap", backup_gap, "one"), ("duplicate_cleanup", duplicate_cleanup, "one"), ("os_headroom", os_headroom, "one"),
    ("cloud_exclusion_notice", cloud_exclusion_notice, "one"), ("dev_artifacts", dev_artifacts, "each"), ("system_caches", system_caches, "each"), ("trend_analyzer", trend_growth, "each"),
)


def candidates(t: dict[str, DataFrame], rules=RULES) -> DataFrame:
    """All rules' rows: COLUMNS and rule_pos, policy_rules_applied; pos is the order over all rules."""
    out = None
    for i, (_, rule, kind) in enumerate(rules):
        rows = rule(t)
        if rows is None:
            continue
        pre = F.array().cast("array<string>") if kind == "each" else F.array(F.lit(SAFE))
        rows = rows.select(*COLUMNS, F.lit(i).alias("rule_pos"), pre.alias("policy_rules_applied"))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("pos", F.row_number().over(W.partitionBy("scan_id").orderBy("rule_pos", "pos", "id")) - 1)


def traces(t: dict[str, DataFrame], recs: DataFrame, rules=RULES) -> DataFrame:
    """scan_id, rule_pos, pos, rule_id, status, detail, recommendation_id, confidence: a rule without a recommendation
    says skipped."""
    spark = recs.sparkSession
    every = t["scans"].select("scan_id").crossJoin(F.broadcast(local_table(spark, [(i, r, k) for i, (r, _, k) in enumerate(rules)], "rule_pos int, rule_id string, kind string")))
    each = every.where("kind != 'many'").join(recs.select("scan_id", "rule_pos", "pos", "id", "confidence"), ["scan_id", "rule_pos"], "left")
    found = F.col("id").isNotNull()
    each = each.select("scan_id", "rule_pos", "pos", "rule_id", F.when(found, "emitted").otherwise("skipped").alias("status"),
                       F.when(found, "one recommendation").otherwise("conditions not met").alias("detail"), F.col("id").alias("recommendation_id"), "confidence")
    many = recs.groupBy("scan_id", "rule_pos").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"), F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("ids"))
    many = every.where("kind = 'many'").join(many, ["scan_id", "rule_pos"], "left")
    found = F.col("n").isNotNull()
    many = many.select("scan_id", "rule_pos", F.lit(None).cast("int").alias("pos"), "rule_id", F.when(found, "emitted").otherwise("skipped").alias("status"),
                       F.when(found, F.concat(F.col("n").cast("string"), F.lit(" recommendation(s): "), F.array_join("ids.id", ", "))).otherwise("conditions not met").alias("detail"),
                       F.lit(None).cast("string").alias("recommendation_id"), "confidence")
    return each.unionByName(many)
