"""Explicit schemas of reports, history, suites and events, and the defaults of fields that may be missing.

Reports are nested documents, one row each; `tables()` explodes them into the star schema that the operators use, every
ordered array keeping its place in `pos`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPORT_VERSION = "1.3.0"

DISK = """struct<name:string, mount_point:string, total_space_bytes:bigint, free_space_bytes:bigint, disk_kind:string,
 file_system:string, storage_type:string, locality_class:string, locality_confidence:double, locality_rationale:string,
 is_os_drive:boolean, is_removable:boolean, vendor:string, model:string, interface:string, rotational:boolean,
 hybrid:boolean, performance_class:string, performance_confidence:double, performance_rationale:string,
 eligible_for_local_target:boolean, ineligible_reasons:array<string>, metadata_notes:array<string>,
 role_hint:struct<role:string, confidence:double, evidence:array<string>>, target_role_eligibility:array<string>>"""
PATH = """struct<root_path:string, disk_mount:string, total_size_bytes:bigint, file_count:bigint, directory_count:bigint,
 largest_files:struct<entries:array<struct<path:string, size_bytes:bigint, modified:string>>>,
 largest_directories:array<struct<path:string, size_bytes:bigint>>,
 file_type_summary:struct<top_extensions:array<struct<extension:string, files:bigint, bytes:bigint>>, other_files:bigint,
  other_bytes:bigint, total_files:bigint, total_bytes:bigint>,
 activity:struct<recent_files:bigint, stale_files:bigint, unknown_modified_files:bigint>>"""
CATEGORY = "struct<target:string, disk_mount:string, category:string, confidence:double, rationale:string, evidence:array<string>>"
DUPLICATE = """struct<size_bytes:bigint, hash:string, files:array<struct<path:string, disk_mount:string, modified:string>>,
 more_files:bigint, total_wasted_bytes:bigint, intent:struct<label:string, rationale:string>>"""
EVIDENCE = "struct<kind:string, label:string, detail:string, path:string, mount_point:string, duplicate_hash:string>"
RECOMMENDATION = f"""struct<id:string, title:string, rationale:string, confidence:double, target_mount:string,
 policy_safe:boolean, policy_rules_applied:array<string>, policy_rules_blocked:array<string>, evidence:array<{EVIDENCE}>,
 next_steps:array<string>, estimated_impact:struct<space_saving_bytes:bigint, performance:string, risk_notes:string>,
 risk_level:string>"""
DECISION = "struct<policy_id:string, recommendation_id:string, action:string, rationale:string>"
TRACE = "struct<rule_id:string, status:string, detail:string, recommendation_id:string, confidence:double>"
SCAN = """struct<roots:array<string>, max_depth:bigint, excludes:array<string>, dedupe:boolean, dedupe_min_size:bigint,
 dry_run:boolean, backend:string, progress:boolean, min_ratio:double, emit_progress_events:boolean,
 progress_interval_ms:bigint>"""
METRICS = """struct<backend:string, elapsed_ms:bigint, scanned_roots:bigint, scanned_files:bigint,
 scanned_directories:bigint, scanned_bytes:bigint, permission_denied_warnings:bigint, contradiction_count:bigint>"""
PROGRESS = "struct<total_events:bigint, phase_counts:array<struct<phase:string, events:bigint>>, completed:boolean>"
PARITY = """struct<native_elapsed_ms:bigint, pdu_library_elapsed_ms:bigint, scanned_files_delta:bigint,
 scanned_bytes_delta:bigint, tolerance_ratio:double, within_tolerance:boolean>"""


def _flat(ddl: str) -> str:
    return " ".join(ddl.split())


REPORT_SCHEMA = _flat(f"""report_version string, generated_at string, scan_id string, scan {SCAN}, scan_metrics {METRICS},
 scan_progress_summary {PROGRESS}, backend_parity {PARITY}, disks array<{DISK}>, paths array<{PATH}>,
 categories array<{CATEGORY}>, duplicates array<{DUPLICATE}>, recommendations array<{RECOMMENDATION}>,
 policy_decisions array<{DECISION}>, rule_traces array<{TRACE}>, warnings array<string>""")
REQUIRED = ("report_version", "generated_at", "scan", "disks", "paths", "categories", "duplicates", "recommendations", "warnings")
HISTORY_SCHEMA = ("snapshots array<struct<scan_id:string, generated_at:string, "
                  "disks:array<struct<mount_point:string, total_space_bytes:bigint, free_space_bytes:bigint>>, "
                  "paths:array<struct<root_path:string, total_size_bytes:bigint, file_count:bigint>>>>")
SUITE_SCHEMA = "cases array<struct<name:string, report:string, expected_top_ids:array<string>, forbidden_ids:array<string>>>"
EVENT_SCHEMA = ("seq bigint, scan_id string, phase string, current_path string, scanned_files bigint, scanned_bytes bigint, "
                "errors bigint, timestamp string")
INDEX_SCHEMA = ("scan_id string, generated_at string, report_version string, roots array<string>, backend string, "
                "warnings_count bigint, recommendation_count bigint, stored_report_path string, source_path string, imported boolean")

PHASES = ("enumerating_disks", "walking_files", "categorizing", "dedupe", "analyzing", "recommending", "done")
CATEGORIES = ("games", "work", "media", "archive", "backup")
ROLES = ("active_workload", "games_library", "media_library", "backup_target", "archive", "mixed", "unknown")


class MissingField(ValueError):
    """A report lacks a field that has no default."""


def with_defaults(reports: DataFrame) -> DataFrame:
    """reports (REPORT_SCHEMA) with missing fields filled as the data model says."""
    text = F.lit
    empty = lambda ddl: F.from_json(F.lit("[]"), f"array<{_flat(ddl)}>")
    zero = F.lit(0).cast("bigint")

    def disk(d):
        out = d
        for name, value in (("storage_type", text("unknown")), ("locality_class", text("unknown")), ("locality_confidence", F.lit(0.0)),
                            ("locality_rationale", text("")), ("is_os_drive", F.lit(False)), ("is_removable", F.lit(False)),
                            ("performance_class", text("unknown")), ("performance_confidence", F.lit(0.0)), ("performance_rationale", text("")),
                            ("eligible_for_local_target", F.lit(False)), ("ineligible_reasons", F.array().cast("array<string>")),
                            ("metadata_notes", F.array().cast("array<string>")), ("target_role_eligibility", F.array().cast("array<string>")),
                            ("role_hint", F.struct(text("unknown").alias("role"), F.lit(0.0).alias("confidence"), F.array().cast("array<string>").alias("evidence")))):
            out = out.withField(name, F.coalesce(d[name], value))
        return out

    def rec(r):
        none = F.array().cast("array<string>")
        out = r
        for name, value in (("confidence", F.lit(0.5)), ("policy_safe", F.lit(True)), ("policy_rules_applied", none), ("policy_rules_blocked", none),
                            ("evidence", empty(EVIDENCE)), ("next_steps", none)):
            out = out.withField(name, F.coalesce(r[name], value))
        return out

    m = F.col("scan_metrics")
    counts = [f for f in ("elapsed_ms", "scanned_roots", "scanned_files", "scanned_directories", "scanned_bytes", "permission_denied_warnings", "contradiction_count")]
    scan = F.col("scan")
    for name, value in (("backend", text("native")), ("progress", F.lit(False)), ("emit_progress_events", F.lit(False)), ("progress_interval_ms", F.lit(250).cast("bigint"))):
        scan = scan.withField(name, F.coalesce(F.col("scan")[name], value))
    p = F.col("scan_progress_summary")
    return reports.withColumns({
        "scan_id": F.coalesce("scan_id", text("unknown")),
        "scan": scan,
        "scan_metrics": F.struct(F.coalesce(m["backend"], text("native")).alias("backend"), *(F.coalesce(m[c], zero).alias(c) for c in counts)),
        "scan_progress_summary": F.struct(F.coalesce(p["total_events"], zero).alias("total_events"),
                                          F.coalesce(p["phase_counts"], empty("struct<phase:string, events:bigint>")).alias("phase_counts"),
                                          F.coalesce(p["completed"], F.lit(False)).alias("completed")),
        "disks": F.transform("disks", disk),
        "recommendations": F.transform("recommendations", rec),
        "policy_decisions": F.coalesce("policy_decisions", empty(DECISION)),
        "rule_traces": F.coalesce("rule_traces", empty(TRACE)),
    })


def checked(reports: DataFrame) -> DataFrame:
    """Fails, when it runs, on a report without a field that is required (Spark's readers fill in null)."""
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED)))
    missing = F.concat(missing, F.when(
        F.exists(F.coalesce("recommendations", F.array()), lambda r: r["risk_level"].isNull() | r["estimated_impact"].isNull()),
        F.array(F.lit("recommendations[].risk_level/estimated_impact"))).otherwise(F.array().cast("array<string>")))
    failed = F.raise_error(F.concat(F.lit("missing field: "), F.array_join(missing, ", ")))
    return reports.withColumn("report_version", F.when(F.size(missing) > 0, failed.cast("string")).otherwise(F.col("report_version")))


def tables(reports: DataFrame) -> dict[str, DataFrame]:
    """The star schema of some reports: disks, paths, path_directories, path_extensions, path_largest_files, categories,
    duplicate_groups, duplicate_files, recommendations, evidence, policy_decisions, rule_traces, warnings."""
    def rows(name: str) -> DataFrame:
        return reports.select("scan_id", F.posexplode(name).alias("pos", "_r")).select("scan_id", "pos", "_r.*")

    paths, dups, recs = rows("paths"), rows("duplicates"), rows("recommendations")
    flat = paths.select("scan_id", "pos", "root_path", "disk_mount", "total_size_bytes", "file_count", "directory_count", "activity.*",
                        F.col("file_type_summary.total_bytes").alias("type_total_bytes"))
    return {
        "disks": rows("disks").select("*", F.col("role_hint.role").alias("role")),
        "paths": flat,
        "path_directories": paths.select("scan_id", F.col("pos").alias("path_pos"), "root_path", F.posexplode("largest_directories").alias("pos", "_d")).select("scan_id", "path_pos", "root_path", "pos", "_d.*"),
        "path_extensions": paths.select("scan_id", F.col("pos").alias("path_pos"), "root_path", F.posexplode("file_type_summary.top_extensions").alias("pos", "_e")).select("scan_id", "path_pos", "root_path", "pos", "_e.*"),
        "path_largest_files": paths.select("scan_id", F.col("pos").alias("path_pos"), "root_path", F.posexplode("largest_files.entries").alias("pos", "_f")).select("scan_id", "path_pos", "root_path", "pos", "_f.*"),
        "categories": rows("categories"),
        "duplicate_groups": dups.select("scan_id", "pos", "size_bytes", "hash", "total_wasted_bytes", F.col("intent.label").alias("intent"), (F.size("files") + F.coalesce("more_files", F.lit(0))).alias("file_count"), F.col("files")[0].alias("first_file")),
        "duplicate_files": dups.select("scan_id", F.col("pos").alias("group_pos"), "size_bytes", "hash", F.posexplode("files").alias("pos", "_f")).select("scan_id", "group_pos", "size_bytes", "hash", "pos", "_f.*"),
        "recommendations": recs.select("*", F.col("estimated_impact.space_saving_bytes").alias("space_saving_bytes")),
        "evidence": recs.select("scan_id", "id", F.posexplode("evidence").alias("pos", "_e")).select("scan_id", "id", "pos", "_e.*"),
        "policy_decisions": rows("policy_decisions"),
        "rule_traces": rows("rule_traces"),
        "warnings": reports.select("scan_id", F.posexplode("warnings").alias("pos", "text")),
    }
