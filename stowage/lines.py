"""The lines that commands show: one text a row, in order, made in the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.scalars import display_bytes, display_signed_bytes, escape_lines


def _lines(rows: DataFrame, text: Column, *order) -> DataFrame:
    return rows.orderBy(*order).select(escape_lines(text).alias("line"))


def _or(c: str, other: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(other))


def recommendation_lines(recs: DataFrame) -> DataFrame:
    """recs: scan_id, pos, risk_level, confidence, policy_safe, title, rationale."""
    safe = F.when(F.col("policy_safe"), "safe").otherwise("blocked")
    head = F.concat(F.lit("- "), "risk_level", F.lit(" risk, "), F.format_string("%.2f", F.col("confidence")), F.lit(", "), safe, F.lit(": "))
    return _lines(recs, F.concat(head, "title", F.lit(" ("), "rationale", F.lit(")")), "scan_id", "pos")


def summary_line(total: DataFrame) -> DataFrame:
    """total: one row of evaluate.summary."""
    return total.select(F.format_string("%d of %d cases pass, precision of the first three %.3f, contradictions %.3f, unsafe %d", F.col("passed_cases").cast("bigint"), F.col("total_cases").cast("bigint"),
                                        F.col("precision_at_3"), F.col("contradiction_rate"), F.col("unsafe_recommendations").cast("bigint")).alias("line"))


def case_lines(results: DataFrame) -> DataFrame:
    hits = F.when(F.size("forbidden_hits") > 0, F.array_join("forbidden_hits", ", ")).otherwise("none")
    return _lines(results, F.concat(F.lit("- "), F.when(F.col("passed"), "pass").otherwise("fail"), F.lit(" "), "name", F.format_string(", %.3f of the first three, forbidden: ", F.col("precision_at_3")), hits), "name")


def scenario_lines(plan: DataFrame) -> DataFrame:
    text = F.concat(F.lit("- "), "scenario_id", F.lit(": "), F.col("recommendation_count").cast("string"), F.lit(" recommendations, saves "), display_bytes(F.col("projected_space_saving_bytes")), F.lit(", "),
                    F.col("blocked_recommendation_count").cast("string"), F.lit(" blocked"))
    return _lines(plan, text, "scan_id", "scenario_pos")


def report_lines(index: DataFrame) -> DataFrame:
    """index: INDEX_SCHEMA; the latest first."""
    text = F.concat(F.lit("- "), "scan_id", F.lit(", "), "generated_at", F.lit(", roots "), F.array_join("roots", " "), F.lit(", "), "backend", F.lit(", "), F.col("warnings_count").cast("string"), F.lit(" warnings, "),
                    F.col("recommendation_count").cast("string"), F.lit(" recommendations"), F.when(F.col("imported"), ", imported").otherwise(""))
    return _lines(index, text, F.desc("generated_at"), "scan_id")


def disk_diff_lines(diffs: DataFrame) -> DataFrame:
    return _lines(diffs, F.concat(F.lit("- "), "mount_point", F.lit(": free "), display_signed_bytes(F.col("free_space_delta_bytes"))), "mount_point")


def path_diff_lines(diffs: DataFrame) -> DataFrame:
    return _lines(diffs, F.concat(F.lit("- "), "root_path", F.lit(": "), display_signed_bytes(F.col("size_delta_bytes")), F.lit(", files "), F.col("file_count_delta").cast("string")), "root_path")


def change_lines(changes: DataFrame) -> DataFrame:
    return _lines(changes, F.concat(F.lit("- "), "id", F.lit(": "), F.replace("change", F.lit("_"), F.lit(" "))), "id", "change")


def disk_lines(disks: DataFrame) -> DataFrame:
    """What doctor shows of each disk."""
    text = F.concat(F.lit("- "), "name", F.lit(" at "), "mount_point", F.lit(": "), _or("storage_type", "unknown"), F.lit(", "), _or("locality_class", "unknown"), F.lit(", "), display_bytes(F.col("free_space_bytes")), F.lit(" of "),
                    display_bytes(F.col("total_space_bytes")), F.lit(" free"), F.when(F.col("is_os_drive"), ", system").otherwise(""), F.when(~F.col("eligible_for_local_target"), F.concat(F.lit(", no target: "), F.array_join("ineligible_reasons", "; "))).otherwise(""))
    return _lines(disks, text, "mount_point")


def parity_line(p: DataFrame) -> DataFrame:
    return p.select(F.concat(F.when(F.col("within_tolerance"), "The totals agree").otherwise("The totals differ"), F.lit(": files "), F.col("scanned_files_delta").cast("string"), F.lit(", bytes "), F.col("scanned_bytes_delta").cast("string"),
                             F.lit("; "), F.col("native_elapsed_ms").cast("string"), F.lit(" and "), F.col("other_elapsed_ms").cast("string"), F.lit(" ms")).alias("line"))


def benchmark_line(b: DataFrame) -> DataFrame:
    return b.select(F.format_string("%s: %d scans, %.2f ms, %.2f files, %.2f MB/s", F.col("backend"), F.col("iterations").cast("bigint"), F.col("avg_elapsed_ms"), F.col("avg_files"), F.col("avg_throughput_mb_s")).alias("line"))


def shown(lines: DataFrame, most: int = 1000) -> list[str]:
    """The first lines, for a console."""
    return [r["line"] for r in lines.limit(most).collect()]


def scan_lines(report: dict) -> list[str]:
    m = report["scan_metrics"]
    return [f"{len(report['scan']['roots'])} roots, {len(report['disks'])} disks, {m['scanned_files']} files, {len(report['warnings'])} warnings",
            f"{m['backend']}, {m['elapsed_ms']} ms, {m['contradiction_count']} contradictions; nothing was changed"]
