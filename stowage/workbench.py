"""What a user interface derives: output paths, lists without repeats, and what belongs to one recommendation."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import filters

#: Folder names below the user's state folder.
APP, STORE = "stowage", "reports"


def default_store(env=os.environ, system: str = os.name) -> str:
    """Where reports go if no folder is given: the platform's folder for a program's state."""
    if system == "nt":
        base = env.get("LOCALAPPDATA")
    else:
        base = env.get("XDG_STATE_HOME") or (os.path.join(env["HOME"], ".local", "state") if env.get("HOME") else None)
    if base is None:
        import tempfile

        base = tempfile.gettempdir()
    return os.path.join(base, APP, STORE)


def store_folder(custom: str | None = None, env=os.environ) -> str:
    return custom or default_store(env)


def beside(report_path: str | None, ending: str, default: str = "report.json") -> str:
    """The report's path with another ending in place of .json, whatever its case."""
    base = (report_path or "").strip() or default
    return (base[:-5] if base.lower().endswith(".json") else base) + ending


def diagnostics_path(report_path: str | None = None) -> str:
    return beside(report_path, ".diagnostics.json")


def markdown_path(report_path: str | None = None) -> str:
    return beside(report_path, ".md")


def diff_path(left: str | None = None, right: str | None = None) -> str:
    return f"{(left or '').strip() or 'left'}-to-{(right or '').strip() or 'right'}.diff.json"


def appended(items: list[str], item: str) -> list[str]:
    """items with the trimmed item at the end, unless it is empty or there already."""
    item = item.strip()
    return items if not item or item in items else [*items, item]


@dataclass(frozen=True)
class View:
    """What a user has opened and how it is narrowed: the texts and choices of the lists of a report."""

    scan_id: str | None = None
    report_path: str | None = None
    recommendation_id: str | None = None
    usage: str = ""
    duplicates: str = ""
    recommendations: str = ""
    policy: str = "all"
    evidence: str = "all"
    trace_status: str = "all"
    trace_recommendation: str = "all"
    tab: str = "recommendations"


def opened(scan_id: str, recommendations: DataFrame, path: str | None = None) -> View:
    """The view of a report that was just loaded: nothing is narrowed, whatever was before, and its first recommendation is
    chosen."""
    first = recommendations.where(F.col("scan_id") == scan_id).orderBy("pos").select("id").first()
    return View(scan_id, (path or "").strip() or None, first["id"] if first else None)


def narrowed(view: View, t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The lists of a view: paths, duplicate_groups (by their files in duplicate_files), recommendations and rule_traces of
    its report."""
    mine = {k: v.where(F.col("scan_id") == view.scan_id) for k, v in t.items()}
    return {"paths": filters.search_usage(mine["paths"], view.usage), "duplicate_groups": filters.search_duplicates(mine["duplicate_groups"], view.duplicates, mine["duplicate_files"]),
            "recommendations": filters.filter_recommendations(mine["recommendations"], view.recommendations, view.policy, view.evidence),
            "rule_traces": filters.filter_traces(mine["rule_traces"], view.trace_status, view.trace_recommendation)}


def of_recommendation(bundle: dict[str, DataFrame], disks: DataFrame, recommendation_id: str) -> dict[str, DataFrame]:
    """The recommendation, its policy decisions, its traces, and the disk that it aims at."""
    rec = bundle["recommendations"].where(F.col("id") == recommendation_id)
    mine = F.col("recommendation_id") == recommendation_id
    target = rec.select("scan_id", F.col("target_mount").alias("mount_point")).where(F.col("mount_point").isNotNull()).distinct()
    return {"recommendation": rec, "policy_decisions": bundle["policy_decisions"].where(mine), "rule_traces": bundle["rule_traces"].where(mine),
            "disk": disks.join(target, ["scan_id", "mount_point"], "left_semi")}
