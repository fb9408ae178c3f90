"""A report as Markdown: each section is put together by Spark, the driver only joins the sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.scalars import human_bytes

MOST_DUPLICATES = 20


def _lines(df: DataFrame, line: Column, order: str = "pos") -> DataFrame:
    return df.groupBy("scan_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))


def sections(t: dict[str, DataFrame]) -> DataFrame:
    """scan_id, section_pos, title, body.  Of the duplicate groups only the first MOST_DUPLICATES are shown."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    s = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    parts = [
        ("Disks", t["disks"], s("- **", text("name"), "** at `", text("mount_point"), "`: ", human_bytes(F.col("free_space_bytes")), " free of ", human_bytes(F.col("total_space_bytes")),
                                ", ", text("storage_type"), ", ", text("locality_class"), ", role ", text("role"))),
        ("Paths", t["paths"], s("- `", text("root_path"), "`: ", text("file_count"), " files, ", human_bytes(F.col("total_size_bytes")))),
        ("Categories", t["categories"], s("- `", text("target"), "`: ", text("category"), " (", F.format_string("%.2f", "confidence"), ")")),
        ("Duplicates", t["duplicate_groups"].where(F.col("pos") < MOST_DUPLICATES), s("- `", text("hash"), "`: ", text("file_count"), " files, ", human_bytes(F.col("total_wasted_bytes")), " wasted, ", text("intent"))),
        ("Recommendations", t["recommendations"], s("### ", text("title"), "\n\n- id `", text("id"), "`, confidence ", F.format_string("%.2f", "confidence"), ", risk ", text("risk_level"), "\n- ", text("rationale"))),
        ("Policy decisions", t["policy_decisions"], s("- `", text("policy_id"), "` ", text("action"), " `", text("recommendation_id"), "`: ", text("rationale"))),
        ("Rule traces", t["rule_traces"], s("- `", text("rule_id"), "` ", text("status"), ": ", text("detail"))),
        ("Warnings", t["warnings"], s("- ", text("text"))),
    ]
    out = None
    for i, (title, df, line) in enumerate(parts):
        one = _lines(df, line).withColumns({"section_pos": F.lit(i), "title": F.lit(title)})
        out = one if out is None else out.unionByName(one)
    return out


def render(t: dict[str, DataFrame], scan_id: str, generated_at: str) -> str:
    body = {r["title"]: r["body"] for r in sections(t).where(F.col("scan_id") == scan_id).collect()}
    out = ["# Storage report", "", f"Scan `{scan_id}`, {generated_at}"]
    for title in ("Disks", "Paths", "Categories", "Duplicates", "Recommendations", "Policy decisions", "Rule traces", "Warnings"):
        out += ["", f"## {title}", "", body.get(title, "None.")]
    return "\n".join(out) + "\n"
