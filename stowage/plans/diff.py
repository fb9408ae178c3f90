"""What changed between two reports: full outer joins on mount, root and recommendation id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import signed_delta


def _sides(left: DataFrame, right: DataFrame, key: str, cols: list[str]) -> DataFrame:
    mark = lambda df, side: df.select(F.col(key), F.lit(True).alias(f"{side}_here"), *(F.col(c).alias(f"{side}_{c}") for c in cols))
    out = mark(left, "l").join(mark(right, "r"), key, "full_outer")
    return out.withColumns({"in_left": F.coalesce("l_here", F.lit(False)), "in_right": F.coalesce("r_here", F.lit(False))})


def disk_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Mounts whose free space changed, or that one side lacks, by mount."""
    both = _sides(left, right, "mount_point", ["name", "free_space_bytes"])
    delta = signed_delta(F.col("l_free_space_bytes"), F.col("r_free_space_bytes"))
    return both.withColumn("free_space_delta_bytes", delta).where((F.col("free_space_delta_bytes") != 0) | (F.col("in_left") != F.col("in_right"))).select(
        "mount_point", F.coalesce("r_name", "l_name").alias("name"), F.col("l_free_space_bytes").alias("left_free_space_bytes"),
        F.col("r_free_space_bytes").alias("right_free_space_bytes"), "free_space_delta_bytes").orderBy("mount_point")


def path_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Roots whose size or file count changed, or that one side lacks, by root."""
    both = _sides(left, right, "root_path", ["total_size_bytes", "file_count"])
    both = both.withColumns({"size_delta_bytes": signed_delta(F.col("l_total_size_bytes"), F.col("r_total_size_bytes")),
                             "file_count_delta": signed_delta(F.col("l_file_count"), F.col("r_file_count"))})
    changed = (F.col("size_delta_bytes") != 0) | (F.col("file_count_delta") != 0) | (F.col("in_left") != F.col("in_right"))
    return both.where(changed).select("root_path", F.col("l_total_size_bytes").alias("left_size_bytes"), F.col("r_total_size_bytes").alias("right_size_bytes"),
                                      "size_delta_bytes", F.col("l_file_count").alias("left_file_count"), F.col("r_file_count").alias("right_file_count"),
                                      "file_count_delta").orderBy("root_path")


def recommendation_changes(left: DataFrame, right: DataFrame, least: float = 0.001) -> DataFrame:
    """added, removed, or which of confidence, target, risk and rationale changed: up to four rows an id, by id."""
    both = _sides(left, right, "id", ["confidence", "target_mount", "risk_level", "rationale"])
    pair = both.where(F.lit(True))
    here = F.col("in_left") & F.col("in_right")
    differs = lambda c: here & ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
    kinds = F.array_compact(F.array(
        F.when(~F.col("in_left"), "added"), F.when(~F.col("in_right"), "removed"),
        F.when(here & (F.abs(F.col("r_confidence") - F.col("l_confidence")) > least), "confidence_changed"),
        F.when(differs("target_mount"), "target_changed"), F.when(differs("risk_level"), "risk_changed"), F.when(differs("rationale"), "rationale_changed")))
    return pair.select("id", F.posexplode(kinds).alias("pos", "change"), F.col("l_confidence").alias("left_confidence"), F.col("r_confidence").alias("right_confidence"),
                       F.col("l_target_mount").alias("left_target_mount"), F.col("r_target_mount").alias("right_target_mount")).orderBy("id", "pos")


def waste_delta(left: DataFrame, right: DataFrame) -> DataFrame:
    """left, right: duplicate groups.  Their wasted bytes and the difference."""
    total = lambda df, name: df.agg(F.coalesce(F.sum("total_wasted_bytes"), F.lit(0)).alias(name))
    both = total(left, "left_wasted_bytes").crossJoin(total(right, "right_wasted_bytes"))  # one row each
    return both.withColumn("wasted_delta_bytes", F.col("right_wasted_bytes") - F.col("left_wasted_bytes"))


def report_diff(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """left, right: schemas.tables() of one report each."""
    return {
        "disk_diffs": disk_diff(left["disks"], right["disks"]), "path_diffs": path_diff(left["paths"], right["paths"]),
        "recommendation_changes": recommendation_changes(left["recommendations"], right["recommendations"]),
        "waste": waste_delta(left["duplicate_groups"], right["duplicate_groups"]),
    }
