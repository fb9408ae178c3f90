"""Which disk a path lies on: longest mount that is a prefix by whole components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ancestors, unix_mount


def match_mounts(paths: DataFrame, mounts: DataFrame, path_col: str = "root_path", keys: tuple[str, ...] = ()) -> DataFrame:
    """paths with disk_mount: the longest of mounts (keys, mount_point, pos) at or above the path, the first on equal
    length, null if none is.  Each path's ancestors meet the mounts in an equi-join, not a range join."""
    norm = F.regexp_replace(unix_mount(F.translate("mount_point", "\\", "/")), "^$", "/")
    few = mounts.select(*keys, norm.alias("_up"), F.col("mount_point").alias("_mount"), F.col("pos").alias("_pos"))
    one = paths.select(*keys, path_col).distinct()
    up = one.select(*keys, path_col, F.explode(ancestors(F.col(path_col))).alias("_up"))
    hit = up.join(few, [*keys, "_up"]).groupBy(*keys, path_col).agg(F.max_by("_mount", F.struct(F.length("_mount"), -F.col("_pos"))).alias("disk_mount"))
    return paths.drop("disk_mount").join(hit, [*keys, path_col], "left")


def resolve_roots(roots: DataFrame, mounts: DataFrame | None = None) -> DataFrame:
    """roots: pos, path (explicit ones), or if there are none the mounts without pseudo file systems.  Roots that differ
    in case only are one, the first stays."""
    from pyspark.sql import Window as W

    rows = roots
    if mounts is not None and roots.isEmpty():
        rows = mounts.select("pos", F.col("mount_point").alias("path")).where(~is_pseudo(F.col("path")))
    first = F.row_number().over(W.partitionBy(F.lower("path")).orderBy("pos"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


#: Mounts that are no scan roots unless named (fixed values).
PSEUDO = ("/dev", "/proc", "/sys", "/run", "/mnt", "/media", "/cdrom", "/Volumes", "/System")


def is_pseudo(path):
    p = F.translate(path, "\\", "/")
    hit = F.lit(False)
    for prefix in PSEUDO:
        hit = hit | (p == prefix) | F.startswith(p, F.lit(prefix + "/"))
    return hit
