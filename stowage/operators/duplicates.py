"""Duplicate files: sizes that occur once never have their content hashed.

A group is one row of sums; its files are rows of a child table under the same key (scan_id, size_bytes, hash).  No group,
however large, becomes one row or one task's work: sums are partial before the shuffle, the first files of each group go
through Spark's group limit, and running numbers of all files come from ranges of the sorted child table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import contains_any, path_suffix
from ..tables import temporary

#: A path with one of these words is kept on purpose (fixed values).
KEPT_ON_PURPOSE = ("backup", "time machine", "history", "mirror", "snapshot")
MIB = 1 << 20
KEY = ("scan_id", "size_bytes", "hash")
#: Files of a group that stand beside it as an array; the rest is a number.
MOST_FILES = 1000


def candidates(files: DataFrame, min_size: int = 0) -> DataFrame:
    """Files of a size that occurs twice or more in their scan.  Sizes are counted with partial aggregates and joined
    back, so a size that a third of all files share is no single task's work."""
    rows = files.where(F.col("size_bytes") >= min_size)
    sizes = rows.groupBy("scan_id", "size_bytes").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return rows.join(sizes, ["scan_id", "size_bytes"], "left_semi")


def _hashed(files: DataFrame, min_size: int, once_per_path: bool) -> DataFrame:
    rows = candidates(files.dropDuplicates(["scan_id", "path"]) if once_per_path else files, min_size)
    return rows.where(F.col("content_hash").isNotNull()).withColumnRenamed("content_hash", "hash")


def groups(files: DataFrame, min_size: int = 0, once_per_path: bool = True) -> DataFrame:
    """files: scan_id, path, size_bytes, disk_mount, modified_ts, content_hash.  One row for each size and hash that two
    files or more have: file_count, first_file (by path), mounts, suffixes, total_wasted_bytes and whether the copies look
    intentional.  Files without a hash are in no group.  With once_per_path a file that overlapping roots list twice counts
    once."""
    file = F.struct("path", "disk_mount", F.col("modified_ts").alias("modified"))
    out = _hashed(files, min_size, once_per_path).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("file_count"), F.min(file).alias("first_file"), F.count_distinct("disk_mount").alias("mounts"),
        F.count_distinct(path_suffix(F.col("path"))).alias("suffixes"), F.bool_or(contains_any(F.lower("path"), KEPT_ON_PURPOSE)).alias("_named")).where("file_count > 1")
    label = F.when(F.col("_named") | ((F.col("mounts") > 1) & (F.col("suffixes") == 1)), "likely_intentional").otherwise("likely_redundant")
    return out.withColumns({"total_wasted_bytes": F.col("size_bytes") * (F.col("file_count") - 1), "intent": label}).drop("_named")


def group_files(files: DataFrame, of: DataFrame, min_size: int = 0, once_per_path: bool = True) -> DataFrame:
    """The child table: scan_id, size_bytes, hash, path, disk_mount, modified of the files of the groups in `of`."""
    rows = _hashed(files, min_size, once_per_path).join(of.select(*KEY), list(KEY), "left_semi")
    return rows.select(*KEY, "path", "disk_mount", F.col("modified_ts").alias("modified"))


def first_files(children: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """The first files of each group by path, with their number from 1: at most so many rows a group leave a task."""
    number = F.row_number().over(W.partitionBy(*KEY).orderBy("path", "disk_mount"))
    return children.withColumn("number", number).where(F.col("number") <= most)


def numbered(children: DataFrame) -> DataFrame:
    """All files with their number from 1 in their group by path.  The child table is cut into ranges of group and path, so
    a group of any size is many ranges; a file's number is its place in its range and what earlier ranges hold."""
    spark = children.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = children.repartitionByRange(parts, *KEY, "path", "disk_mount").withColumn("_range", F.spark_partition_id())
    rows = temporary(cut, "ranges")  # written, so a row keeps its range
    here = F.row_number().over(W.partitionBy(*KEY, "_range").orderBy("path", "disk_mount"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*KEY).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.groupBy(*KEY, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", before).drop("_n")
    return rows.withColumn("_here", here).join(sizes, [*KEY, "_range"]).withColumn("number", F.col("_here") + F.col("_before")).drop("_here", "_before", "_range")


def with_files(of: DataFrame, children: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """Groups with `files`, the first of each by path as an array, and more_files, how many others there are."""
    file = F.struct("path", "disk_mount", "modified")
    some = first_files(children, most).groupBy(*KEY).agg(F.array_sort(F.collect_list(file)).alias("files"))
    return of.join(some, list(KEY)).withColumn("more_files", F.col("file_count") - F.size("files"))


def duplicate_groups(files: DataFrame, min_size: int = 0, once_per_path: bool = True, most: int = MOST_FILES) -> DataFrame:
    """Groups beside their first files."""
    of = groups(files, min_size, once_per_path)
    return with_files(of, group_files(files, of, min_size, once_per_path), most)


def by_waste() -> list:
    """The order of groups: wasted bytes, then files; ties by size and hash."""
    return [F.desc("total_wasted_bytes"), F.desc("file_count"), F.desc("size_bytes"), F.col("hash")]


def ranked(of: DataFrame) -> DataFrame:
    return of.orderBy(*by_waste())


def total_waste(of: DataFrame) -> DataFrame:
    return of.groupBy("scan_id").agg(F.sum("total_wasted_bytes").alias("wasted_bytes"), F.count(F.lit(1)).alias("groups"))


def redundant_waste(of: DataFrame, least_group: int = 64 * MIB, least_total: int = 256 * MIB) -> DataFrame:
    """Waste of redundant groups that are worth a look, for scans where it adds up."""
    worth = of.where((F.col("intent") == "likely_redundant") & (F.col("total_wasted_bytes") >= least_group))
    return worth.groupBy("scan_id").agg(F.sum("total_wasted_bytes").alias("wasted_bytes"), F.count(F.lit(1)).alias("groups")).where(F.col("wasted_bytes") >= least_total)
