"""Usage of scan roots: totals, extensions, directories, largest files, activity.

`files` has scan_id, root_path, path, size_bytes, disk_mount, modified_ts, extension, top_dir.  Everything here is one
pass of partial aggregates; the top-k windows run on aggregated rows, or behind Spark's per-task group limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.scalars import parent_directory, path_depth
from ..tables import Commits, scratch

ROOT = ("scan_id", "root_path")
TOP_FILES, TOP_DIRECTORIES, TOP_EXTENSIONS = 20, 10, 12
RECENT_DAYS, STALE_DAYS = 90, 730


def activity(modified: Column, as_of: Column) -> Column:
    """unknown, recent (within 90 days), stale (730 days or more) or other."""
    return (F.when(modified.isNull(), "unknown").when(modified >= as_of - F.expr(f"INTERVAL {RECENT_DAYS} DAYS"), "recent")
            .when(modified <= as_of - F.expr(f"INTERVAL {STALE_DAYS} DAYS"), "stale").otherwise("other"))


def totals(files: DataFrame, as_of: Column) -> DataFrame:
    """Files, bytes and activity by root."""
    kind = activity(F.col("modified_ts"), as_of)
    return files.withColumn("_a", kind).groupBy(*ROOT).agg(
        F.first("disk_mount", ignorenulls=True).alias("disk_mount"), F.count(F.lit(1)).alias("file_count"), F.sum("size_bytes").alias("total_size_bytes"),
        F.count_if(F.col("_a") == "recent").alias("recent_files"), F.count_if(F.col("_a") == "stale").alias("stale_files"),
        F.count_if(F.col("_a") == "unknown").alias("unknown_modified_files"))


def directory_counts(dirs: DataFrame) -> DataFrame:
    return dirs.groupBy(*ROOT).agg(F.count(F.lit(1)).alias("directory_count"))


def scan_counters(roots: DataFrame) -> DataFrame:
    """Sums over the roots of each scan."""
    return roots.groupBy("scan_id").agg(F.count(F.lit(1)).alias("scanned_roots"), F.sum("file_count").alias("scanned_files"), F.sum("total_size_bytes").alias("scanned_bytes"))


def extensions(files: DataFrame) -> DataFrame:
    return files.groupBy(*ROOT, "extension").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


def top(rows: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows of each root; pos from 0.  k = 0 gives none."""
    pos = F.row_number().over(W.partitionBy(*ROOT).orderBy(*order))
    return rows.withColumn("pos", pos).where(F.col("pos") <= k).withColumn("pos", F.col("pos") - 1)


def top_extensions(files: DataFrame, k: int = TOP_EXTENSIONS) -> DataFrame:
    return top(extensions(files), k, F.desc("bytes"), "extension")


def extension_summary(files: DataFrame, k: int = TOP_EXTENSIONS) -> DataFrame:
    """The top k extensions of each root as one array, and what is left over."""
    every = extensions(files)
    rank = F.row_number().over(W.partitionBy(*ROOT).orderBy(F.desc("bytes"), "extension"))
    ranked = every.withColumn("pos", rank)
    inside = F.col("pos") <= k
    return ranked.groupBy(*ROOT).agg(
        F.transform(F.array_sort(F.collect_list(F.when(inside, F.struct("pos", "extension", "files", "bytes")))),
                    lambda e: F.struct(e["extension"].alias("extension"), e["files"].alias("files"), e["bytes"].alias("bytes"))).alias("top_extensions"),
        F.sum(F.when(inside, 0).otherwise(F.col("files"))).alias("other_files"), F.sum(F.when(inside, 0).otherwise(F.col("bytes"))).alias("other_bytes"),
        F.sum("files").alias("total_files"), F.sum("bytes").alias("total_bytes"))


def directories(files: DataFrame) -> DataFrame:
    """Bytes of the first-level directories; files directly in a root belong to none."""
    return files.where(F.col("top_dir").isNotNull()).groupBy(*ROOT, F.col("top_dir").alias("path")).agg(F.sum("size_bytes").alias("size_bytes"))


def top_directories(files: DataFrame, k: int = TOP_DIRECTORIES) -> DataFrame:
    return top(directories(files), k, F.desc("size_bytes"), "path")


def largest_files(files: DataFrame, k: int = TOP_FILES) -> DataFrame:
    return top(files.select(*ROOT, "path", "size_bytes", "modified_ts"), k, F.desc("size_bytes"), "path")


def tree_rollup(files: DataFrame) -> DataFrame:
    """Bytes and files of every directory of the tree, from the deepest level up: the second plan for the same totals.
    Files are summed by their own directory; then each level hands its sums to the directories above it, so a directory is
    shuffled once whatever its depth.  Levels are commits of a table; there are as many jobs as levels."""
    spark = files.sparkSession
    own = files.select(*ROOT, parent_directory(F.col("path")).alias("path"), "size_bytes").where(F.startswith("path", "root_path"))
    own = own.groupBy(*ROOT, "path").agg(F.sum("size_bytes").alias("size_bytes"), F.count(F.lit(1)).alias("files"))
    folder, cols = scratch(spark, "rollup"), (*ROOT, "path", "size_bytes", "files")
    own.withColumn("depth", path_depth(F.col("path"))).write.partitionBy("depth").parquet(f"{folder}/own")
    own = spark.read.schema(StructType([*own.schema.fields, StructField("depth", IntegerType())])).parquet(f"{folder}/own")
    deepest, top_ = own.agg(F.max("depth"), F.min(path_depth(F.col("root_path")))).first()
    levels = Commits(spark, f"{folder}/levels", own.drop("depth").schema)
    for depth in range(-1 if deepest is None else deepest, (0 if top_ is None else top_) - 1, -1):
        rows = own.where(F.col("depth") == depth).select(*cols)
        if levels.names():
            below = levels.read([f"{depth + 1:05}"]).withColumn("path", parent_directory(F.col("path"))).where(F.startswith("path", "root_path"))
            rows = rows.unionByName(below).groupBy(*ROOT, "path").agg(F.sum("size_bytes").alias("size_bytes"), F.sum("files").alias("files"))
        levels.append(rows, f"{depth:05}")
    return levels.read()


def parity(native: DataFrame, other: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """native and other: scan_id, scanned_files, scanned_bytes, elapsed_ms.  Their differences, and whether bytes agree
    within the tolerance (inclusive)."""
    n, o = native.alias("n"), other.alias("o")
    delta = (F.col("o.scanned_bytes") - F.col("n.scanned_bytes"))
    return n.join(o, "scan_id").select(
        "scan_id", F.col("n.elapsed_ms").alias("native_elapsed_ms"), F.col("o.elapsed_ms").alias("other_elapsed_ms"),
        (F.col("o.scanned_files") - F.col("n.scanned_files")).alias("scanned_files_delta"), delta.alias("scanned_bytes_delta"),
        F.lit(tolerance).alias("tolerance_ratio"), (F.abs(delta) / F.greatest(F.col("n.scanned_bytes"), F.lit(1)) <= tolerance).alias("within_tolerance"))


def benchmark(runs: DataFrame) -> DataFrame:
    """runs: backend, elapsed_ms, files, bytes: averages and throughput."""
    from ..functions.scalars import throughput_mb_s

    out = runs.groupBy("backend").agg(F.count(F.lit(1)).alias("iterations"), F.avg("elapsed_ms").alias("avg_elapsed_ms"),
                                      F.avg("files").alias("avg_files"), F.avg("bytes").alias("avg_bytes"))
    return out.withColumn("avg_throughput_mb_s", throughput_mb_s(F.col("avg_bytes"), F.col("avg_elapsed_ms")))
