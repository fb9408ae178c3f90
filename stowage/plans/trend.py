"""Growth between the last two stored snapshots of a scan history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import bare_id, utc_time

LEAST_BYTES, LEAST_SHARE = 1 << 30, 0.10


def latest_two(snapshots: DataFrame, series: tuple[str, ...] = ()) -> DataFrame:
    """snapshots: snap_pos, generated_at (one row a snapshot, in each series): the last two, rank 1 the latest."""
    rank = F.row_number().over(W.partitionBy(*series).orderBy(F.desc("snap_pos")))
    return snapshots.withColumn("rank", rank).where(F.col("rank") <= 2)


def days_between(earlier, later):
    """Whole days, 0 where a time can't be read."""
    seconds = F.unix_timestamp(utc_time(later)) - F.unix_timestamp(utc_time(earlier))
    return F.coalesce((seconds / 86400).cast("bigint"), F.lit(0))


def _pairs(rows: DataFrame, key: str, values: list[str], series: tuple[str, ...]) -> DataFrame:
    """Each key of the latest snapshot with its values in the one before, by lag over the last two snapshots."""
    last = latest_two(rows.select(*series, "snap_pos").distinct(), series)
    w = W.partitionBy(*series, key).orderBy("snap_pos")
    both = rows.join(last, [*series, "snap_pos"])
    return both.withColumns({f"previous_{v}": F.lag(v).over(w) for v in values}).where(F.col("rank") == 1).where(F.col(f"previous_{values[0]}").isNotNull())


def disk_growth(snapshots: DataFrame, series: tuple[str, ...] = ()) -> DataFrame:
    """snapshots: snap_pos, generated_at, mount_point, total_space_bytes, free_space_bytes.  Disks whose free space fell by
    over 1 GiB and over 10 % of the disk."""
    return grown_disks(_pairs(snapshots, "mount_point", ["free_space_bytes", "generated_at"], series), series)


def grown_disks(pairs: DataFrame, series: tuple[str, ...] = ()) -> DataFrame:
    """pairs: the latest values of each disk beside previous_free_space_bytes and previous_generated_at."""
    drop = F.col("previous_free_space_bytes") - F.col("free_space_bytes")
    share = F.col("growth_bytes") / F.greatest("total_space_bytes", F.lit(1))
    return pairs.withColumn("growth_bytes", drop).where((F.abs("growth_bytes") > LEAST_BYTES) & (share > LEAST_SHARE)).select(
        *series, F.concat(F.lit("disk-growth-"), bare_id(F.col("mount_point"))).alias("id"), "mount_point", "growth_bytes",
        days_between(F.col("previous_generated_at"), F.col("generated_at")).alias("days"), F.lit(0.75).alias("confidence"), F.lit("medium").alias("risk_level"))


def path_growth(snapshots: DataFrame, series: tuple[str, ...] = ()) -> DataFrame:
    """snapshots: snap_pos, generated_at, root_path, total_size_bytes.  Roots that grew by over 1 GiB and over 10 %."""
    return grown_paths(_pairs(snapshots, "root_path", ["total_size_bytes", "generated_at"], series), series)


def grown_paths(pairs: DataFrame, series: tuple[str, ...] = ()) -> DataFrame:
    grown = F.col("total_size_bytes") - F.col("previous_total_size_bytes")
    share = F.col("growth_bytes") / F.greatest("previous_total_size_bytes", F.lit(1))
    return pairs.withColumn("growth_bytes", grown).where((F.col("growth_bytes") > LEAST_BYTES) & (share > LEAST_SHARE)).select(
        *series, F.concat(F.lit("path-growth-"), bare_id(F.col("root_path"))).alias("id"), "root_path", "growth_bytes",
        days_between(F.col("previous_generated_at"), F.col("generated_at")).alias("days"), F.lit(0.78).alias("confidence"), F.lit("low").alias("risk_level"))


def history_tables(history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """disk_snapshots and path_snapshots of a history document (HISTORY_SCHEMA)."""
    s = history.select(F.posexplode("snapshots").alias("snap_pos", "s"))
    head = ["snap_pos", F.col("s.scan_id").alias("scan_id"), F.col("s.generated_at").alias("generated_at")]
    return (s.select(*head, F.explode("s.disks").alias("d")).select("snap_pos", "scan_id", "generated_at", "d.*"),
            s.select(*head, F.explode("s.paths").alias("p")).select("snap_pos", "scan_id", "generated_at", "p.*"))
