"""Progress events of scans: an append-only table that is polled, counted and streamed.

Event rows: EVENT_SCHEMA of schemas.py; seq counts from 1 within a scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas


def append_events(spark: SparkSession, rows: list[tuple], folder: str) -> None:
    spark.createDataFrame(rows, schemas.EVENT_SCHEMA).write.mode("append").parquet(folder)


def stream_events(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schemas.EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def poll(events: DataFrame, scan_id: str | None = None, from_seq: int = 0) -> DataFrame:
    """What came after from_seq, in order."""
    rows = events.where(F.col("seq") > from_seq)
    return (rows if scan_id is None else rows.where(F.col("scan_id") == scan_id)).orderBy("scan_id", "seq")


def phase_counts(events: DataFrame) -> DataFrame:
    """Events by scan and phase; works on batches and streams."""
    return events.groupBy("scan_id", "phase").agg(F.count(F.lit(1)).alias("events"))


def progress_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("scan_id").agg(F.count(F.lit(1)).alias("total_events"), F.bool_or(F.col("phase") == "done").alias("completed"))


def tail(events: DataFrame, n: int = 12, by: str = "scan_id") -> DataFrame:
    """The last n events of each scan."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc("seq")))
    return events.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def running_counters(roots: DataFrame) -> DataFrame:
    """roots: scan_id, root_pos, file_count, total_size_bytes.  seq, and files and bytes up to each root."""
    w = W.partitionBy("scan_id").orderBy("root_pos")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    return roots.withColumns({"seq": F.row_number().over(w), "scanned_files": F.sum("file_count").over(upto), "scanned_bytes": F.sum("total_size_bytes").over(upto)})


def count_phases_live(events: DataFrame, name: str, checkpoint: str):
    """A running streaming query that keeps phase counts in the memory table `name`."""
    return phase_counts(events).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
