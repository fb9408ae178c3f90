"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space the contracts name: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands in for a null id where ids are ordered or joined.
NO_ID = -(2**63)


#: Tables of at most so many rows (of a few numbers each) are broadcast; larger ones meet by shuffle.
FEW = 200_000
#: A key with more rows than this is hot, whatever share of the input that is.
HOT_ROWS = 100_000

_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.  Where none is set, a temporary one in local mode (tests); on a cluster
    an error, since executors would each write to a folder of their own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_stowage_dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = spark._stowage_dir = tempfile.mkdtemp(prefix="stowage-")
        atexit.register(shutil.rmtree, path, True)
    return path.rstrip("/")


def written(df: DataFrame, tag: str = "t", tasks: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: the lineage ends there, and a lost executor costs
    only the tasks that it ran.  tasks: write with so many at most (where the caller knows the rows to be few)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if (paths := getattr(_open, "paths", None)) is not None:
        paths.append(path)
    (df if tasks is None else df.coalesce(tasks)).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders in whatever store they are in."""
    conf = spark._jsc.hadoopConfiguration()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def scratched(make):
    """Of a function that returns a DataFrame: the result is written, and the tables written on the way are deleted."""

    @functools.wraps(make)
    def run(*args, **kw) -> DataFrame:
        outer, mine = getattr(_open, "paths", None), []
        _open.paths = mine
        try:
            df = make(*args, **kw)
            _open.paths = outer
            return written(df, make.__name__)
        finally:
            _open.paths = outer
            removed(SparkSession.active(), mine)

    return run


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, other characters left; lower() is used where it means the same (ASCII text)."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(rows: DataFrame, keys: list[str], share: int = 1000, least: int = 1000, most: int = HOT_ROWS) -> DataFrame:
    """Keys that hold more than `most` rows, or more than 1/share of all rows and more than `least`: no other key gives
    a task more than `most` rows, whatever the input.  Counted over all rows with map-side partial sums."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    hot = counts.crossJoin(F.broadcast(total)).where((F.col("_n") > least) & ((F.col("_n") > most) | (F.col("_n") * share > F.col("_total"))))  # one row
    return written(hot.select(*keys), "hot")


def is_few(table: DataFrame) -> bool:
    return table.limit(FEW + 1).count() <= FEW


def sided(table: DataFrame, small: bool) -> DataFrame:
    """A table as one side of a join: broadcast if it is known to be small, merged otherwise (where adaptive execution
    splits a key with very many rows on the other side)."""
    return F.broadcast(table) if small else table.hint("merge")


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame, how: str = "left") -> DataFrame:
    """big join small on keys, where `hot` (written, see hot_keys) names the keys that one task should not get: their
    rows of `small`, which has one row a key, are broadcast if they are few, all others meet by shuffle."""
    small_hot = is_few(hot)
    side = sided(hot, small_hot)
    hot_side = big.join(side, keys, "left_semi").join(sided(small.join(side, keys, "left_semi"), small_hot), keys, how)
    return big.join(side, keys, "left_anti").join(small.join(side, keys, "left_anti"), keys, how).unionByName(hot_side)


#: Of a batch that goes to Python: rows, and bytes (a longer text goes alone).
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def python_side(spark: SparkSession) -> None:
    """Before mapInArrow: bounds of a batch by rows and by bytes, the same for all operators, and this package on the
    workers' path, wherever the driver was started."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (home, env.get("PYTHONPATH", "")) if x)
