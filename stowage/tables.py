"""Tables that grow by commits, in a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.  Where none is set, a temporary one in local mode; on a cluster an error,
    since every machine would write to a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_stowage_tables", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = spark._stowage_tables = tempfile.mkdtemp(prefix="stowage-tables-")
        atexit.register(shutil.rmtree, path, True)
    return path.rstrip("/")


def importable(spark: SparkSession) -> None:
    """This package on the path of Python workers that are started from now on, wherever the driver was started."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (home, env.get("PYTHONPATH", "")) if x)


def local_table(spark: SparkSession, rows: list[tuple], schema: str | StructType) -> DataFrame:
    """A table of the rows at hand that the planner knows as local: no task of Python reads them, and projections and
    filters over them are worked out while planning."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = zip(*rows, strict=True) if rows else ((),) * len(kind)
    made = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(kind), strict=True)], names=kind.names)
    return spark.createDataFrame(made, kind)


def landed(df: DataFrame) -> DataFrame:
    """A small table (a row a disk, root, retained directory or suggestion of one scan) as a local one: what is built on it
    is analysed and planned without its long history."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared one, which goes when the driver ends."""
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"

    def gone() -> None:
        with contextlib.suppress(Exception):  # the session may have ended first
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    atexit.register(gone)
    return path


def temporary(df: DataFrame, tag: str) -> DataFrame:
    """df written to a scratch folder and read again: its rows stay what they are, and lineage ends there."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Commits:
    """A table as a folder of commits, each a Parquet folder that counts once its job is over: Spark writes its marker
    last, so what a job left that was cancelled or lost is not seen.  A commit with the name of an earlier one replaces
    it.  Names are made of letters, digits, - and _."""

    DONE = "_SUCCESS"

    def __init__(self, spark: SparkSession, folder: str, schema: str | StructType):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _store(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        """The names of all commits, sorted."""
        fs = self._store()
        if not fs.exists(self._path()):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(self._path()) if s.isDirectory()]
        return sorted(n for n in found if fs.exists(self._path(f"{n}/{self.DONE}")))

    def append(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def read(self, names: list[str] | None = None) -> DataFrame:
        """The rows of the commits named, or of all there are now."""
        paths = [f"{self.folder}/{n}" for n in (self.names() if names is None else names)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else local_table(self.spark, [], self.schema)

    def drop(self, names: list[str]) -> None:
        """Removes the commits named."""
        for n in names:
            self._store().delete(self._path(n), True)

    def remove(self) -> None:
        self._store().delete(self._path(), True)
